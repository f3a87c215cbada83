"""Operators 3 and 6 against brute force, and edge cases."""

import hashlib
import os
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from knotwork.llm import common, components, near_dups, suffix_dedup
from knotwork.llm.common import stored
from knotwork.llm.suffix_dedup import deep_shallow

DOCS = "doc_id long, text string"


# --- 3 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("shallow", [0, 8, 16])
def test_deep_shallow(shallow):
    rng = random.Random(shallow)
    for _ in range(60):
        alphabet = rng.choice(["ab", "abcdefgh", "a"])
        text = np.frombuffer("".join(rng.choice(alphabet) for _ in range(rng.randint(60, 400))).encode(), np.uint8)
        starts = np.array([rng.randint(0, len(text) - 50) for _ in range(rng.randint(0, 200))], np.int64)
        order, new = deep_shallow(text, starts, 50, shallow)
        strings = [text[s : s + 50].tobytes() for s in starts]
        got = [strings[i] for i in order]
        assert got == sorted(strings) and sorted(order) == list(range(len(starts)))
        assert [bool(x) for x in new] == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]


def brute_removed(docs, k=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for j in range(len(b) - k + 1 if i is not None else 0):
            w = b[j : j + k]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - k + 1 if i is not None else 0):
            if first[b[j : j + k]] < i:
                gone[j : j + k] = b"\1" * k
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def removed(df):
    found = suffix_dedup.remove_repeats(df)
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return [tuple(r) for r in found.select("doc_id", "n_bytes", total, F.size("spans"), F.sha2("kept", 256)).collect()]


@pytest.mark.parametrize("setting", [{}, {"HOT": 2}, {"HOT": 3, "BLOCK_BYTES": 3000}])
def test_substring_dedup(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(5)
    word = lambda lo, hi: "".join(rng.choice("abcdé ") for _ in range(rng.randint(lo, hi)))
    base = [word(60, 300) for _ in range(6)]
    docs = []
    for i in range(100):
        t = ""
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            t += b[a : a + rng.randint(0, 200)] + word(0, 40)
        docs.append((i, t))
    docs += [(200, "a" * 500), (201, "a" * 300), (202, "ab" * 100), (203, "ab" * 90), (204, None), (205, ""), (None, docs[5][1]), (3, docs[7][1]), (3, docs[7][1]), (206, "short")]
    key = lambda r: (r[0] is None, r)
    df = spark.createDataFrame(docs, DOCS).withColumn("block", F.lit("clash")).withColumn("spans", F.lit(1)).repartition(3)
    assert sorted(removed(df), key=key) == sorted(brute_removed(docs), key=key)


def test_anchor_once_in_each_block(spark, monkeypatch):
    """A passage that each of many blocks holds once, always in other surroundings: its edges are
    hot, so no group gets them from all blocks."""
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = some(90)
    docs = [(i, some(150) + passage + some(150)) for i in range(60)]
    df = spark.createDataFrame(docs, DOCS).repartition(60)
    blocks = stored(suffix_dedup._blocks(df, "doc_id", "text"), "blocks")
    assert blocks.count() > 40
    codes = stored(suffix_dedup._codes(suffix_dedup._hashes(blocks, 4)), "codes")
    parts = suffix_dedup._parts(blocks, codes, 4).collect()
    held = np.concatenate([np.cumsum(suffix_dedup._unpack(r["keys"]), dtype=np.uint64) for r in parts if r.what == "a"])
    assert any(r.what == "w" for r in parts) and np.unique(held, return_counts=True)[1].max() < 20
    key = lambda r: (r[0] is None, r)
    assert sorted(removed(df), key=key) == sorted(brute_removed(docs), key=key)


def test_substring_dedup_empty(spark):
    assert removed(spark.createDataFrame([], DOCS)) == []
    assert [r[:4] for r in removed(spark.createDataFrame([(1, None), (2, "x")], DOCS))] == [(1, 0, 0, 0), (2, 1, 0, 0)]


# --- 6 ------------------------------------------------------------------------------------------


def sets_of(text):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_components(docs):
    sets = [sets_of(t) for _, t in docs]
    parent = {i: i for i, _ in docs if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            i, j = docs[a][0], docs[b][0]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}, [len(s) for s in sets]


def near_copies(rng, n_groups=12, copies=14):
    vocabulary = [f"w{i}" for i in range(400)]
    docs, doc = [], 0
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 120))]
        for _ in range(copies):
            ws = list(base)
            for _ in range(rng.randint(0, max(1, len(ws) // 18))):
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            docs.append((doc, " ".join(ws)))
            doc += 1
    rng.shuffle(docs)
    return docs


def test_near_duplicates_against_brute_force(spark):
    docs = near_copies(random.Random(6))
    text = docs[0][1]
    docs += [(6000, docs[20][1]), (6000, docs[90][1]), (6000, "none of these words at all"), (6001, "none of these words at all")]
    docs += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, text.upper()), (None, text), (5006, text), (5006, text), (5007, "a b c d"), (5008, "a b c d e")]
    want, sizes = brute_components(docs)
    df = spark.createDataFrame(docs, DOCS).withColumn("n", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = near_dups.link(df).collect()
    assert len(got) == len(docs)
    assert sorted((r.id or -1, r.n_shingles) for r in got) == sorted((i or -1, n) for (i, _), n in zip(docs, sizes))
    for r in got:
        assert r.component_id == (None if r.id is None else want[r.id])
    kept = near_dups.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i} | {None}


def test_near_duplicates_in_parts(spark, monkeypatch):
    """Buckets larger than a part are cut, and nothing is lost."""
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    docs = near_copies(random.Random(66), n_groups=3, copies=30)
    want, _ = brute_components(docs)
    assert {r.id: r.component_id for r in near_dups.link(spark.createDataFrame(docs, DOCS)).collect()} == want


def test_template_family(spark, monkeypatch):
    """Pages of one template below the threshold: likely by sketch, but none shares a rare
    shingle, so no set is held against another."""
    seen = {}

    def spy(df, name, *more):
        out = stored(df, name, *more)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(near_dups, "stored", spy)
    template = [f"t{i}" for i in range(240)]
    docs = [(i, " ".join(template + [f"own{i}x{j}" for j in range(50)])) for i in range(300)]  # 236 of 336 shingles in common
    assert {r.id: r.component_id for r in near_dups.link(spark.createDataFrame(docs, DOCS)).collect()} == {i: i for i in range(300)}
    assert seen["families"] == 300 and seen["kin"] == 0


def test_recall_at_the_threshold(spark):
    """Pairs whose sets are just similar enough: of 400, at most 1 in 100 may be missed."""
    docs = []
    for i in range(400):
        n = 100 + i % 60
        own = n // 7 - n // 7 % 1
        while 100 * (n - own) < 75 * (n + own):
            own -= 1
        words = [f"p{i}x{j}" for j in range(n + 4)]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: n + 4 - own] + [f"q{i}x{j}" for j in range(own)]))]
    want, _ = brute_components(docs[:40])
    assert all(want[2 * i + 1] == 2 * i for i in range(20))
    got = {r.id: r.component_id for r in near_dups.link(spark.createDataFrame(docs, DOCS)).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(400)) >= 396


def test_near_duplicates_edges(spark):
    assert near_dups.link(spark.createDataFrame([], DOCS)).count() == 0
    assert {r.id: r.component_id for r in near_dups.link(spark.createDataFrame([(1, None), (2, "x y")], DOCS)).collect()} == {1: 1, 2: 2}


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    for share in (0.9, 0.75, 0.3):
        same = int(400 * 2 * share / (1 + share))
        b = np.concatenate([a[:same], rng.integers(0, 1 << 62, 400 - same).astype(np.uint64)])
        _, s = near_dups.sketch_of(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 400, 800]))
        differ = int(np.bitwise_count(s[0].view(np.uint64) ^ s[1].view(np.uint64)).sum())
        assert abs(differ - near_dups.most_differing(share)) < 45
        assert share < 0.75 or differ <= near_dups.most_differing(near_dups.LEAST_ESTIMATE)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2050)] + [(None, 1), (5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}


@pytest.mark.parametrize("hub", [0, 200_000])
def test_components_of_a_star(spark, monkeypatch, hub):
    """A vertex with 100 000 neighbours is cut into parts, whether it is the least or the largest."""
    leaves = spark.range(1, 100_001).select(F.lit(hub).cast("long").alias("u"), F.col("id").alias("v"))
    got = components.components(leaves)
    assert got.groupBy("component").count().collect() == [(min(hub, 1), 100_001)]


def test_salted(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_SHARE", 16)
    many = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("x"))
    one = many.filter("k <> 3").groupBy("k").agg(F.count("*").alias("c"))
    got = common.salted(many, one, ["k"], "x", "c", common.share_of(5000))
    assert sorted(got.collect()) == sorted(many.join(one, "k").collect())
    left = common.salted(many, one, ["k"], "x", "c", common.share_of(5000), "left")
    assert left.count() == 5000 and left.filter("c is null").count() == many.filter("k = 3").count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_substring_dedup_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = [tuple(r) for r in suffix_dedup.op3_suffix_dedup(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(brute_removed(docs))


def test_a_round_of_components_asks_once(spark, monkeypatch):
    """A round has one query for the driver; each more leaves threads and classes there."""
    frame, asked = type(spark.range(1)), []
    first = frame.first
    monkeypatch.setattr(frame, "first", lambda df: asked.append(1) or first(df))
    for name in ("count", "isEmpty"):
        monkeypatch.setattr(frame, name, lambda df: pytest.fail("a second query in a round"))
    kept, stored = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: kept.append(1) or stored(df, name))
    edges = [(i, i + 1) for i in range(30)] + [(40, 50), (50, 45), (60, 60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(31), 0) | dict.fromkeys((40, 45, 50), 40)
    assert len(asked) == len(kept) > 1
