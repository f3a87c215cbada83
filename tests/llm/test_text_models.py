"""Operators 1, 4, 7 and 10: brute-force versions, round trips, held-out accuracy, edge cases."""

import functools
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from knotwork.llm import bpe, common, language, quality, suffix_tree

DOCS = "doc_id long, text string"
ODD = ["", None, " \n\t ", "a", "A b", "é ü\tñ", "word " * 3000, "x" * 20_000, "a b", "a b", "\x0b\x0c q"]


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def test_word_hashes():
    rng = np.random.default_rng(1)
    texts = ODD + ["".join(rng.choice(list("ab \n"), rng.integers(0, 40))) for _ in range(300)] + ["y" * 600_000 + " z"]
    h, off = common.word_hashes(*common.buffers(pa.array(texts)))
    there, back = {}, {}
    for i, t in enumerate(texts):
        ws = tokens(t)
        assert len(ws) == off[i + 1] - off[i]
        for w, x in zip(ws, h[off[i] : off[i + 1]]):
            assert there.setdefault(w, x) == x and back.setdefault(x, w) == w


# --- 1 ----------------------------------------------------------------------------------


def brute_tree(docs, depth):
    texts = {i: [*tokens(t), b"\n"] for i, t, _ in docs}
    n = defaultdict(Counter)  # context: next token: count
    for i, _, held in docs:
        for k, w in enumerate(texts[i] if not held else []):
            for d in range(min(k, depth) + 1):
                n[tuple(texts[i][k - d : k])][w] += 1
    words = n[()]
    total = sum(words.values())

    @functools.cache
    def keep(ctx):
        own = n.get(ctx)
        if not own or sum(own.values()) < suffix_tree.least_count(len(ctx), total):
            return False
        a = sum(own.values())
        return sum(c * math.log(c / a / p(ctx[1:], x)) for x, c in own.items()) > len(own) * math.log(a) / 4

    @functools.cache
    def p(ctx, x):
        if not ctx:
            return (words[x] + 1) / (total + len(words) + 1)
        if not keep(ctx):
            return p(ctx[1:], x)
        return (n[ctx][x] + len(n[ctx]) * p(ctx[1:], x)) / (sum(n[ctx].values()) + len(n[ctx]))

    out = {}
    for i, ts in texts.items():
        base = sum(math.log10(p((), w)) for w in ts)
        score = sum(math.log10(p(tuple(ts[max(0, k - depth) : k]), w)) for k, w in enumerate(ts))
        out[i] = (base, score, len(ts), sum(words[w] > 0 for w in ts), total)
    kept = [c for c in n if c and keep(c)]
    for c in kept:  # every distribution sums to one, unseen words as one symbol
        assert sum(p(c, w) for w in words) + p(c, b"never seen") == pytest.approx(1)
    return out, kept


@pytest.mark.parametrize("depth, tokens_in_block", [(1, 10_000), (2, 10_000), (2, 150), (3, 60)])
def test_suffix_tree_against_brute_force(spark, monkeypatch, depth, tokens_in_block):
    monkeypatch.setattr(suffix_tree, "BLOCK_TOKENS", tokens_in_block)
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 6 * tokens_in_block)
    assert suffix_tree.least_count(1, 10**9) == 8 and suffix_tree.least_count(2, 10**4) == 8 and suffix_tree.least_count(2, 10**10) == 1000
    rng = np.random.default_rng(2)
    vocabulary = ["the", "of", "And", "thing", "ring", "é", "x1", "and"]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 30))), bool(i % 5 == 2)) for i in range(120)]
    docs += [(200 + i, "once upon a time " * (i % 4) + "the end of it" + " and so on" * (i % 3), i % 7 == 1) for i in range(60)]
    docs += [(500, None, False), (501, "", True), (502, " \n", False), (503, "the the", True), (504, "the\tthe", True), (505, "q" * 300, True)]
    want, kept = brute_tree(docs, depth)
    assert {len(c) for c in kept} == set(range(1, depth + 1))
    frame = spark.createDataFrame(docs, "doc_id long, text string, held_out boolean").withColumn("block", F.lit("clash")).repartition(6)
    got = suffix_tree.train_and_score(frame, depth).collect()
    assert len(got) == len(docs)
    for r in got:
        base, score, n, known, total = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_suffix_tree_asks_the_same_of_contexts_in_any_corpus(spark, monkeypatch):
    """Contexts of two tokens are kept by their own counts; only a thinned tree counts the corpus."""
    docs = spark.createDataFrame([(i, "a b c d " * 8 + "x b e f " * 8, False) for i in range(8)], "doc_id long, text string, held_out boolean")
    score = lambda **how: {r.doc_id: r.score for r in suffix_tree.train_and_score(docs, **how).collect()}
    small = score()
    assert score(thinned=True) == small
    monkeypatch.setattr(suffix_tree, "DEEP", 1e6)  # as if the corpus were very large
    assert score() == small and score(thinned=True) != small


def test_suffix_tree_edges(spark):
    assert suffix_tree.train_and_score(spark.createDataFrame([], "doc_id long, text string, held_out boolean")).count() == 0
    got = suffix_tree.train_and_score(spark.createDataFrame([(None, "a b", True), (1, "a b", True), (1, "a b", True)], "doc_id long, text string, held_out boolean")).collect()
    assert len(got) == 3 and {r.n_known for r in got} == {0} and len({r.score for r in got}) == 1
    old = suffix_tree.BLOCK_TOKENS
    try:  # many blocks give what one gives
        rows = [(i, t, i % 3 == 0) for i, t in enumerate(ODD * 3)]
        one = {r.doc_id: r.score for r in suffix_tree.train_and_score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").coalesce(1)).collect()}
        suffix_tree.BLOCK_TOKENS = 300
        many = {r.doc_id: r.score for r in suffix_tree.train_and_score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").coalesce(1)).collect()}
    finally:
        suffix_tree.BLOCK_TOKENS = old
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], rel=1e-6) for k in one)


# --- 4 ------------------------------------------------------------------------------------


def test_cross_parsing_against_brute_force():
    model = language.Model(("aa", "bb"), ((b"hello world, hello moon", b"low tide"), (b"bonjour monde 12",)))
    own = language.Automata(model)
    folded = [[bytes(own.classes[np.frombuffer(t, np.uint8)]) for t in ts] for ts in model.samples]
    texts = ["hello mode", "", "zzz zz", "bonjour hello, monde 99!", "w" * 3000]

    def phrases(samples, x):
        n = 0
        for at in range(0, len(x), language.SEGMENT):
            part = x[at : at + language.SEGMENT]
            i = 0
            n += 1
            have = b""
            while i < len(part):
                longer = have + part[i : i + 1]
                if 0 not in longer and any(longer in s for s in samples):
                    have = longer
                else:
                    n += 1
                    have = part[i : i + 1]
                    if 0 in have or not any(have in s for s in samples):
                        have = b""
                i += 1
        return n

    data, offsets = common.buffers(pa.array(texts))
    got = own.phrases(data, offsets)
    for j, t in enumerate(texts):
        x = bytes(own.classes[np.frombuffer(t.encode(), np.uint8)])
        assert [int(v) for v in got[:, j]] == [phrases(s, x) for s in folded], t


def test_language(spark):
    rng = np.random.default_rng(4)
    make = lambda ws: " ".join(rng.choice(ws, 40))
    en, fr = ["the", "house", "with", "thing", "over"], ["le", "maison", "avec", "chose", "été"]
    rows = [(i, make(en if i % 2 else fr), "en" if i % 2 else "fr") for i in range(60)] + [(100, None, "en"), (101, "", "fr"), (102, "12 ! 34", "en"), (103, "the house", None), (103, "the house", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_low", F.lit("clash"))
    model = language.fit(docs)
    got = language.identify(docs.withColumn("score", F.lit("old")), model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id < 100:
            assert r.lang_pred == r.lang and 0.5 <= r.score <= 1
        elif r.doc_id <= 102:
            assert r.lang_pred == "und" and r.score == 0
        else:
            assert r.lang_pred == "en"
    nobody = language.fit(docs.filter("false"))
    assert {r.lang_pred for r in language.identify(docs, nobody).collect()} == {"und"}
    assert language.identify(docs.filter("false"), model).count() == 0


# --- 7 ----------------------------------------------------------------------------------------


def test_bpe_against_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(7)
    texts = ODD + ["".join(rng.choice(list("abcdetr thn  \n.é😀1'"), rng.integers(1, 80))) for _ in range(2000)] + ["日本語 text", "\x00\x7f", "it's we'll"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("ids", F.lit("clash")).withColumn("keep", F.lit(1))
    rows = bpe.encode(docs, path, P.PATTERN, decoded="back").collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert list(memoryview(bytes(r.ids)).cast("I")) == want.encode_ordinary(t) and r.n_tokens == len(r.ids) // 4
        assert bytes(r.back) == t.encode() and r.keep == 1
    back = bpe.decode(bpe.encode(docs.drop("ids"), path, P.PATTERN).drop("text"), path)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(docs.filter("false"), path, P.PATTERN).count() == 0


# --- 10 -----------------------------------------------------------------------------------------


def test_statistics_do_not_depend_on_neighbours():
    data, offsets = common.buffers(pa.array(ODD))
    together = quality.statistics(data, offsets)
    for i, t in enumerate(ODD):
        alone = quality.statistics(*common.buffers(pa.array([t], pa.string())))
        assert np.allclose(alone[0], together[i]), t
    assert not np.isnan(together).any() and not together[0].any()


def test_quality(spark):
    rng = np.random.default_rng(10)
    good = lambda: " ".join(rng.choice(["some", "plain", "words", "here."], 30))
    bad = lambda: " ".join(rng.choice(["BUY###", "NOW!!", "$$$", "|"], 30))
    rows = [(i, good() if i % 4 else bad()) for i in range(800)] + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("s_log_bytes", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(800)] + [(None, 1), (3, None), (5, 7)], "doc_id long, quality int")
    train = labels.filter(common.remainder(F.col("doc_id"), 5) != 0)
    model = quality.fit(docs, train, "quality")
    assert model.rules and model == quality.fit(docs.repartition(5), train, "quality")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.3) == (i % 4 > 0) for i in held)
    none = quality.fit(docs, labels.filter("false"), "quality")
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    ones = quality.fit(docs, labels.filter("quality = 1"), "quality")
    assert not ones.rules and quality.score(docs.filter("false"), ones).count() == 0


def test_quality_sample(spark, monkeypatch):
    """More than 8 000 labelled rows are all fitted on."""
    docs = spark.range(9_000).selectExpr("id as doc_id", "concat('w', id) as text")
    monkeypatch.setattr(quality, "fit_rules", lambda x, y: quality.Model(float(len(x)), ((float(len(y)), (("words", True, 0.5),)),)))
    assert quality.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"), "quality") == quality.Model(9_000.0, ((9_000.0, (("words", True, 0.5),)),))


def test_quality_fit_is_whole(monkeypatch):
    """48 trees, 250 rounds, and the penalty with the least loss, however near a stronger one is."""
    rng = np.random.default_rng(3)
    x, y = rng.random((400, len(quality.STATISTICS))), (np.arange(400) % 2).astype(float)
    trees, used = [], []
    real = quality._tree
    monkeypatch.setattr(quality, "_tree", lambda *a: trees.append(1) or real(*a))

    def nearer(x, *args):  # a stronger penalty is a little worse, within any standard error
        penalty = next(a for a in args if isinstance(a, float))
        used.append(penalty)
        return (penalty, np.zeros(x.shape[1]))

    rounds = quality._lasso.__defaults__[-1]
    monkeypatch.setattr(quality, "_lasso", nearer)
    y[:] = rng.permutation(y)
    quality.fit_rules(x, y)
    assert len(trees) == 48 and rounds == 250 and used[-1] != quality.PENALTIES[0]


def test_lasso_in_blocks():
    """A fit on rows of a boolean matrix, a block at a time, is the fit on their dense copy."""
    rng = np.random.default_rng(4)
    x, rows = rng.random((1500, 7)) < 0.4, np.arange(0, 1500, 2)
    y = (x[rows, 0] ^ (rng.random(len(rows)) < 0.2)).astype(float)
    bias, w = quality._lasso(x, rows, y, 0.001, (0.0, np.zeros(7)))
    p = 1 / (1 + np.exp(-(x[rows] @ w.astype(float) + bias)))
    slope = x[rows].T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 1e-4 and all(abs(g + 0.001 * np.sign(v)) < 2e-4 if v else abs(g) < 0.0012 for g, v in zip(slope, w))


def brute_tree_paths(codes, grad, hess, features):
    """Every split tried at every node, one row at a time."""
    paths, out = [], np.zeros(len(grad))

    def worth(rows):
        return sum(grad[r] for r in rows) ** 2 / (sum(hess[r] for r in rows) + 1)

    def grow(path, rows):
        if path:
            paths.append(tuple(sorted(path)))
        best = (1e-6, None, None)
        if len(path) < quality.DEPTH and len(rows) >= 2 * quality.MIN_LEAF:
            for f in features:
                for b in range(quality.BINS):
                    low, high = [r for r in rows if codes[r, f] <= b], [r for r in rows if codes[r, f] > b]
                    if min(len(low), len(high)) >= quality.MIN_LEAF:
                        gain = worth(low) + worth(high) - worth(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, b)
        _, f, b = best
        if f is None:
            out[rows] = -quality.SHRINK * sum(grad[r] for r in rows) / (sum(hess[r] for r in rows) + 1)
            return
        grow(path + ((f, True, b),), [r for r in rows if codes[r, f] > b])
        grow(path + ((f, False, b),), [r for r in rows if codes[r, f] <= b])

    grow((), list(range(len(grad))))
    return sorted(paths), out


def test_tree_paths_against_brute_force():
    rng = np.random.default_rng(3)
    n = 12 * quality.MIN_LEAF
    codes = rng.integers(0, quality.BINS, (n, 4))
    grad = np.where(codes[:, 1] > 5, 0.5, -0.5) + np.where((codes[:, 2] > 9) & (codes[:, 0] > 3), 0.4, 0) + rng.normal(0, 0.1, n)
    hess = rng.uniform(0.1, 0.25, n)
    paths, out = quality._tree(codes, grad, hess, np.arange(4))
    want_paths, want_out = brute_tree_paths(codes, grad, hess, range(4))
    assert sorted(tuple(sorted(p)) for p in paths) == want_paths and len(paths) > 4
    assert np.allclose(out, want_out)


@pytest.mark.parametrize("penalty", [0.3, 0.02, 0.004])
def test_lasso_is_optimal(penalty):
    """At the optimum a zero weight's slope is within the penalty, another's is at it."""
    rng = np.random.default_rng(5)
    x = rng.random((600, 30)) < 0.4
    y = (rng.random(600) < 1 / (1 + np.exp(-(2.0 * x[:, 3] - 1.5 * x[:, 7] + x[:, 11] - 0.3)))).astype(float)
    bias, w = quality._lasso(x, np.arange(600), y, penalty, (0.0, np.zeros(30)), rounds=5000)
    r = (1 / (1 + np.exp(-(x @ w.astype(float) + bias))) - y) / 600
    slope = x.T @ r
    assert abs(r.sum()) < 1e-3
    assert (np.abs(slope[w == 0]) <= penalty + 1e-3).all() and np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-3)
    assert (w == 0).sum() > {0.3: 29, 0.02: 15, 0.004: 3}[penalty]


def test_rules_as_columns_against_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 0) > 0).astype(float)
    model = quality.fit_rules(x, y)
    assert len(model.rules) > 5
    at = {s: i for i, s in enumerate(quality.STATISTICS)}
    z = np.full(400, model.bias)
    for weight, terms in model.rules:
        fits = np.ones(400, bool)
        for name, above, cut in terms:
            fits &= x[:, at[name]] > cut if above else x[:, at[name]] <= cut
        z += weight * fits
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, " + ", ".join(f"s_{s} double" for s in quality.STATISTICS))
    got = np.array([r.p for r in rows.select("i", model.column().alias("p")).orderBy("i").collect()])
    want = 1 / (1 + np.exp(-z))
    assert np.allclose(got, want) and ((got > 0.5) == (y > 0.5)).mean() > 0.9


# --- the registered queries on the given tables --------------------------------------------

TABLES = "/root/testdata/{}"
given = pytest.mark.skipif(not os.path.isdir(TABLES.format("sf0.001")), reason="no test tables here")


def documents(sf):
    return pq.read_table(f"{TABLES.format(sf)}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()


@given
def test_held_out_languages(spark):
    lang = {r["doc_id"]: r["lang"] for r in documents("sf0.01")}
    got = [r for r in language.op4_language(spark, TABLES.format("sf0.01")).collect() if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(got) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.98 * len(got)


@given
def test_held_out_quality(spark):
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{TABLES.format('sf0.01')}/labels.parquet").to_pylist()}
    rows = quality.op10_quality(spark, TABLES.format("sf0.01")).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r["doc_id"] for r in documents("sf0.01"))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    got = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for s, y in got if y == 1], [s for s, y in got if y == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) >= 0.97
    assert sum((s >= 0.3) == (y == 1) for s, y in got) >= 0.93 * len(got)


@given
def test_suffix_tree_query(spark):
    docs = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in documents("sf0.001")]
    want, kept = brute_tree(docs, suffix_tree.DEPTH)
    assert {len(c) for c in kept} == {1, 2}
    rows = suffix_tree.op1_suffix_tree_lm(spark, TABLES.format("sf0.001")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base, score, n, known, total = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9) and r.score == pytest.approx(score, rel=1e-9)


@given
def test_bpe_query(spark):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    text = {r["doc_id"]: r["text"] or "" for r in documents("sf0.001")}
    rows = bpe.op7_byte_bpe(spark, TABLES.format("sf0.001")).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        ids = enc.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
