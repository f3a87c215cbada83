"""Operator 6: MinHash near-duplicates with odd sketches.

Each text is the set of its distinct five-word shingles (fewer words: the whole sequence as
one). Texts with equal sets form a class at once, so copies are never compared. Each class has
BANDS * ROWS MinHash samples: ROWS samples make a band key, classes with a common key are
candidates, and all samples folded into a parity bitmap make the odd sketch: the population
count of two sketches' XOR estimates how many samples differ. Candidates whose estimate is
clearly too low are dropped, the rest are confirmed on their full sets: intersection / union
>= 0.75.

Only links that can still join two components are confirmed. First every class tries the
likeliest of its buckets' least members; then the likeliest member of another component in its
part of a bucket (a bucket is cut into parts of bounded size). Components that still have
likely candidates in each other are tested further: of a pair that is similar enough, the larger
set's rarest shingles and the smaller one's have one in common (prefix filter, exact under any
order of the shingles), so only members that share such a shingle with a member of another
component take part, and form families. Within a family, every member outside the largest
component is held against every member, in blocks of full sets, and each block reports only
links that join components: so no candidate pair is left untested, and none is written down. A
pair at similarity 0.75 misses all bands with probability (1 - 0.75 ** ROWS) ** BANDS = 2e-5,
closer ones less. A bucket, class or component with very many members is cut into parts
wherever it is joined.

Null, empty or blank texts have no shingles and are linked with nothing. Rows with a null id
get no component and are never linked. Rows that repeat an id are one node with all their
texts' links. Ties cannot occur: the component is its least id. An empty table gives an empty
result. Texts are taken whole at any length. Extra columns are ignored by link() and carried
through by keep_one()."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, mix, randoms, salted, share_of, shingle_hashes, slices, stored, table, word_hashes
from .components import components

SIZE, BANDS, ROWS, BITS = 5, 40, 5, 1024
SAMPLES = BANDS * ROWS
#: Estimates below this (four standard deviations under 0.75) are dropped without a full look.
LEAST_ESTIMATE = 0.58
BLOCK = 128
#: Rows of buckets in a task that holds members against each other.
TASK_ROWS = 10_000
#: Counters for how common a shingle is; shingles that share one only blur the order.
SLOTS = 1 << 18
_U = np.uint64
_A = randoms(SAMPLES, 61) | _U(1)
_KEY = randoms(SAMPLES, 62) | _U(1)
_FOLD = randoms(SAMPLES, 63)


def most_differing(similarity: float) -> int:
    """The expected XOR count of two sketches at a similarity."""
    differ = 2 * SAMPLES * (1 - similarity)
    return round(BITS / 2 * (1 - np.exp(-2 * differ / BITS)))


# --- per text ----------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, and the texts' offsets."""
    words, woff = word_hashes(data, offsets)
    h, off = shingle_hashes(words, woff, SIZE)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, row)) if len(off) < 40 else np.argsort(h, kind="stable")
    if len(off) >= 40:
        order = order[np.argsort(row[order], kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(off))).astype(np.int64)


def sketch_of(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys [text, BANDS] and odd sketches [text, BITS / 64] of non-empty sets."""
    n = len(off) - 1
    samples = np.empty((SAMPLES, n), _U)
    for i in range(SAMPLES):
        samples[i] = np.minimum.reduceat(sets * _A[i], off[:-1])
    keyed = (mix(samples) * _KEY[:, None]).reshape(BANDS, ROWS, n).sum(1, dtype=_U)
    keys = mix(keyed + np.arange(BANDS, dtype=_U)[:, None])
    bit = (mix(samples ^ _FOLD[:, None]) % _U(BITS)).astype(np.int64)
    odd = np.bincount((bit + np.arange(n) * BITS).ravel(), minlength=n * BITS) & 1
    packed = np.packbits(odd.astype(np.uint8).reshape(n, BITS), axis=1)
    return keys.T, np.ascontiguousarray(packed).view(np.int64)


_SIGNED = "id long, n long, f1 long, f2 long, keys array<bigint>, sketch array<bigint>"


def _lists(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, n, f1, f2, keys, sketch) of each row; f1 and f2 identify its set."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                sets, off = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(off)
                has = np.flatnonzero(n)
                f1, f2 = np.zeros(len(n), _U), np.zeros(len(n), _U)
                keys, sketch = np.zeros((len(n), BANDS), _U), np.zeros((len(n), BITS // 64), np.int64)
                if len(has):
                    own = np.concatenate([off[:-1][has], off[-1:]])
                    f1[has] = np.add.reduceat(mix(sets), own[:-1])
                    f2[has] = np.add.reduceat(mix(sets ^ _FOLD[0]), own[:-1])
                    keys[has], sketch[has] = sketch_of(sets, own)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), _lists(keys), _lists(sketch)], names=["id", "n", "f1", "f2", "keys", "sketch"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, _SIGNED)


# --- confirmation ------------------------------------------------------------------------


def _packed_sets(docs: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(rep, set): the sets of classes(rep, n, f1, f2), 48 bits of each hash, sorted."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                sets, off = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                short = (sets >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6]
                raw = [short[off[k] : off[k + 1]].tobytes() for k in range(len(off) - 1)]
                # f1 tells the texts of a repeated id apart
                has = np.flatnonzero(np.diff(off))
                f1 = np.zeros(len(off) - 1, _U)
                if len(has):
                    f1[has] = np.add.reduceat(mix(sets), off[:-1][has])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(f1.view(np.int64)), pa.array(raw, pa.binary())], names=["rep", "f1", "set"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).join(classes.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi")
    found = rows.mapInArrow(run, "rep long, f1 long, set binary")
    return found.join(classes.select("rep", "f1", "cid"), ["rep", "f1"]).groupBy("cid").agg(F.first("set").alias("set"))


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(_U).ravel()


def confirmed(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Those of pairs(x, y) whose sets have denominator * intersection >= numerator * union."""
    side = lambda c: sets.select(F.col("cid").alias(c), F.col("set").alias(f"{c}s"))
    both = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y")

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("xs"), batch.column("ys")):
                u = np.concatenate([_unpacked(a.as_py()), _unpacked(b.as_py())])
                u.sort()
                shared = int((u[1:] == u[:-1]).sum())
                keep.append(denominator * shared >= numerator * (len(u) - shared))
            part = batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))
            if part.num_rows:
                yield part

    return both.select("x", "y", "xs", "ys").mapInArrow(run, "x long, y long")


# --- candidates ----------------------------------------------------------------------------


def _differing(a: str, b: str):
    out = F.lit(0)
    for i in range(BITS // 64):
        out = out + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return out


def _likely(numerator: int, denominator: int):
    """Sizes of xn and yn that allow the similarity, and a sketch distance that speaks for it."""
    return (F.col("differ") <= most_differing(LEAST_ESTIMATE)) & (F.least("xn", "yn") * denominator >= F.greatest("xn", "yn") * numerator)


def _first_links(buckets: DataFrame, n: int, classes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(x, y): for each class the likeliest of the least members of its buckets, of n rows."""
    least = buckets.groupBy("key").agg(F.min("cid").alias("y"), F.count("*").alias("c"))
    met = salted(buckets, least, ["key"], "cid", "c", share_of(n)).filter("cid <> y").select(F.col("cid").alias("x"), "y").distinct()
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"{c}n"), F.col("sketch").alias(f"{c}s"))
    seen = met.join(side("x"), "x").join(side("y"), "y").select("x", "y", "xn", "yn", _differing("xs", "ys").alias("differ")).filter(_likely(numerator, denominator))
    return seen.groupBy("x").agg(F.min(F.struct("differ", "y")).alias("b")).select("x", "b.y")


def _column(x, name: str) -> np.ndarray:
    return x.field(name).to_numpy()


def _parts(buckets: DataFrame, n: int, classes: DataFrame, label: DataFrame) -> DataFrame:
    """(key, part, parts, least, m): the members of buckets (n rows) with several components, in parts."""
    named = classes.select("cid", "n", "sketch").join(label, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
    where = buckets.join(named.select("cid", "comp"), "cid")
    several = where.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("least"), F.max("comp").alias("hi")).filter("least <> hi").select("key", "least", "c", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts"))
    members = salted(buckets, several, ["key"], "cid", "c", share_of(n)).join(named, "cid").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    # parts are small but much work: tasks follow their rows, not their bytes
    members = members.repartition(-(-n // TASK_ROWS) or 1, "key", "part")
    return members.groupBy("key", "part", "parts", "least").agg(F.collect_list(F.struct("cid", "comp", "n", "sketch")).alias("m")).select("parts", "least", "m")


def _near(flat, room: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members, components, XOR counts, and which pairs are likely and of two components."""
    cid, comp, n = (_column(flat, c) for c in ("cid", "comp", "n"))
    sketch = flat.field("sketch").flatten().to_numpy().view(_U).reshape(-1, BITS // 64)
    differ = np.zeros((len(cid), len(cid)), np.int16)
    for k in range(BITS // 64):
        differ += np.bitwise_count(sketch[:, None, k] ^ sketch[None, :, k])
    ok = (differ <= most_differing(LEAST_ESTIMATE)) & (comp[:, None] != comp[None]) & (np.minimum(n[:, None], n[None]) * room[1] >= np.maximum(n[:, None], n[None]) * room[0])
    return cid, comp, differ, ok


def _likeliest(parts: DataFrame, room: tuple[int, int]) -> DataFrame:
    """(x, y): for each class the likeliest class of another component in its parts."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cid, _, differ, ok = _near(batch.slice(i, 1).column("m").flatten(), room)
                has = np.flatnonzero(ok.any(1))
                if len(has):
                    best = np.where(ok[has], differ[has], 32_000).argmin(1)
                    yield pa.RecordBatch.from_arrays([pa.array(cid[has]), pa.array(cid[best]), pa.array(differ[has, best].astype(np.int64))], names=["x", "y", "differ"])

    best = parts.select("m").mapInArrow(run, "x long, y long, differ long").groupBy("x").agg(F.min(F.struct("differ", "y")).alias("b"))
    return best.select(F.greatest("x", "b.y").alias("x"), F.least("x", "b.y").alias("y")).distinct()


def _related(parts: DataFrame, room: tuple[int, int]) -> DataFrame:
    """(u, v): components with likely candidates in each other, linked within each part to the
    least one; of buckets with several parts, every component to the bucket's least."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                flat = row.column("m").flatten()
                if row.column("parts")[0].as_py() > 1:
                    u = np.unique(_column(flat, "comp"))
                    v = np.full(len(u), row.column("least")[0].as_py())
                else:
                    _, comp, _, ok = _near(flat, room)
                    a, b = np.nonzero(ok)
                    u, v = np.unique(np.stack([np.maximum(comp[a], comp[b]), np.minimum(comp[a], comp[b])]), axis=1)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return parts.mapInArrow(run, "u long, v long").filter("u <> v").distinct()


def _common(sets: DataFrame) -> np.ndarray:
    """How often each slot of shingles occurs in sets; SLOTS numbers."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for raw in batch.column("set"):
                total += np.bincount((_unpacked(raw.as_py()) % _U(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "c"])

    counted = sets.select("set").mapInArrow(run, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[counted.column("slot").to_numpy()] = counted.column("c").to_numpy()
    return out


def _prefixes(members: DataFrame, common: np.ndarray, numerator: int, denominator: int) -> DataFrame:
    """(family, h, cid, comp, n, short): each member's rarest shingles, so many that the larger
    set of a pair similar enough has one of them in common with the smaller one's `short` ones."""
    order = members.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h = _unpacked(batch.column("set")[i].as_py())
                n = len(h)
                long_, short = n + numerator * n // -denominator + 1, n + 2 * numerator * n // -(denominator + numerator) + 1
                h = h[np.lexsort((h, order.value[(h % _U(SLOTS)).astype(np.int64)]))[:long_]]
                one = lambda c: pa.array(np.full(len(h), batch.column(c)[i].as_py()), pa.int64())  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays([one("family"), pa.array(h.view(np.int64)), one("cid"), one("comp"), pa.array(np.full(len(h), n)), pa.array(np.arange(len(h)) < short)], names=["family", "h", "cid", "comp", "n", "short"])

    return members.select("family", "cid", "comp", "set").mapInArrow(run, "family long, h long, cid long, comp long, n long, short boolean")


def _kin(prefixes: DataFrame, room: tuple[int, int]) -> DataFrame:
    """(cid, null, null) of members that share a prefix shingle with another component's member
    of a fitting size, and (null, u, v) of the components that meet so, linked to the least."""
    several = prefixes.groupBy("family", "h").agg(F.count("*").alias("c"), F.min("comp").alias("least"), F.max("comp").alias("hi"), F.max("short").alias("short")).filter("short and least <> hi").select("family", "h", "c", "least", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts"))
    met = salted(prefixes, several, ["family", "h"], "cid", "c", share_of(prefixes.count())).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    groups = met.groupBy("family", "h", "part", "parts", "least").agg(F.collect_list(F.struct("cid", "comp", "n", "short")).alias("m")).select("parts", "least", "m")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                flat = batch.slice(i, 1).column("m").flatten()
                cid, comp, n = (_column(flat, c) for c in ("cid", "comp", "n"))
                if batch.column("parts")[i].as_py() > 1:  # others of its group stand elsewhere
                    least = batch.column("least")[i].as_py()
                    who, u = cid, np.unique(comp[comp != least])
                    v = np.full(len(u), least)
                else:
                    short = flat.field("short").to_numpy(zero_copy_only=False)
                    small, large = np.minimum(n[:, None], n[None]), np.maximum(n[:, None], n[None])
                    ok = (comp[:, None] != comp[None]) & (small * room[1] >= large * room[0])
                    ok &= np.where(n[:, None] < n[None], short[:, None], np.where(n[:, None] > n[None], short[None], short[:, None] & short[None]))
                    who = cid[ok.any(1)]
                    a, b = np.nonzero(ok)
                    u, v = np.unique(np.stack([np.maximum(comp[a], comp[b]), np.minimum(comp[a], comp[b])]), axis=1)
                if len(who):
                    none = lambda x: pa.nulls(len(x), pa.int64())
                    both = [pa.concat_arrays([pa.array(who), none(u)]), pa.concat_arrays([none(who), pa.array(u, pa.int64())]), pa.concat_arrays([none(who), pa.array(v, pa.int64())])]
                    yield pa.RecordBatch.from_arrays(both, names=["cid", "u", "v"])

    return groups.mapInArrow(run, "cid long, u long, v long").distinct()


def _family_links(families: DataFrame, classes: DataFrame, label: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(x, y): links between components of a family(comp, family), enough to join all that are
    linked. Members outside the largest component meet all members, block by block."""
    known = classes.select("cid").join(label, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
    wide = stored(known.join(families, "comp").join(sets, "cid"), "families")
    kin = stored(_kin(stored(_prefixes(wide, _common(wide), numerator, denominator), "prefixes"), (numerator, denominator)), "kin")
    close = components(kin.filter("cid is null").select("u", "v")).select(F.col("node").alias("comp"), F.col("component").alias("family"))
    members = stored(wide.drop("family").join(kin.select("cid"), "cid", "left_semi").join(close, "comp"), "members")
    size = members.groupBy("family", "comp").agg(F.count("*").alias("c"))
    big = size.groupBy("family").agg(F.max(F.struct("c", F.col("comp").alias("top"))).alias("b"), F.sum("c").alias("all")).select("family", "all", "b.top", F.ceil(F.col("all") / BLOCK).cast("int").alias("parts"), F.ceil((F.col("all") - F.col("b.c")) / BLOCK).cast("int").alias("rows"))
    full = salted(members, big, ["family"], "cid", "all", share_of(members.count()))
    item = F.struct("cid", "comp", "set")
    part = lambda n: F.pmod(F.xxhash64("cid"), F.greatest(F.col(n), F.lit(1))).cast("int")
    all_ = full.withColumn("p", part("parts")).groupBy("family", "p").agg(F.collect_list(item).alias("b"))
    few = full.filter("comp <> top").withColumn("q", part("rows")).groupBy("family", "q").agg(F.first("parts").alias("parts"), F.collect_list(item).alias("a"))
    met = few.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(all_, ["family", "p"]).select("a", "b")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                sides = [row.column(c).flatten() for c in ("a", "b")]
                n = [len(s) for s in sides]
                own = [_unpacked(x.as_py()) for s in sides for x in s.field("set")]
                size = np.array([len(x) for x in own])
                values, place = np.unique(np.concatenate(own), return_inverse=True)
                of = np.repeat(np.arange(len(own)), size)
                shared = np.zeros((n[0], n[1]), np.float32)
                for at in range(0, len(values), 1 << 14):  # incidence of some thousand shingles at a time
                    here = (place >= at) & (place < at + (1 << 14))
                    has = np.zeros((len(own), min(1 << 14, len(values) - at)), np.float32)
                    has[of[here], place[here] - at] = 1
                    shared += has[: n[0]] @ has[n[0] :].T
                comp = [_column(s, "comp") for s in sides]
                union = size[: n[0], None] + size[None, n[0] :] - shared
                ok = (denominator * shared >= numerator * union) & (comp[0][:, None] != comp[1][None])
                x, y = np.nonzero(ok)
                if len(x):
                    cid = [_column(s, "cid") for s in sides]
                    # one link for each pair of components is enough
                    _, first = np.unique(np.stack([comp[0][x], comp[1][y]]), axis=1, return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cid[0][x[first]]), pa.array(cid[1][y[first]])], names=["x", "y"])

    return met.mapInArrow(run, "x long, y long")


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", numerator: int = 75, denominator: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) of each row of docs."""
    rows = stored(signatures(docs, doc_id, text), "signatures")
    useful = rows.filter("n > 0 and id is not null")
    # a class is named by a number of its own, so an id with several texts may stand for several
    named = useful.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("c"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = stored(named.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")
    every = stored(classes.select("cid", F.explode("keys").alias("key")).distinct(), "buckets")
    busy = every.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    buckets = stored(every.join(busy.hint("merge"), "key"), "buckets")  # the same plan at every size
    n = buckets.count()
    mates = stored(classes.drop("keys", "c").join(buckets.select("cid").distinct(), "cid", "left_semi"), "mates")
    sets = stored(_packed_sets(docs, mates, doc_id, text), "sets")
    room = (numerator, denominator)

    def labels(links: DataFrame) -> DataFrame:
        return stored(components(links.select(F.col("x").alias("u"), F.col("y").alias("v"))).withColumnRenamed("node", "cid"), "labels")

    sure = stored(confirmed(_first_links(buckets, n, mates, *room), sets, *room), "links")
    parts = _parts(buckets, n, mates, labels(sure))
    sure = stored(sure.union(confirmed(_likeliest(parts, room), sets, *room)), "links")
    label = labels(sure)
    families = stored(components(_related(_parts(buckets, n, mates, label), room)).select(F.col("node").alias("comp"), F.col("component").alias("family")), "families")
    if not families.isEmpty():
        sure = sure.union(_family_links(families, mates, label, sets, *room))
    # an id with several texts links their classes
    again = useful.groupBy("id").agg(F.count("*").alias("times")).filter("times > 1").select("id")
    own = useful.join(again, "id", "left_semi").select("id", "f1", "f2", "n").distinct().join(classes.select("f1", "f2", "n", "cid"), ["f1", "f2", "n"])
    shared = own.join(own.groupBy("id").agg(F.min("cid").alias("y")), "id").select(F.col("cid").alias("x"), "y").filter("x <> y")
    label = labels(sure.union(shared))
    # a class's component is named by the least id of its classes
    kind = ["f1", "f2", "n"]
    told = stored(classes.select("cid", "rep", "c", *kind).join(label, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "named")
    least = told.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("k"))
    of = salted(told, least, ["component"], "cid", "k", share_of(told.count())).select(*kind, "c", "component_id")
    linked = salted(useful.select("id", *kind), of, kind, "id", "c", share_of(rows.count()))
    alone = rows.filter("not (n > 0 and id is not null)").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked.select("id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component the rows of its least id stay. Rows
    without words or with a null id stay."""
    gone = link(docs, doc_id, text).filter("id <> component_id").select(F.col("id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti")


# --- query ---------------------------------------------------------------------------


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    found = link(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT *, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (WITH RECURSIVE r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT b.y, r.c FROM r JOIN b ON r.v = b.x WHERE r.c < b.y) SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN r ON v = doc_id
"""
