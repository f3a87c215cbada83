"""Operator 2: benchmark decontamination, in DataFrame functions only.

A document leaks an item if some window of the item's size in words has a weighted Jaccard
similarity of `similarity` or more with the item: shingles of five words, weighted by how often
they occur (an item with fewer words is one shingle). Such a window shares with the
items of that size so many shingles that it could be similar enough; windows are laid at all
starts where it does, whatever the shingles' order.
Each window gets a 64-bit SimHash. The items' fingerprints are indexed by blocks: two
fingerprints within `radius` bits agree to within radius // blocks bits in at least one block
(pigeonhole), so every item is entered under all block values that near, and windows look up
their own block values: no item within the radius is missed. Candidates are verified by the
exact weighted similarity.

Null or blank texts and items have no words and match nothing. A document shorter than an
item is one window. Very long texts are taken whole, in steps proportional to their length: of
each shingle only a number is looked up, and windows are cut from the text once. Ties: every
item at the least similarity or above counts. Repeated documents are judged alike, each row once; repeated items all
count, under their own ids; an item with a null id has none to be reported and is left out.
Empty tables give no leaks. Extra columns are carried through by find_leaks() unless they clash
with an output column, which then replaces them. A-Z is lower-cased; words are runs of
non-space characters."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .native import let, words

SHINGLE, SIMILARITY = 5, 0.75
BITS, BLOCKS, RADIUS = 64, 8, 23
#: The items' shingles, and the laid windows, are broadcast up to this many, else shuffled.
BROADCAST_ROWS = 200_000


def shingles(ws: Column, size: int = SHINGLE) -> Column:
    """Hashes of the word shingles in order; fewer words than size: the whole as one."""
    n = F.size(ws)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(ws, i, F.lit(size)))))


def simhash(bag: Column) -> Column:
    """64-bit SimHash of a bag of hashes: each bit is the sign of the summed signs, so it is set
    where more than half of the hashes have it. Four bits, 16 apart, are counted in one number;
    a bag too large for that is counted bit by bit."""
    up = lambda x, n: F.call_function("shiftleft", x, n)
    down = lambda x, n: F.call_function("shiftrightunsigned", x, n)
    zero, one, four = (F.lit(x).cast("long") for x in (0, 1, 0x0001000100010001))

    def sums(places: Column, shift: Column) -> Column:
        return F.aggregate(bag, zero, lambda a, h: a + down(h, shift).bitwiseAND(places))

    def quarter(total: Column, j: Column) -> Column:
        out = zero
        for i in range(0, BITS, 16):
            out = out.bitwiseOR(F.when(down(total, F.lit(i)).bitwiseAND(F.lit(0xFFFF).cast("long")) * 2 > F.size(bag), up(one, j + i)).otherwise(zero))
        return out

    def joined(n: int, part: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), zero, lambda a, j: a.bitwiseOR(part(j)))

    small = joined(16, lambda j: let(sums(four, j), lambda total: quarter(total, j)))
    large = joined(BITS, lambda b: F.when(sums(one, b) * 2 > F.size(bag), up(one, b)).otherwise(zero))
    return F.when(F.size(bag) < 1 << 16, small).otherwise(large)


def block_value(fingerprint: Column, block: Column) -> Column:
    width = BITS // BLOCKS
    return F.call_function("shiftrightunsigned", fingerprint, (block * width).cast("int")).bitwiseAND(F.lit((1 << width) - 1))


def near_masks() -> list[int]:
    """All differences of up to RADIUS // BLOCKS bits in a block."""
    width = BITS // BLOCKS
    return [m for m in range(1 << width) if m.bit_count() <= RADIUS // BLOCKS]


def similarity_of(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags."""

    def times(bag: Column, x: Column) -> Column:
        return F.size(F.filter(bag, lambda y: y == x))

    single = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))
    both = F.when(single, F.size(F.array_intersect(a, b))).otherwise(counted)
    return let(both, lambda m: m / F.greatest(F.size(a) + F.size(b) - m, F.lit(1)))


def shared_shingles(held: int, other: int, similarity: float) -> int:
    """How many shingles bags of these sizes must share to be similar enough."""
    return max(1, math.ceil((held + other) * similarity / (1 + similarity) - 1e-9))


def stride(least: int, similarity: float) -> int:
    """The largest s so that, in a window similar enough to an item of `least` shingles or more,
    the places divisible by s outnumber those that may hold a shingle the item lacks: one of
    them at least holds a shared one, and documents without any such place have no leak."""
    for s in range(math.ceil((1 + similarity) / max(1e-9, 1 - similarity)) - 1, 1, -1):
        bound = math.ceil(1 / (1 / s - (1 - similarity) / (1 + similarity)))  # from here on it holds
        pairs = ((held, other) for held in range(1, bound + 1) for other in range(max(held, least), int(held / similarity + 1e-9) + 1))
        if all(held // s > held - shared_shingles(held, other, similarity) for held, other in pairs):
            return s
    return 1


def window_starts(similarity: float) -> Column:
    """Starts of all windows that hold enough shared shingles to be similar enough, each once;
    from the sorted offsets p of the shingles that a document of k words shares with items of m
    words, in shingles of n words. A start belongs to the first shared shingle at or behind it."""
    k, m, n, p = (F.col(c) for c in ("k", "m", "n", "p"))
    size = F.least(m, k)
    held = size - n + 1
    # as shared_shingles()
    need = F.greatest(F.lit(1), F.ceil((held + m - n + 1) * (similarity / (1 + similarity)) - 1e-9).cast("int"))

    def span(need: Column) -> Column:
        def of(j: Column) -> Column:
            low = F.greatest(F.lit(0), F.get(p, j + need - 1) - held + 1, F.coalesce(F.get(p, j - 1) + 1, F.lit(0)))
            return F.struct(low.alias("low"), F.least(F.get(p, j), k - size).alias("high"))

        found = F.filter(F.transform(F.sequence(F.lit(0), F.size(p) - need), of), lambda s: s["low"] <= s["high"])
        return F.flatten(F.transform(found, lambda s: F.sequence(s["low"], s["high"])))

    return let(need, lambda x: F.when(F.size(p) >= x, span(x)).otherwise(F.array().cast("array<int>")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with leaked (boolean), item_ids (sorted array of the leaked items) and best (the
    highest similarity found, null if none is high enough)."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("leaked", "item_ids", "best")]

    # what is known of an item: few numbers, and the bag of its shingles
    items = benchmark.select(F.col(f"`{item_id}`").alias("item"), words(F.col(f"`{item_text}`")).alias("w")).filter("item is not null and size(w) > 0")
    items = items.select("item", F.size("w").alias("m"), shingles(F.col("w")).alias("bag")).distinct()
    items = stored(items.withColumn("print", simhash(F.col("bag"))), "items")
    anchors = items.select("m", F.least("m", F.lit(SHINGLE)).alias("n"), F.explode("bag").alias("h")).distinct()
    rows = anchors.count()
    least = {n: m for n, m in anchors.groupBy("n").agg(F.min("m")).collect()}  # at most SHINGLE rows
    index = F.broadcast(anchors) if rows <= BROADCAST_ROWS else anchors

    # one pass over the bound words gives the shingle hashes; only numbers are exploded
    found = "array<struct<k:int,at:int,n:int,h:bigint>>"

    def shared(texts: DataFrame, step: dict[int, int]) -> DataFrame:
        """Shingles of (_id, _hash, _raw) that items have, of those at each step-th place."""

        def spots(w: Column, size: int) -> Column:
            places = F.sequence(F.lit(0), F.size(w) - size, F.lit(step[size]))
            here = F.transform(places, lambda i: F.struct(F.size(w).alias("k"), i.alias("at"), F.lit(size).alias("n"), F.xxhash64(F.slice(w, i + 1, F.lit(size))).alias("h")))
            return F.when(F.size(w) >= size, here).otherwise(F.array().cast(found))

        read = let(words(F.col("_raw")), lambda w: F.concat(F.array().cast(found), *[spots(w, n) for n in sorted(step)]))
        # inlined as it stands: a filter inferred from a column would compute it once more
        return texts.select("_id", "_hash", F.inline(read)).join(index, ["h", "n"])

    base = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"), F.col(f"`{text}`").alias("_raw"))
    step = {n: stride(m - n + 1, similarity) for n, m in least.items()}
    suspects = stored(shared(base, step).select(F.col("_id").alias("_i"), F.col("_hash").alias("_h")).distinct(), "suspects")
    few = suspects.count() <= BROADCAST_ROWS
    hits = shared(base.join(F.broadcast(suspects) if few else suspects, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left_semi"), dict.fromkeys(step, 1))
    hits = hits.groupBy("_id", "_hash", "m", "n", "k").agg(F.sort_array(F.collect_set("at")).alias("p"))
    starts = hits.select("_id", "_hash", "m", F.explode(window_starts(similarity)).alias("first"))
    spot = stored(starts.groupBy("_id", "_hash").agg(F.collect_list(F.struct("m", "first")).alias("spots")).withColumnsRenamed({"_id": "_i", "_hash": "_h"}), "windows")
    laid = spot.agg(F.sum(F.size("spots"))).first()[0] or 0
    texts = base.join(F.broadcast(spot) if laid <= BROADCAST_ROWS else spot, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")))
    cut = let(words(F.col("_raw")), lambda w: F.transform("spots", lambda s: F.struct(s["m"].alias("m"), s["first"].alias("first"), F.slice(w, s["first"] + 1, s["m"]).alias("win"))))
    windows = texts.select("_id", "_hash", F.explode(cut).alias("s")).groupBy("_id", "_hash", F.col("s.m").alias("m"), F.col("s.first").alias("first")).agg(F.first("s.win").alias("win"))
    # written, so that no filter of the join below computes the fingerprints again
    windows = stored(windows.select("_id", "_hash", "m", shingles(F.col("win")).alias("bag")).withColumn("print", simhash(F.col("bag"))), "prints")

    # multi-index: an entry for each block and each value near the item's own
    blocks = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    masks = F.array(*[F.lit(x).cast("long") for x in near_masks()])
    entries = items.select("item", "m", F.col("bag").alias("item_bag"), F.col("print").alias("item_print"), F.explode(blocks).alias("block"))
    entries = entries.withColumn("value", F.explode(F.transform(masks, lambda x: block_value(F.col("item_print"), F.col("block")).bitwiseXOR(x))))
    asked = windows.withColumn("block", F.explode(blocks)).withColumn("value", block_value(F.col("print"), F.col("block")))
    near = asked.join(entries, ["m", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    # a pair met in several blocks is verified in the first of them
    agrees = [F.bit_count(block_value(F.col("print").bitwiseXOR(F.col("item_print")), F.lit(b))) <= RADIUS // BLOCKS for b in range(BLOCKS)]
    first_block = F.coalesce(*[F.when(x, F.lit(b)) for b, x in enumerate(agrees)])
    sure = near.filter(F.col("block") == first_block).withColumn("sim", similarity_of(F.col("bag"), F.col("item_bag"))).filter(F.col("sim") >= similarity)
    leaks = sure.groupBy("_id", "_hash").agg(F.sort_array(F.collect_set("item")).alias("item_ids"), F.max("sim").alias("best")).withColumnsRenamed({"_id": "_i", "_hash": "_h"})

    # the columns carried along stand in one struct, so no name can clash
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    out = docs.select(row.alias("_row"), F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"))
    out = out.join(leaks, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left")
    empty = F.array().cast(leaks.schema["item_ids"].dataType)
    return out.select(*[F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(kept)], F.isnotnull("item_ids").alias("leaked"), F.coalesce("item_ids", empty).alias("item_ids"), "best")


# --- query ---------------------------------------------------------------------------


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, the benchmark items that it leaks (their ids, joined by commas)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "leaked", F.size("item_ids").cast("long").alias("n_items"), F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"), F.round("best", 6).alias("best"))


#: Every window of an item's size is tried, at every start; those without a common shingle have
#: similarity 0.
_W = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
SQL = f"""
WITH i AS (SELECT item_id, w, len(w) AS m, least(len(w), 5) AS n FROM (SELECT item_id, {_W} AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
ia AS (SELECT item_id, m, n, o, array_to_string(w[o + 1 : o + n], ' ') AS s FROM (SELECT *, unnest(range(0, m - n + 1)) AS o FROM i)),
ib AS (SELECT item_id, s, count(*) AS c FROM ia GROUP BY ALL),
d AS (SELECT doc_id, w, len(w) AS k FROM (SELECT doc_id, {_W} AS w FROM documents)),
da AS (SELECT doc_id, k, p, n, array_to_string(w[p + 1 : p + n], ' ') AS s FROM (SELECT d.*, z.n, unnest(range(0, k - z.n + 1)) AS p FROM d, (SELECT DISTINCT n FROM i) z)),
hit AS (SELECT DISTINCT doc_id, item_id, m, n, least(m, k) AS z, k, p, s FROM da JOIN ia USING (s, n)),
wb AS (SELECT doc_id, item_id, m, n, z, f, s, count(*) AS c FROM (SELECT *, unnest(range(greatest(0, p + n - z), least(p, k - z) + 1)) AS f FROM hit) GROUP BY ALL),
mn AS (SELECT doc_id, item_id, m, n, z, f, sum(least(wb.c, ib.c)) AS x FROM wb JOIN ib USING (item_id, s) GROUP BY ALL),
ok AS (SELECT doc_id, item_id, max(x / ((z - n + 1) + (m - n + 1) - x)) AS sim FROM mn GROUP BY ALL HAVING sim >= 0.75),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, max(sim) AS best FROM ok GROUP BY doc_id)
SELECT documents.doc_id, g.doc_id IS NOT NULL AS leaked, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, round(best, 6) AS best
FROM documents LEFT JOIN g USING (doc_id)
"""
