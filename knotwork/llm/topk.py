"""Operator 9: exact top-k inner-product search with an impact-ordered index.

The vectors' integer components are the impacts. index() packs the rows of a partition into
blocks, each an inverted index: postings (slot, dimension, impact), grouped into segments by
the size class of the impact, largest class first. search() meets every chunk of queries with
every block and works score at a time: segment after segment is added to the scores of all
queries. After each segment the rest bounds what any score can still change (Cauchy-Schwarz on
the part of a vector not yet added). A block is left only when that bound proves, against the
k-th best score found before and in this block, that few enough vectors can still be among the
k best; these are then scored exactly in integers. The k best of each group of blocks are merged
per query.

Vectors that are null or hold null or non-finite components, and rows with a null id, take no
part. Shorter vectors count as padded with zeros; empty ones score 0. A query's own row is any
row with its id. Repeated rows are ranked each for itself; repeated query rows each get their
own k rows. Ties go to the smaller id. An empty table gives no rows; where fewer than k
candidates exist, all are returned. Extra columns are ignored. Scores must fit into 64 bits; beyond that
search() fails rather than wrap around."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Vectors in a block and queries in a chunk at most; a task holds one of each.
BLOCK, CHUNK = 4096, 4096
#: Queries scored at once against a block.
STRIP = 512
#: Blocks, and chunks, that a task meets at most, unless there are too few to keep all cores busy.
GROUP = 16
_SEGMENTS = "block long, ids binary, width int, starts binary, slots binary, dims binary, impacts binary"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    return F.coalesce(F.isnotnull(vector) & F.forall(vector, lambda x: F.isnotnull(x) & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _narrow(x: np.ndarray) -> bytes:
    """The integers with the fewest bytes that hold them, after a byte with their width."""
    for kind in (np.int8, np.int16, np.int32, np.int64):
        if not len(x) or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()
    raise AssertionError


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"i{raw[0]}", offset=1).astype(np.int64)


def _classes(x: np.ndarray) -> np.ndarray:
    """Size class of each impact: 0 for 0, else 1 + log4 of its size."""
    size = np.abs(x)
    out = np.zeros(x.shape, np.int8)
    step = 1
    while (more := size >= step).any():
        out += more
        if step > 1 << 60:
            break
        step *= 4
    return out


def index(vectors: DataFrame, vec_id: str, impacts: str, block: int = BLOCK) -> DataFrame:
    """Blocks of up to `block` rows, each with its postings by descending impact class."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        ids, rows = [], []

        def pack():
            width = max(len(r) for r in rows)
            x = np.zeros((len(rows), width), np.int64)
            for i, r in enumerate(rows):
                x[i, : len(r)] = r
            c = _classes(x).ravel()
            at = np.flatnonzero(c)
            at = at[np.argsort(-c[at], kind="stable")]
            top = int(c.max(initial=0))
            starts = np.searchsorted(-c[at], -np.arange(top, -1, -1))  # starts[i]: of class top - i
            slots, dims = np.divmod(at, max(width, 1))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([(task << 32) + made], pa.int64()), "ids": [np.array(ids, np.int64).tobytes()], "width": pa.array([width], pa.int32()), "starts": [starts.astype(np.int64).tobytes()],
                "slots": [_narrow(slots)], "dims": [_narrow(dims)], "impacts": [_narrow(x.ravel()[at])],
            })

        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.array([len(v) for v in lists], np.int64)) if len(lists) else []
            for i, key in enumerate(batch.column(0).to_pylist()):
                ids.append(key)
                rows.append(flat[ends[i - 1] if i else 0 : ends[i]].copy())
                if len(ids) == block:
                    yield pack()
                    made += 1
                    ids.clear()
                    rows.clear()
        if ids:
            yield pack()

    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(impacts).cast("array<long>").alias("impacts")).mapInArrow(run, _SEGMENTS)


class _Postings:
    """A block as read: exact vectors, and posting segments by descending impact class, each with
    the norms of what the classes after it hold. A segment that fills its matrix is kept as one,
    any other as the postings of each dimension."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        starts = np.frombuffer(row["starts"], np.int64)
        slots, dims, impacts = (_wide(row[c]) for c in ("slots", "dims", "impacts"))
        self.width = max(row["width"], 1)
        self.exact = np.zeros((len(self.ids), self.width), np.int64)
        self.exact[slots, dims] = impacts
        self.most = float(np.abs(impacts).max(initial=0))
        self.segments, self.rest = [], []
        left = np.bincount(slots, impacts.astype(float) ** 2, len(self.ids))
        for i in range(len(starts) - 1):
            at = slice(starts[i], starts[i + 1])
            if starts[i + 1] > starts[i]:
                self.segments.append((slots[at], dims[at], impacts[at]))
                left = left - np.bincount(slots[at], impacts[at].astype(float) ** 2, len(self.ids))
                self.rest.append(np.sqrt(np.maximum(left, 0)))
        if self.rest:
            self.rest[-1] = np.zeros(len(self.ids))
        self.dense: dict = {}

    def add(self, score: np.ndarray, q: np.ndarray, i: int) -> None:
        """Add the products of segment i with the queries' weights."""
        slots, dims, impacts = self.segments[i]
        if len(slots) * 8 >= self.exact.size:
            if (i, q.dtype) not in self.dense:
                m = np.zeros((self.width, len(self.ids)), q.dtype)
                m[dims, slots] = impacts
                self.dense[i, q.dtype] = m
            score += q[:, : self.width] @ self.dense[i, q.dtype]
            return
        order = np.argsort(dims, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(dims[order])) + 1):
            if len(part):  # a slot occurs once in a dimension
                score[:, slots[part]] += np.outer(q[:, dims[part[0]]], impacts[part].astype(q.dtype))


class _Best:
    """The k best rows so far of each query of a chunk."""

    def __init__(self, chunk: _Postings, k: int):
        self.chunk, self.k = chunk, k
        self.bar = np.full(len(chunk.ids), -np.inf)  # the k-th best score, once there are k
        none = np.zeros(0, np.int64)
        self.rows, self.ids, self.scores = none, none, none

    def meet(self, block: _Postings) -> None:
        width = max(block.width, self.chunk.width)
        most = block.most * self.chunk.most * width
        if most >= 1 << 63:
            raise OverflowError("scores don't fit into 64 bits")
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else None
        n = len(self.chunk.ids)
        exact_q, exact_x = (np.pad(p.exact, ((0, 0), (0, width - p.width))) for p in (self.chunk, block))
        rows, cols = [], []
        for at in range(0, n, STRIP):
            own = self.chunk.ids[at : at + STRIP, None] == block.ids[None]
            if kind is None:  # integers too large for floats: score them all
                maybe = ~own
            else:
                maybe = self._possible(block, exact_q[at : at + STRIP].astype(kind), own, self.bar[at : at + STRIP])
            r, c = np.nonzero(maybe)
            rows.append(r + at)
            cols.append(c)
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        score = np.empty(len(rows), np.int64)
        for s in range(0, len(rows), 1 << 16):
            score[s : s + (1 << 16)] = (exact_q[rows[s : s + (1 << 16)]] * exact_x[cols[s : s + (1 << 16)]]).sum(1)
        rows, ids, score = np.append(self.rows, rows), np.append(self.ids, block.ids[cols]), np.append(self.scores, score)
        order = np.lexsort((ids, -score, rows))
        rows, ids, score = rows[order], ids[order], score[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < self.k
        self.rows, self.ids, self.scores = rows[keep], ids[keep], score[keep]
        last = np.searchsorted(self.rows, np.arange(n), side="right") - 1
        full = np.bincount(self.rows, minlength=n) == self.k
        self.bar[full] = self.scores[last[full]]

    def _possible(self, block: _Postings, q: np.ndarray, own: np.ndarray, bar: np.ndarray) -> np.ndarray:
        """Which rows of the block can still be among the k best of which queries."""
        score = np.zeros(own.shape, q.dtype)
        norm = np.sqrt((q.astype(float) ** 2).sum(1))
        maybe = ~own
        for i in range(len(block.segments)):
            block.add(score, q, i)
            rest = np.outer(norm, block.rest[i]).astype(q.dtype) * q.dtype.type(1.0001)
            reach = bar
            if own.shape[1] > self.k:  # the block's own k-th best proves a bar, too
                low = np.where(own, -np.inf, score - rest)
                reach = np.maximum(bar, -np.partition(-low, self.k - 1, axis=1)[:, self.k - 1])
            maybe = (score + rest >= reach[:, None]) & ~own
            if (maybe.sum(1) <= 4 * self.k).all():
                break
        return maybe


def _numbered(blocks: DataFrame, name: str) -> DataFrame:
    """blocks with 0, 1, ... in `name`; only their ids, one for some thousands of rows, are ordered."""
    place = blocks.select("block").withColumn(name, (F.row_number().over(Window.orderBy("block")) - 1).cast("int"))
    return blocks.join(place, "block")


def search(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each query row. blocks and
    queries come from index(). Groups of query chunks, a stated set, meet groups of blocks, each
    pair of groups in a task: a block is copied once for a group of chunks, and a chunk's k best
    from one block are the bar for the next."""
    spark = blocks.sparkSession
    blocks, chunks = stored(blocks, "blocks"), stored(queries, "queries")
    n_blocks, n_chunks = blocks.count(), chunks.count()
    if not n_chunks or not n_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    c_groups = -(-n_chunks // GROUP)
    b_groups = max(-(-n_blocks // GROUP), min(n_blocks, -(-spark.sparkContext.defaultParallelism // c_groups)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _numbered(blocks, "no").withColumn("b", F.col("no") % b_groups).drop("no").withColumn("c", every(c_groups))
    right = _numbered(chunks, "no").withColumn("c", F.col("no") % c_groups).drop("no").withColumn("b", every(b_groups))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        met = [_Best(_Postings(row), k) for row in _rows(right)]
        for row in _rows(left):
            block = _Postings(row)
            for best in met:
                best.meet(block)
        out = {"query_id": [np.zeros(0, np.int64)], "own": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "score": [np.zeros(0, np.int64)]}
        for best, number in zip(met, right.column("block").to_pylist()):
            for name, x in (("query_id", best.chunk.ids[best.rows]), ("own", (number << 13) + best.rows), ("vec_id", best.ids), ("score", best.scores)):
                out[name].append(x)
        return pa.table({name: np.concatenate(x) for name, x in out.items()})

    sizes = "query_id long, own long, vec_id long, score long"
    found = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(run, sizes)
    w = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rows(group: pa.Table):
    for i in range(group.num_rows):
        yield group.slice(i, 1).to_pylist()[0]


# --- query ---------------------------------------------------------------------------


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows by integer inner product for each row whose vec_id 20 divides."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter(F.isnotnull("vec_id") & usable(F.col("embedding")))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double"))).alias("impacts"))
    asked = rows.filter(F.pmod("vec_id", F.lit(20)) == 0)
    n = max(1, -(-asked.count() // CHUNK))
    return search(index(rows, "vec_id", "impacts"), index(asked.repartition(n), "vec_id", "impacts", CHUNK), 20)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
