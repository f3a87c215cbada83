"""Trimming: components of one and two vertices, found from degrees alone.

All functions take active(v, color) and edges(src, dst, color): the edges between active
vertices of one color, loops and copies removed (see restrict)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..loop import cut, discard


def restrict(edges: DataFrame, active: DataFrame) -> DataFrame:
    """The different edges inside one color of the active vertices, without loops."""
    a = active.select(F.col("v").alias("src"), F.col("color").alias("_a"))
    b = active.select(F.col("v").alias("dst"), F.col("color").alias("_b"))
    return edges.select("src", "dst").filter("src <> dst").distinct().join(a, "src").join(b, "dst").filter("_a = _b").select("src", "dst", F.col("_a").alias("color"))


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that don't touch the vertices gone(v)."""
    g = gone.select(F.col("v").alias("_g"))
    return edges.join(g, F.col("src") == F.col("_g"), "left_anti").join(g, F.col("dst") == F.col("_g"), "left_anti")


def trim1_once(active: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, trimmed): a vertex without an in- or an out-neighbour is a component."""
    out, into = edges.select(F.col("src").alias("v")).distinct(), edges.select(F.col("dst").alias("v")).distinct()
    kept = active.join(out, "v", "left_semi").join(into, "v", "left_semi")
    return kept, active.join(kept.select("v"), "v", "left_anti").select("v", F.col("v").alias("scc"))


#: A plan's passes end when one removes no more than this; what is left, later phases find.
TRIM_STOP = 100
#: Share of the vertices that must be gone before vertices and edges are written anew.
COMPACT_SHARE = 0.1


def trim1(active: DataFrame, edges: DataFrame, stop: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Repeat trim1_once while a pass removes more than stop vertices: (active, edges, resolved,
    how many). A pass writes only what it removes; the rest is written when a tenth has gone."""
    room = active.count() * COMPACT_SHARE
    resolved, since, total, held, own = [], [], 0, 0, False
    while True:
        a, e = active, edges
        if since:
            gone = _all(since)
            a, e = active.join(gone.select("v"), "v", "left_anti"), without(edges, gone)
        now = cut(trim1_once(a, e)[1])
        n = now.count()
        if n:
            resolved.append(now)
            since.append(now)
            total, held = total + n, held + n
        if since and (n <= stop or held > room):
            gone, old = _all(since), (active, edges)
            active, edges = cut(active.join(gone.select("v"), "v", "left_anti")), cut(without(edges, gone))
            for x in old if own else ():
                discard(x)
            since, held, own = [], 0, True
        if n <= stop:
            break
    return active, edges, _all(resolved) if resolved else active.limit(0).select("v", F.col("v").alias("scc")), total


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.union(more)
    return out


def _single(edges: DataFrame, own: str, other: str) -> DataFrame:
    """(v, nbr): vertices with one different neighbour on that side."""
    return edges.groupBy(F.col(own).alias("v")).agg(F.min(other).alias("nbr"), F.max(other).alias("_m")).filter("nbr = _m").select("v", "nbr")


def _mutual(single: DataFrame) -> DataFrame:
    back = single.select(F.col("v").alias("nbr"), F.col("nbr").alias("_back"))
    return single.join(back, "nbr").filter("_back = v and v < nbr").select(F.col("v").alias("a"), F.col("nbr").alias("b"))


def trim2_out(edges: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, that are each other's only out-neighbour."""
    return _mutual(_single(edges, "src", "dst"))


def trim2_in(edges: DataFrame) -> DataFrame:
    """Pairs that are each other's only in-neighbour."""
    return _mutual(_single(edges, "dst", "src"))


def trim2(edges: DataFrame) -> DataFrame:
    """Pairs found by either side; each is a component of two."""
    return trim2_out(edges).union(trim2_in(edges)).distinct()


def trim2_two_phase(edges: DataFrame) -> DataFrame:
    """Pairs (a, b) in which one vertex has the other as its only neighbour on both sides, and
    the other likewise, or on one side."""
    out, into = _single(edges, "src", "dst"), _single(edges, "dst", "src")
    both = out.join(into.withColumnRenamed("nbr", "_in"), "v").filter("nbr = _in").select("v", "nbr")
    one = out.select(F.col("v").alias("nbr")).union(into.select(F.col("v").alias("nbr"))).distinct()
    return both.join(one, "nbr", "left_semi").select(F.least("v", "nbr").alias("a"), F.greatest("v", "nbr").alias("b")).distinct()


def resolve_pairs(active: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Take pairs out: (active, edges, resolved, how many vertices)."""
    gone = cut(pairs.select(F.explode(F.array("a", "b")).alias("v"), F.col("a").alias("scc")))
    n = gone.count()
    if not n:
        return active, edges, gone, 0
    return cut(active.join(gone.select("v"), "v", "left_anti")), cut(without(edges, gone)), gone, n


def trim2_repeated(active: DataFrame, edges: DataFrame, stop: int = 0, pairs=trim2) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Take pairs out while a pass finds more than stop vertices, as taking one pair out can
    leave others alone: (active, edges, resolved, how many)."""
    resolved, total = [], 0
    while True:
        active, edges, gone, n = resolve_pairs(active, edges, pairs(edges))
        resolved.append(gone)
        total += n
        if n <= stop:
            return active, edges, _all(resolved), total
