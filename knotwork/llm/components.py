"""Distributed connected components by alternating large and small stars.

Every step is a min-aggregation, combined map-side, and an equi-join in which a vertex with very
many neighbours is cut into parts (salted): no component and no star is gathered in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted, share_of, stored


def _large_star(e: DataFrame, share: int | None) -> DataFrame:
    """Link each vertex's larger neighbours to its least neighbour (itself included)."""
    both = _both_ways(e)
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).withColumn("m", F.least("u", "m"))
    return _joined(both.filter("v > u"), least, share).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(e: DataFrame, share: int | None) -> DataFrame:
    """Link each vertex and its smaller neighbours to the least of them; e has u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    linked = _joined(e, least, share).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _both_ways(e: DataFrame) -> DataFrame:
    return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _joined(many: DataFrame, least: DataFrame, share: int | None) -> DataFrame:
    return many.join(least, "u") if share is None else salted(many, least, ["u"], "v", "c", share)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every endpoint of edges(u, v); component is the least node that
    can be reached. Null endpoints and self-loops link nothing; a node that occurs only in
    such rows is left out. Needs O(log n) rounds, each stored in the shared folder in place of
    the one before; it is done when every edge leads to a root, a vertex that no edge leaves."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    e, share = stored(e, "cc"), None
    for _ in range(max_rounds):
        # one query a round, as each leaves threads and classes in the driver. No vertex gets more
        # neighbours within a round than it has; out: edges that leave it; rows: edges, each met once
        degrees = _both_ways(e).groupBy("u").agg(F.count("*").alias("c"), F.count(F.when(F.col("v") < F.col("u"), 1)).alias("out"))
        passed = F.count(F.when((F.col("out") > 0) & (F.col("c") > F.col("out")), 1))
        most, out, rows, through = degrees.agg(F.max("c"), F.max("out"), F.sum("out"), passed).first()
        if (out or 0) <= 1 and not through:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node")))
        share = share or share_of(2 * rows)
        cut = share if most > share else None
        old, e = e, stored(_small_star(_large_star(e, cut), cut), "cc")
        discard(old)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
