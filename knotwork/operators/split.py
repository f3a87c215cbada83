"""Splitting the active graph into parts that no component crosses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..loop import cut, discard
from .traverse import both_ways, reach
from .trim import restrict


def _spread(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Least label over what each vertex reaches, with pointer jumping, to the fixpoint."""
    labels, before = cut(vertices.select("v", F.col("v").alias("label"))), None
    e = cut(edges.select("src", "dst").distinct())
    while True:
        got = e.join(labels.select(F.col("v").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("v")).agg(F.min("label").alias("m"))
        near = labels.join(got, "v", "left").select("v", F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = near.join(labels.select(F.col("v").alias("label"), F.col("label").alias("far")), "label", "left")
        old, labels = labels, cut(jump.select("v", F.least("label", F.coalesce("far", "label")).alias("label")))
        discard(old)
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now


def min_label_forward(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, label): the least vertex that v reaches, itself included. Coarser than components,
    finer than weak components; no component crosses two labels."""
    return _spread(vertices, edges)


def weak_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, label): the least vertex connected to v, directions ignored."""
    e = edges.select("src", "dst")
    return _spread(vertices, e.union(e.select("dst", "src")))


def pivots(active: DataFrame) -> DataFrame:
    """(color, pivot): the least vertex of each color."""
    return active.groupBy("color").agg(F.min("v").alias("pivot"))


def members_of(active: DataFrame, color) -> DataFrame:
    """(v): the vertices of one color."""
    return active.filter(F.col("color") == color).select("v")


def color_sizes(active: DataFrame) -> DataFrame:
    return active.groupBy("color").agg(F.count("*").alias("n"))


def fwbw(active: DataFrame, edges: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One forward-backward round for all colors at once. chosen(color, pivot).

    Returns classes(v, color, fw, bw) and labels(v, scc): what a pivot reaches and is reached
    from is its component, labelled by its least vertex. Edges stay inside colors, so one
    search, both ways at once, serves every pivot."""
    classes = active.join(both_ways(edges, chosen.select(F.col("pivot").alias("v"))), "v", "left")
    classes = cut(classes.select("v", "color", F.coalesce("fw", F.lit(False)).alias("fw"), F.coalesce("bw", F.lit(False)).alias("bw")))
    found = classes.filter("fw and bw")
    least = found.groupBy("color").agg(F.min("v").alias("scc"))
    return classes, cut(found.join(least, "color").select("v", "scc"))


def recolored(classes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The unresolved rest with a color for each class, named by its least vertex, and the
    edges inside colors."""
    rest = classes.filter("not (fw and bw)")
    least = rest.groupBy("color", "fw", "bw").agg(F.min("v").alias("_new"))
    active = cut(rest.join(least, ["color", "fw", "bw"]).select("v", F.col("_new").alias("color")))
    return active, cut(restrict(edges, active))


def coloring_round(active: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Color by least reachable vertex, so every vertex of a color reaches its root; what the root
    reaches inside its color is then its component. Returns (active, edges, labels)."""
    labels = min_label_forward(active, edges).select("v", F.col("label").alias("color"))
    inside = cut(restrict(edges, labels))
    roots = labels.filter("v = color").select("v")
    found = cut(reach(inside, roots).join(labels, "v").select("v", F.col("color").alias("scc")))
    rest = cut(labels.join(found.select("v"), "v", "left_anti"))
    return rest, cut(restrict(inside, rest)), found
