"""Batches of inserted and deleted edges against known labels.

Insertions only merge components, so the condensation is enough; deletions only split inside
components that lose an inner edge. A mixed batch deletes first and inserts into the new labels.
The condensation, condensed(src, dst, copies), can be kept as state between batches: insertions
then read it and the labels, but not the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, dense_index, exclusive_sums
from ..loop import cut
from . import strategies
from .traverse import topological_levels


# --- condensation -----------------------------------------------------------------------


def relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Each edge with its ends' labels: (src, dst, a, b)."""
    la = labels.select(F.col("v").alias("src"), F.col("scc").alias("a"))
    lb = labels.select(F.col("v").alias("dst"), F.col("scc").alias("b"))
    return edges.select("src", "dst").join(la, "src").join(lb, "dst")


def condense(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst) between components, copies kept, inner edges dropped."""
    return relabelled(edges, labels).filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def condense_counted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, copies) between components."""
    return counted(relabelled(edges, labels))


def counted(edges: DataFrame) -> DataFrame:
    """The same from edges that relabelled() gave."""
    return edges.filter("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("copies"))


def merged_condensed(condensed: DataFrame, merged: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """The state after old components (merged: v old, scc new) merged and the cross edges `fresh`
    (like condensed, between old components) came in."""
    rows = condensed.select("src", "dst", "copies")
    if fresh is not None:
        rows = rows.union(fresh.select("src", "dst", "copies"))
    a = merged.select(F.col("v").alias("src"), F.col("scc").alias("a"))
    b = merged.select(F.col("v").alias("dst"), F.col("scc").alias("b"))
    new = rows.join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "copies")
    return new.groupBy("src", "dst").agg(F.sum("copies").cast("long").alias("copies"))


def components_of(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("scc").alias("v")).distinct()


def condensation_levels(edges: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(v, level) of the components: the longest path that leads to each."""
    return topological_levels(condense(edges, labels), components_of(labels), **how)


def mapped_back(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels of vertices from labels of their old components (v = old label, scc = new); those
    that are missing stay."""
    moved = merged.filter("v <> scc").select(F.col("v").alias("scc"), F.col("scc").alias("_new"))
    return labels.join(moved, "scc", "left").select("v", F.coalesce("_new", "scc").alias("scc"))


# --- insertions ---------------------------------------------------------------------------


def insert_naive(graph: Graph, batch: DataFrame, **how) -> DataFrame:
    """Method 5: recompute on all edges."""
    return strategies.auto(graph.with_edges(batch), **how).result()


def _quotient(graph: Graph, labels: DataFrame, batch: DataFrame, condensed: DataFrame | None) -> DataFrame | None:
    """The old components' edges with the batch's, each once; None if there is one component."""
    if components_of(labels).limit(2).count() <= 1:
        return None
    old = condense(graph.edges, labels) if condensed is None else condensed.select("src", "dst")
    return cut(old.union(condense(batch, labels)).distinct())


def _merged(graph: Graph, labels: DataFrame, batch: DataFrame, pivot: str, known: DataFrame | None, condensed: DataFrame | None, **how) -> DataFrame:
    quotient = _quotient(graph, labels, batch, condensed)
    if quotient is None:
        return labels.select("v", "scc")  # one component stays one
    return mapped_back(labels, strategies.auto(Graph(quotient, components_of(labels)), pivot=pivot, known=known, **how).result())


def insert_condensed(graph: Graph, labels: DataFrame, batch: DataFrame, condensed: DataFrame | None = None, **how) -> DataFrame:
    """Method 6: the components of the condensation, pivot of most out-edges."""
    return _merged(graph, labels, batch, "degree", None, condensed, **how)


def insert_into(condensed: DataFrame, labels: DataFrame, batch: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Method 6 on kept state: (labels, condensed) after the batch. Reads no edges but the
    batch's."""
    fresh = cut(condense_counted(batch, labels))
    if fresh.isEmpty():
        return labels.select("v", "scc"), condensed
    quotient = cut(condensed.select("src", "dst").union(fresh.select("src", "dst")).distinct())
    ends = quotient.select(F.explode(F.array("src", "dst")).alias("v")).distinct()  # others merge with none
    merged = cut(strategies.auto(Graph(quotient, ends), pivot="degree", **how).result())
    return mapped_back(labels, merged), merged_condensed(condensed, merged, fresh)


def affected_levels(levels: DataFrame, cross: DataFrame) -> DataFrame:
    """(level, spans): how many inserted edges (src, dst between components) span each level of
    the old condensation, both ends included. Steps of +1 and -1 are summed in order."""
    a = levels.select(F.col("v").alias("src"), F.col("level").alias("la"))
    b = levels.select(F.col("v").alias("dst"), F.col("level").alias("lb"))
    ends = cross.join(a, "src").join(b, "dst").select(F.least("la", "lb").alias("lo"), F.greatest("la", "lb").alias("hi"))
    steps = ends.select(F.explode(F.array(F.struct(F.col("lo").alias("level"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("level"), F.lit(-1).alias("d")))).alias("s")).groupBy("s.level").agg(F.sum("s.d").alias("d"))
    every = levels.select("level").distinct()
    summed = every.join(steps, "level", "left").withColumn("d", F.coalesce("d", F.lit(0)).cast("long"))
    return exclusive_sums(summed, "level", "d", "before").select("level", (F.col("before") + F.col("d")).cast("long").alias("spans"))


def insert_levels(graph: Graph, labels: DataFrame, batch: DataFrame, condensed: DataFrame | None = None, **how) -> DataFrame:
    """Method 7: components on levels that no inserted edge spans stay as they are: an old edge
    always leads to a higher level, so a cycle through level L needs an inserted edge over L."""
    old = cut(condense(graph.edges, labels).distinct() if condensed is None else condensed.select("src", "dst"))
    levels = cut(topological_levels(old, components_of(labels), **({"local_rows": how["local_rows"]} if "local_rows" in how else {})))
    cross = cut(condense(batch, labels))
    quiet = affected_levels(levels, cross).filter("spans = 0").select("level")
    known = levels.join(quiet, "level", "left_semi").select("v", F.col("v").alias("scc"))
    return _merged(graph, labels, batch, "least", known, old, **how)


def touched(labels: DataFrame, batch: DataFrame) -> DataFrame:
    """(v): the components where an inserted edge between components starts."""
    return condense(batch, labels).select(F.col("src").alias("v")).distinct()


def insert_touched(graph: Graph, labels: DataFrame, batch: DataFrame, condensed: DataFrame | None = None, **how) -> DataFrame:
    """Method 11: every new cycle passes the start of an inserted edge. The giant search begins
    at one of these; once all of them are resolved, the rest are single. A condensation that
    fits into a task goes there whole."""
    quotient = _quotient(graph, labels, batch, condensed)
    if quotient is None:
        return labels.select("v", "scc")
    plan = strategies.Plan(Graph(quotient, components_of(labels)), **how)
    if not plan.fits():
        starts = cut(touched(labels, batch))
        plan.trim1()
        chosen = plan.active.join(starts, "v", "left_semi").groupBy("color").agg(F.min("v").alias("pivot"))
        if not chosen.isEmpty():
            plan.fwbw(chosen, "global_fwbw")
        if plan.active.join(starts, "v", "left_semi").isEmpty():
            plan.drop(plan.active.select("v", F.col("v").alias("scc")))
        else:
            plan.trim1()
            plan.trim2()
            plan.trim1()
    plan.finish()
    return mapped_back(labels, plan.result())


# --- deletions ------------------------------------------------------------------------------


def survivors(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """The edges that stay: all copies of a deleted pair go."""
    return edges.select("src", "dst").join(batch.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def affected(labels: DataFrame, batch: DataFrame) -> DataFrame:
    """(scc): the components that hold both ends of a deleted edge."""
    return relabelled(batch, labels).filter("a = b").select(F.col("a").alias("scc")).distinct()


def delete_affected(graph: Graph, labels: DataFrame, batch: DataFrame, **how) -> DataFrame:
    """Method 9: recompute inside the affected components only; the others keep their labels."""
    hit = cut(affected(labels, batch))
    again = cut(labels.join(hit, "scc", "left_semi").select("v", "scc"))
    new = strategies.auto(Graph(cut(survivors(graph.edges, batch)), again.select("v")), within=again, **how).result()
    return labels.join(hit, "scc", "left_anti").select("v", "scc").union(new)


def delete_from(edges: DataFrame, condensed: DataFrame, labels: DataFrame, batch: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Method 9 on kept state: (labels, condensed) after the batch; edges: as they were before,
    where their ends' labels are known with these (a, b), as by relabelled(). The state is made anew
    only for components that lose an inner edge; of the others the deleted copies are taken off."""
    named = edges if {"a", "b"} <= set(edges.columns) else None
    batch = batch.select("src", "dst").distinct()
    pairs = cut(relabelled(batch, labels) if named is None else named.select("src", "dst", "a", "b").join(batch, ["src", "dst"], "left_semi"))
    if pairs.isEmpty():
        return labels.select("v", "scc"), condensed
    hit = cut(pairs.filter("a = b").select(F.col("a").alias("scc")).distinct())
    gone = pairs.filter("a <> b")
    if named is None:
        gone = edges.select("src", "dst").join(cut(gone), ["src", "dst"])
    less = gone.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg((-F.count("*")).alias("copies"))
    far = condensed.union(less).groupBy("src", "dst").agg(F.sum("copies").cast("long").alias("copies")).filter("copies > 0")
    for end in ("src", "dst"):
        far = far.join(hit.select(F.col("scc").alias(end)), end, "left_anti")
    far = far.select("src", "dst", "copies")
    if hit.isEmpty():
        return labels.select("v", "scc"), far
    inside = cut(labels.join(hit, "scc", "left_semi").select("v", "scc"))
    a, b = (hit.select(F.col("scc").alias(end), F.lit(True).alias(f"_{end}")) for end in ("a", "b"))
    left = relabelled(survivors(edges, batch), labels) if named is None else named.join(batch, ["src", "dst"], "left_anti")
    near = cut(left.join(a, "a", "left").join(b, "b", "left").filter("_a or _b").select("src", "dst", "a", "b"))
    new = cut(strategies.auto(Graph(near.filter("a = b").select("src", "dst"), inside.select("v")), within=inside, **how).result())
    return labels.join(hit, "scc", "left_anti").select("v", "scc").union(new), far.union(recounted(near, hit, new))


def recounted(edges: DataFrame, split: DataFrame, after: DataFrame) -> DataFrame:
    """(src, dst, copies) between components, of edges(src, dst, a, b) whose ends' labels are known
    as they were; split(scc): the components that may have fallen apart, after: the labels of their
    vertices now. A label is its component's least vertex, so what still has one of split had it
    before. Edges meet only the vertices that have another."""
    moved = cut(after.join(split, "scc", "left_anti").select("v", "scc"))
    for end, label in (("src", "a"), ("dst", "b")):
        edges = edges.join(moved.select(F.col("v").alias(end), F.col("scc").alias("_now")), end, "left").withColumn(label, F.coalesce("_now", label)).drop("_now")
    return counted(edges)


def delete_confined(graph: Graph, labels: DataFrame, batch: DataFrame, **how) -> DataFrame:
    """Method 10: recompute all, every search confined to an old component."""
    return strategies.auto(Graph(cut(survivors(graph.edges, batch)), labels.select("v")), within=labels, **how).result()


def every_kth(edges: DataFrame, k: int) -> DataFrame:
    """Method 8's thinning: each k-th edge in the order of (src, dst). Components may split, so
    this is an experiment, not a way to the labels. Different edges only."""
    e = edges.select("src", "dst").distinct().withColumn("_o", F.struct("src", "dst")).withColumn("_one", F.lit(1).cast("long"))
    return exclusive_sums(e, "_o", "_one", "n").filter((F.col("n") + 1) % k == 0).select("src", "dst")


def thinning(edges: DataFrame, n_vertices: int, keep: int = 4) -> int:
    """k so that about keep * n_vertices edges are left."""
    return max(1, edges.count() // max(1, keep * n_vertices))


def apply_batch(graph: Graph, labels: DataFrame, batch: DataFrame, **how) -> tuple[Graph, DataFrame]:
    """A mixed batch (op, src, dst) with op '-' and '+': delete first, then insert."""
    gone, new = _sides(batch)
    after = cut(delete_affected(graph, labels, gone, **how))
    graph = graph.without_edges(gone)
    return graph.with_edges(new), insert_condensed(graph, after, new, **how)


def apply_to_state(edges: DataFrame, condensed: DataFrame, labels: DataFrame, batch: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """The same on kept state: (labels, condensed). The edges are read only if the batch
    deletes."""
    gone, new = _sides(batch)
    if not gone.isEmpty():
        labels, condensed = (cut(x) for x in delete_from(edges, condensed, labels, gone, **how))
    return insert_into(condensed, labels, new, **how)


def _sides(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    return batch.filter("op = '-'").select("src", "dst"), batch.filter("op = '+'").select("src", "dst")


# --- batches ----------------------------------------------------------------------------------


def insert_candidates(edges: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """(src, dst) pairs that could be inserted: between two neighbours a < b of a vertex v that
    follow each other in its list, each id g in the gap gives g -> v unless that edge is there.
    With n, about as many places of each gap as its share of n asks for are drawn by a seeded
    formula, more until n pairs are found or every gap is drawn whole: the work follows n and the
    edges, not the range of ids."""
    e = edges.select("src", "dst").distinct()
    near = e.withColumn("next", F.lead("dst").over(Window.partitionBy("src").orderBy("dst"))).filter("next > dst + 1").withColumn("room", F.col("next") - F.col("dst") - 1)

    def free(gaps: DataFrame) -> DataFrame:
        return gaps.filter("g <> d").distinct().select(F.col("g").alias("src"), F.col("d").alias("dst")).join(e, ["src", "dst"], "left_anti")

    whole = near.select(F.explode(F.sequence(F.col("dst") + 1, F.col("next") - 1)).alias("g"), F.col("src").alias("d"))
    if n is None:
        return free(whole)
    near = cut(near)
    total = near.agg(F.sum("room")).first()[0] or 0
    share = 2.0 * n / total if total else 1.0
    while share < 0.5:
        times = F.ceil(F.col("room") * share).cast("int")
        drawn = near.select("src", "dst", "room", F.explode(F.sequence(F.lit(1), times)).alias("i"))
        place = F.col("dst") + 1 + F.pmod(F.col("src") * 7919 + F.col("dst") * 104_729 + F.col("i") * 1_299_709 + seed, F.col("room"))
        found = cut(free(drawn.select(place.alias("g"), F.col("src").alias("d"))))
        if found.count() >= n:
            return found
        share *= 2
    return free(whole)


def hash_ordered(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows (src, dst), random by a seeded hash and the same on every run; numbered over range
    partitions, so no task gets them all."""
    key = F.md5(F.concat_ws(":", F.lit(seed), "src", "dst"))
    placed = dense_index(rows.select(F.struct(key.alias("h"), "src", "dst").alias("o")), "o", "at")
    return placed.filter(F.col("at") < n).select("o.src", "o.dst")


def make_batches(edges: DataFrame, fractions: tuple[float, ...], pool: float, seed: int = 0) -> dict[float, tuple[DataFrame, DataFrame]]:
    """(insertions, deletions) of each fraction of the edges, from a pool of candidates and one of
    edges that hold the fraction `pool` of them."""
    m = edges.count()
    new = cut(hash_ordered(insert_candidates(edges, int(pool * m), seed), int(pool * m), seed))
    old = cut(hash_ordered(edges, int(pool * m), seed))
    return {f: (hash_ordered(new, int(f * m), seed + 1), hash_ordered(old, int(f * m), seed + 1)) for f in fractions}
