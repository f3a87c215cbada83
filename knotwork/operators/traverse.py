"""Level-synchronous traversal: joins of the frontier with the edges, HOPS levels in each job."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..loop import cut, discard

#: Levels that a job goes on before its frontier is written.
HOPS = 4
#: Tables kept apart before the visited one is put together again.
COMPACT = 8
#: Share of the edges that new vertices must make up for edges into visited ones to be dropped.
PRUNE = 0.25
#: A graph with so many vertices and edges goes to one task whole where a walk is long.
LOCAL_ROWS = 400_000


def _search(e: DataFrame, start: DataFrame, tags: list[str], max_level: int | None = None, on_level: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """(v, tags, level) of what start(v, tags) reaches over e(src, dst, tags), each tag for
    itself. e must be cut. A job takes HOPS steps from a frontier whose levels are
    exact, so the least step at which it meets a vertex is that vertex's. When a job has met
    many, edges that end at visited vertices are dropped: a wide search goes on from what is
    unvisited."""
    key = ["v", *tags]
    frontier, level = cut(start.select(*key).distinct().withColumn("level", F.lit(0).cast("long"))), 0
    visited, n, m, owned = [frontier], frontier.count(), None, False
    more = n
    if on_level is not None and n:
        on_level(frontier, 0)
    while more and (max_level is None or level < max_level):
        hops = HOPS if max_level is None else min(HOPS, max_level - level)
        seen = _union(visited)
        last = frontier if level == 0 else frontier.filter(F.col("level") == level)
        step, found = last.select(*key), None
        for i in range(1, hops + 1):
            step = step.withColumnRenamed("v", "src").join(e, ["src", *tags]).select(F.col("dst").alias("v"), *tags).distinct()
            here = step.withColumn("level", F.lit(level + i).cast("long"))
            found = here if found is None else found.union(here)
        fresh = found.groupBy(*key).agg(F.min("level").alias("level")).join(seen.select(*key), key, "left_anti")
        frontier = cut(fresh)
        level += hops
        n, more = frontier.agg(F.count("*"), F.count(F.when(F.col("level") == level, 1))).first()
        visited.append(frontier)
        if on_level is not None and n:
            for i in range(level - hops + 1, level + 1):
                if not frontier.filter(F.col("level") == i).isEmpty():
                    on_level(frontier.filter(F.col("level") == i), i)
        if len(visited) > COMPACT:
            whole = cut(seen.union(frontier))
            for old in visited[:-1]:
                discard(old)
            visited = [whole]
        if m is None:
            m = e.count()
        if n > PRUNE * m:
            old, e = e, cut(e.join(frontier.select(F.col("v").alias("dst"), *tags), ["dst", *tags], "left_anti").select("src", "dst", *tags))
            m = e.count()
            if owned:
                discard(old)
            owned = True
    return _union(visited)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.union(more)
    return out


def bfs(
    edges: DataFrame,
    sources: DataFrame,
    reverse: bool = False,
    within: DataFrame | None = None,
    visit: Callable[[Column], Column] | None = None,
    navigate: Callable[[Column, Column], Column] | None = None,
    on_level: Callable[[DataFrame, int], None] | None = None,
    max_level: int | None = None,
) -> DataFrame:
    """(v, level) of what the sources (v) reach; level is the distance in edges.

    within: labels (v, scc); only edges inside one label are followed. navigate(src, dst): an
    edge is followed only where it holds. visit(v): a vertex is entered only where it holds.
    on_level(frontier, level): called for each level that has vertices; the frame is good within
    the call."""
    e = edges.select("src", "dst")
    if navigate is not None:
        e = e.filter(navigate(F.col("src"), F.col("dst")))
    if within is not None:
        a = within.select(F.col("v").alias("src"), F.col("scc").alias("_a"))
        b = within.select(F.col("v").alias("dst"), F.col("scc").alias("_b"))
        e = e.join(a, "src").join(b, "dst").filter("_a = _b").select("src", "dst")
    if reverse:
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if visit is not None:
        e = e.filter(visit(F.col("dst")))
        sources = sources.filter(visit(F.col("v")))
    return _search(cut(e.distinct()), sources, [], max_level, on_level).select("v", "level")


def both_ways(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(v, fw, bw): what the sources (v) reach, and what reaches them, in one search."""
    e = edges.select("src", "dst")
    tagged = e.withColumn("back", F.lit(False)).union(e.select("dst", "src").withColumn("back", F.lit(True))).distinct()
    start = sources.select("v", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    found = _search(cut(tagged), start, ["back"])
    return found.groupBy("v").agg(F.bool_or(~F.col("back")).alias("fw"), F.bool_or("back").alias("bw"))


def reach(edges: DataFrame, sources: DataFrame, reverse: bool = False, within: DataFrame | None = None) -> DataFrame:
    """The reached vertices (v), sources included: what depth-first search finds, too."""
    return bfs(edges, sources, reverse, within).select("v")


def down_edges(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """The different edges that lead from one level to the next: the shortest-path DAG."""
    a = levels.select(F.col("v").alias("src"), F.col("level").alias("_a"))
    b = levels.select(F.col("v").alias("dst"), F.col("level").alias("_b"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").filter("_b = _a + 1").select("src", "dst", F.col("_a").alias("level"))


def fold_levels(edges: DataFrame, levels: DataFrame, start: Callable[[Column, Column], Column], combine: Callable[[Column], Column], merge: Callable[[Column, Column], Column]) -> DataFrame:
    """Replay the levels backwards: value(v) = merge(start(v, level), combine of the values of
    v's children in the shortest-path DAG). Returns (v, level, value)."""
    down = cut(down_edges(edges, levels))
    top = levels.agg(F.max("level")).first()[0]
    done, below = [], None
    for level in range(top if top is not None else -1, -1, -1):
        here = levels.filter(F.col("level") == level).withColumn("own", start(F.col("v"), F.col("level")))
        if below is None:
            value = here.select("v", "level", F.col("own").alias("value"))
        else:
            got = down.filter(F.col("level") == level).select("src", "dst").join(below.select(F.col("v").alias("dst"), "value"), "dst").groupBy(F.col("src").alias("v")).agg(combine(F.col("value")).alias("got"))
            value = here.join(got, "v", "left").select("v", "level", F.when(F.isnull("got"), F.col("own")).otherwise(merge(F.col("own"), F.col("got"))).alias("value"))
        below = cut(value)
        done.append(below)
    if not done:
        return levels.select("v", "level").withColumn("value", F.lit(None).cast("long"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def topological_levels(edges: DataFrame, vertices: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(v, level) in a DAG: the longest path from a vertex without in-edges; isolated ones 0.
    Vertices on or behind a cycle get no row. A round reads only the edges out of its frontier:
    a vertex is free once the in-edges met so far are all it has. A graph of up to local_rows
    vertices and edges goes to one task, as its rounds can be as many as its vertices."""
    e = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    every = vertices.select("v").distinct()
    if local_rows and e.count() + every.count() <= local_rows:
        return cut(_levels_in_a_task(e, every))
    need = cut(e.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("need")))
    free = cut(every.join(need, "v", "left_anti"))
    done, met, level = [], [], 0
    while not free.isEmpty():
        done.append(free.select("v", F.lit(level).cast("long").alias("level")))
        met.append(cut(e.join(free.select(F.col("v").alias("src")), "src").groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("n"))))
        total = _union(met).join(met[-1].select("v"), "v", "left_semi").groupBy("v").agg(F.sum("n").alias("n"))
        free = cut(total.join(need, "v").filter("n = need").select("v"))
        level += 1
        if len(met) > COMPACT:
            whole = cut(_union(met).groupBy("v").agg(F.sum("n").alias("n")))
            for old in met:
                discard(old)
            met = [whole]
    return _union(done) if done else vertices.select("v").limit(0).withColumn("level", F.lit(0).cast("long"))


def _levels_in_a_task(e: DataFrame, every: DataFrame) -> DataFrame:
    rows = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(every.select(F.col("v").alias("a"), F.lit(None).cast("long").alias("b")))

    def run(group: pa.Table) -> pa.Table:
        a, b = group.column("a").to_pylist(), group.column("b").to_pylist()
        out = {x: [] for x, y in zip(a, b) if y is None}
        need = dict.fromkeys(out, 0)
        for x, y in zip(a, b):
            if y is not None:
                out[x].append(y)
                need[y] += 1
        level, todo = {}, [v for v, n in need.items() if not n]
        at = 0
        while todo:
            level |= dict.fromkeys(todo, at)
            at, free = at + 1, []
            for v in todo:
                for w in out[v]:
                    need[w] -= 1
                    if not need[w]:
                        free.append(w)
            todo = free
        return pa.table({"v": pa.array(level.keys(), pa.int64()), "level": pa.array(level.values(), pa.int64())})

    return rows.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(run, "v long, level long")
