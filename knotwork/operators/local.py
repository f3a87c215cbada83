"""Small parts finished in one task each: an iterative depth-first search over Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vertices and edges that a task gets at most, give or take one part.
TASK_ROWS = 400_000


def strong_components(vertices: list[int], edges: list[tuple[int, int]]) -> dict[int, int]:
    """Vertex to the least vertex of its component (Tarjan's low links, without recursion)."""
    out: dict[int, list[int]] = {v: [] for v in vertices}
    for s, d in edges:
        out[s].append(d)
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    label: dict[int, int] = {}
    for root in vertices:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        path = [(root, iter(out[root]))]
        while path:
            v, todo = path[-1]
            for w in todo:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    path.append((w, iter(out[w])))
                    break
                if w not in label:
                    low[v] = min(low[v], index[w])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[v])
                if low[v] == index[v]:
                    at = len(stack) - 1
                    while stack[at] != v:
                        at -= 1
                    part = stack[at:]
                    del stack[at:]
                    least = min(part)
                    for w in part:
                        label[w] = least
    return label


def finish(active: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    """labels(v, scc) of active(v, color) with edges inside colors. Colors are dealt to about
    rows / TASK_ROWS tasks; each must be small (see strategies)."""
    tasks = max(1, -(-rows // TASK_ROWS))
    part = F.pmod(F.xxhash64("color"), F.lit(tasks)).alias("part")
    both = active.select(part, F.col("v").alias("a"), F.lit(None).cast("long").alias("b")).union(edges.select(part, F.col("src").alias("a"), F.col("dst").alias("b")))

    def run(group: pa.Table) -> pa.Table:
        a, b = group.column("a").to_pylist(), group.column("b").to_pylist()
        label = strong_components([x for x, y in zip(a, b) if y is None], [(x, y) for x, y in zip(a, b) if y is not None])
        return pa.table({"v": pa.array(label.keys(), pa.int64()), "scc": pa.array(label.values(), pa.int64())})

    return both.groupBy("part").applyInArrow(run, "v long, scc long")
