"""Contraction: components of blocks of the graph, found in tasks, become one vertex each.

A block is a range of vertex ids with the edges inside it; of a graph in layers, which no edge
crosses, a range of ids of one layer, so that it reaches further. A component of a part of a graph lies
inside one component of the whole, so merging it changes no other component. One that no edge
from outside the block leads to, or that leads to none out of it, along whatever path, is a
component of the whole already, and goes with its edges. Where near ids are linked, as in graphs
made of regions, most of a long search lies inside blocks and is saved; where they are not, a
round costs one pass over the edges and finds little."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..loop import cut

#: Vertices and edges of a block, at most.
BLOCK_ROWS = 400_000
#: Ranges of ids that are counted before they are put together to blocks.
CELLS = 65_536


#: What a row of a block is: a vertex, an edge inside, out of or into the block.
VERTEX, INSIDE, OUT, IN = range(4)


@dataclass(frozen=True)
class Round:
    """found(v, rep, done): for every vertex the least one of its component in its block, and
    whether that is a component of the whole; and what is left: active(v, color), edges(src, dst,
    color)."""

    found: DataFrame
    active: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Blocks:
    """Which block an id lies in: of[cell], -1 where there is none. n: how many blocks; crowded: the
    vertices of some cells, or null ones, are in no block; layers: as for blocks()."""

    lo: int
    width: int
    of: np.ndarray
    n: int
    crowded: bool
    layers: int = 1

    def cell(self, v: str) -> Column:
        return _cell(v, self.lo, self.width, self.layers)

    def place(self, v: np.ndarray) -> np.ndarray:
        cell = np.floor((v.astype(float) - float(self.lo)) / self.width)
        known = (cell >= 0) & (cell <= _cells(self.layers))
        cell = np.where(known, cell, 0).astype(np.int64) + v % self.layers * (_cells(self.layers) + 1)
        known &= cell < len(self.of)
        return np.where(known, self.of[np.where(known, cell, 0)], -1)


def blocks(vertices: DataFrame, edges: DataFrame, block_rows: int, layers: int = 1) -> Blocks | None:
    """Cells of ids in order, put together until they hold about block_rows vertices and edges. A
    cell that alone holds more is left out. layers: ids that leave one remainder by it are next to
    each other, in their order; right for any number, and few edges lead out of blocks where none
    links two remainders."""
    lo, hi, nulls = vertices.agg(F.min("v"), F.max("v"), F.count("*") - F.count("v")).first()
    if lo is None:
        return None
    width = (hi - lo) // _cells(layers) + 1
    rows = vertices.select("v").union(edges.select("src"))
    n = rows.groupBy(_cell("v", lo, width, layers).alias("cell")).agg(F.count("*").alias("n")).filter("cell >= 0").toArrow()  # at most CELLS + layers rows
    cell, n = n.column("cell").to_numpy(), n.column("n").to_numpy()
    total = np.zeros(cell.max() + 1, np.int64)
    total[cell] = n
    fits = (total > 0) & (total <= block_rows)
    of = np.full(len(total), -1, np.int64)
    found, of[fits] = np.unique((np.cumsum(total[fits]) - 1) // block_rows, return_inverse=True)
    return Blocks(lo, width, of, len(found), bool((total > block_rows).any() or nulls), layers)


def _cells(layers: int) -> int:
    """Cells of a layer, but for one more that rounding may reach."""
    return max(1, CELLS // layers)


def _cell(v: str, lo: int, width: int, layers: int) -> Column:
    """-1 for null and what lies outside."""
    cell, last = F.floor((F.col(v).cast("double") - F.lit(float(lo))) / width), _cells(layers)
    return F.when(cell.between(0, last), cell + F.pmod(F.col(v), F.lit(layers)) * (last + 1)).otherwise(-1)


def components(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, int]:
    """The component of each of the vertices 0 .. n - 1, and how many there are. An edge leads to
    the same component or to one of a lesser number (Tarjan's low links, without recursion)."""
    order = np.argsort(src, kind="stable")
    to = dst[order].tolist()
    at = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(src, minlength=n), out=at[1:])
    end, at = at[1:].tolist(), at[:-1].tolist()
    index, low, label = [0] * n, [0] * n, [-1] * n
    stack, path, seen, parts = [], [], 0, 0
    for root in range(n):
        if index[root]:
            continue
        v = root
        seen += 1
        index[v] = low[v] = seen
        stack.append(v)
        path.append(v)
        while path:
            v = path[-1]
            i, stop, least = at[v], end[v], low[v]
            while i < stop:
                w = to[i]
                i += 1
                if not index[w]:
                    seen += 1
                    index[w] = low[w] = seen
                    stack.append(w)
                    path.append(w)
                    break
                if label[w] < 0 and index[w] < least:
                    least = index[w]
            else:
                path.pop()
                if path and least < low[path[-1]]:
                    low[path[-1]] = least
                if least == index[v]:
                    while True:
                        w = stack.pop()
                        label[w] = parts
                        if w == v:
                            break
                    parts += 1
            at[v], low[v] = i, least
    return np.array(label, np.int64), parts


def solved(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, rep, done) of the vertices of a block; a and b are an edge's ends, or a vertex."""
    v = np.unique(a[kind == VERTEX])
    n = len(v)

    def place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(v, x), max(n - 1, 0))
        return i, v[i] == x if n else np.zeros(len(x), bool)

    (src, known), (dst, too) = place(a[kind == INSIDE]), place(b[kind == INSIDE])
    src, dst = src[known & too], dst[known & too]
    label, parts = components(n, src, dst)
    ends = []
    for ids in (b[kind == IN], a[kind == OUT]):
        hit = np.zeros(parts, bool)
        i, known = place(ids)
        hit[label[i[known]]] = True
        ends.append(hit.tolist())
    entered, left = ends
    x, y = label[src], label[dst]
    x, y = x[x != y], y[x != y]
    order = np.argsort(x, kind="stable")
    x, y = x[order].tolist(), y[order].tolist()
    for c, d in zip(x, y):
        if left[d]:
            left[c] = True
    for c, d in zip(reversed(x), reversed(y)):
        if entered[c]:
            entered[d] = True
    least = np.full(parts, np.iinfo(np.int64).max)
    np.minimum.at(least, label, v)
    done = ~(np.array(entered, bool) & np.array(left, bool))
    return v, least[label], done[label]


def kept(kind: np.ndarray, a: np.ndarray, b: np.ndarray, v: np.ndarray, rep: np.ndarray, done: np.ndarray) -> list[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """By kind, the edges inside and out of a block that go on between representatives, each once;
    the far ends of the latter as they are."""
    v, rep = v[~done], rep[~done]

    def moved(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(v, x), max(len(v) - 1, 0))
        return (rep[i], v[i] == x) if len(v) else (x, np.zeros(len(x), bool))

    out = []
    for k in (INSIDE, OUT):
        (src, known), dst = moved(a[kind == k]), b[kind == k]
        if k == INSIDE:
            dst, too = moved(dst)
            known = known & too & (src != dst)
        pairs = np.unique(np.stack([src[known], dst[known]]), axis=1)
        out.append((k, (pairs[0], pairs[1])))
    return out


#: Rows that are put in order at once before they go to their blocks.
PACK_ROWS = 1_000_000
_ROW = "kind byte, a long, b long, done boolean"


def _packed(rows: DataFrame, at: Broadcast, single: bool) -> DataFrame:
    """(block, kind, a, b): the rows (a, b) of blocks, thousands in one, as bytes: vertices (single),
    or edges, which go to the blocks of both ends."""

    def packs(a: np.ndarray, b: np.ndarray):
        of = at.value.place(a)
        if single:
            parts = [(VERTEX, of, of >= 0)]
        else:
            to = at.value.place(b)
            inside = (of == to) & (of >= 0)
            parts = [(INSIDE, of, inside), (OUT, of, ~inside & (of >= 0)), (IN, to, ~inside & (to >= 0))]
        block, kind, ends = [], [], ([], [])
        for k, where, mine in parts:
            mine = np.flatnonzero(mine)
            mine = mine[np.argsort(where[mine], kind="stable")]
            found, first = np.unique(where[mine], return_index=True)
            for w, own in zip(found.tolist(), np.split(mine, first[1:])):
                block.append(w)
                kind.append(k)
                ends[0].append(a[own].tobytes())
                ends[1].append(b"" if single else b[own].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(kind, pa.int8()), *(pa.array(x, pa.binary()) for x in ends)], names=["block", "kind", "a", "b"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()))
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield packs(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield packs(*map(np.concatenate, zip(*held)))

    return rows.mapInArrow(run, "block long, kind byte, a binary, b binary")


def _run(batches):
    """The blocks of a task, whose packs follow each other: a row (VERTEX, v, rep, done) of every
    vertex, and the edges that go on."""
    now, held = None, []
    for batch in batches:
        for block, *pack in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if held and block != now:
                yield from _answer(held)
                held = []
            now = block
            held.append(pack)
    if held:
        yield from _answer(held)


def _answer(packs: list) -> list[pa.RecordBatch]:
    long = lambda raw: np.frombuffer(raw, np.int64)
    kind = np.concatenate([np.full(len(long(a)), k, np.int8) for k, a, _ in packs])
    src, dst = np.concatenate([long(a) for _, a, _ in packs]), np.concatenate([long(a if k == VERTEX else b) for k, a, b in packs])
    v, rep, done = solved(kind, src, dst)
    edges = kept(kind, src, dst, v, rep, done)
    kinds = np.concatenate([np.full(len(v), VERTEX, np.int8), *(np.full(len(x), k, np.int8) for k, (x, _) in edges)])
    x, y = np.concatenate([v, *(x for _, (x, _) in edges)]), np.concatenate([rep, *(y for _, (_, y) in edges)])
    whole = pa.table({"kind": pa.array(kinds), "a": pa.array(x), "b": pa.array(y), "done": pa.array(np.concatenate([done, np.zeros(len(x) - len(v), bool)]))})
    return whole.to_batches(max_chunksize=100_000)


def contracted(vertices: DataFrame, edges: DataFrame, block_rows: int, layers: int = 1) -> Round | None:
    """One round over vertices(v, color) and edges(src, dst), whose ends may be unknown vertices;
    all vertices that an edge links have one color, 0 where the column isn't there. layers: as for
    blocks(). None for a graph without vertices."""
    at = blocks(vertices, edges, block_rows, layers)
    if at is None:
        return None
    shared = vertices.sparkSession.sparkContext.broadcast(at)
    simple = edges.select("src", "dst").filter("src <> dst")
    packed = _packed(vertices.filter("v is not null").select(F.col("v").cast("long").alias("a")), shared, True).union(_packed(simple.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b")), shared, False))
    every = packed.repartition(max(1, 4 * at.n), "block").sortWithinPartitions("block").mapInArrow(_run, _ROW)  # few blocks in one task
    if at.crowded:
        known = F.broadcast(vertices.sparkSession.createDataFrame([(int(c),) for c in np.flatnonzero(at.of >= 0)], "_cell long"))
        apart = lambda df, v: df.withColumn("_cell", at.cell(v)).join(known, "_cell", "left_anti").drop("_cell")
        every = every.union(apart(vertices.select("v"), "v").distinct().select(F.lit(VERTEX).cast("byte"), "v", "v", F.lit(False)))
        every = every.union(apart(simple, "src").select(F.lit(OUT).cast("byte"), "src", "dst", F.lit(False)))
    every = cut(every)
    found = every.filter(F.col("kind") == VERTEX).select(F.col("a").alias("v"), F.col("b").alias("rep"), "done")
    live = found.filter("not done").select("v", "rep")
    edge = lambda kind: every.filter(F.col("kind") == kind).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    out = edge(OUT).join(live.select(F.col("v").alias("dst"), "rep"), "dst").select("src", F.col("rep").alias("dst")).distinct()
    active = live.filter("v = rep").select("v")
    left = edge(INSIDE).union(out)  # inside, each is there once; out, no end is the other
    if "color" in vertices.columns:
        active = cut(active.join(vertices.select("v", "color").distinct(), "v"))
        return Round(found, active, cut(left.join(active.select(F.col("v").alias("src"), "color"), "src").select("src", "dst", "color")))
    active = cut(active.withColumn("color", F.lit(0).cast("long")))
    if at.crowded:  # edges out of crowded cells may start at unknown vertices
        left = left.join(active.select(F.col("v").alias("src")), "src", "left_semi")
    return Round(found, active, cut(left.select("src", "dst", F.lit(0).cast("long").alias("color"))))


def labelled(rounds: list[Round], labels: DataFrame) -> DataFrame:
    """labels(v, scc) of all vertices, from those of what the last round left."""
    for r in reversed(rounds):
        labels = cut(labels)
        merged = r.found.filter("not done and v <> rep").join(labels.select(F.col("v").alias("rep"), "scc"), "rep").select("v", "scc")
        labels = r.found.filter("done").select("v", F.col("rep").alias("scc")).union(labels).union(merged)
    return labels


def merged_in_blocks(vertices: DataFrame, edges: DataFrame, block_rows: int) -> DataFrame | None:
    """(v, rep): the vertices that share a component of their block with a lesser one, the least
    of which is rep. edges(src, dst)."""
    found = contracted(vertices.select("v"), edges, block_rows)
    return None if found is None else found.found.filter("v <> rep").select("v", "rep")


def composed(rounds: list[DataFrame]) -> DataFrame:
    """(v, rep) of all rounds together: every rep is one that no later round merged."""
    out = rounds[0]
    for more in rounds[1:]:
        to = more.select(F.col("v").alias("rep"), F.col("rep").alias("_rep"))
        out = out.join(to, "rep", "left").select("v", F.coalesce("_rep", "rep").alias("rep")).union(more)
    return out
