"""The big-endian binary graph file, basic and extended.

Basic: magic, size of a vertex id, size of an edge id, N, M, begin[N + 1], dest[M]. Extended:
another magic, the same, then a flag and keys of the vertices, and typed vertex and edge columns.
Numbers after the two sizes have those sizes. Old files in which every number is little-endian are
read, too; the magic tells. A file is one sequence: partitions pack their rows' bytes, the driver strings them together in
order, chunk by chunk, and one task reads a file; parquet is the format for large graphs."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..loop import cut, discard

# Fixed values of the file format.
BASIC_MAGIC = 0x03939999
EXTENDED_MAGIC = 0x99191191
KINDS = {"bool": 0, "int": 1, "long": 2, "float": 3, "double": 4, "node": 5, "edge": 6}

_LAYOUT = {"bool": "?", "int": ">i4", "long": ">i8", "float": ">f4", "double": ">f8", "node": ">i8", "edge": ">i8"}


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at, self.flipped = raw, 0, False

    def take(self, kind: str, n: int = 1) -> np.ndarray:
        out = np.frombuffer(self.raw, np.dtype(kind.replace(">", "<") if self.flipped else kind), n, self.at)
        self.at += out.nbytes
        return out

    def one(self, kind: str = ">u4") -> int:
        return int(self.take(kind)[0])


def _open(raw: bytes, magic: int) -> tuple[_Reader, str, str, int, int]:
    r = _Reader(raw)
    found = r.one()
    if found != magic:
        if found != struct.unpack("<I", struct.pack(">I", magic))[0]:
            raise ValueError(f"not a graph file of this kind: magic {found:#x}")
        r.flipped = True  # an old file, written the other way round
    node, edge = r.one(), r.one()
    if node not in (4, 8) or edge not in (4, 8):
        raise ValueError("ids must have 4 or 8 bytes")
    n, m = f">i{node}", f">i{edge}"
    return r, n, m, r.one(n), r.one(m)


def _edges(r: _Reader, node: str, edge: str, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    begin = r.take(edge, n + 1).astype(np.int64)
    dst = r.take(node, m).astype(np.int64)
    return np.repeat(np.arange(n), np.diff(begin)), dst


def read(spark: SparkSession, path) -> Graph:
    """A basic file; vertices 0 .. N - 1, edges with eid in file order."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                r, node, edge, n, m = _open(raw.as_py(), BASIC_MAGIC)
                src, dst = _edges(r, node, edge, n, m)
                yield pa.RecordBatch.from_pydict({"src": src, "dst": dst, "eid": np.arange(m), "n": np.full(m, n)})
                yield pa.RecordBatch.from_pydict({"src": pa.array([None], pa.int64()), "dst": pa.array([None], pa.int64()), "eid": pa.array([None], pa.int64()), "n": pa.array([n], pa.int64())})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "src long, dst long, eid long, n long")
    top = rows.agg(F.max("n")).first()[0] or 0
    return Graph(rows.filter("src is not null").select("src", "dst", "eid"), spark.range(top).withColumnRenamed("id", "v"))


def read_extended(spark: SparkSession, path, node_props: dict[str, str], edge_props: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) with the declared columns (name to kind); other columns are an error.
    vertices has key where the file has keys, else null."""
    np_, ep = list(node_props.items()), list(edge_props.items())

    def load(raw: bytes):
        r, node, edge, n, m = _open(raw, EXTENDED_MAGIC)
        src, dst = _edges(r, node, edge, n, m)
        key = r.take(">i8", n).astype(np.int64) if r.take("u1")[0] else None
        sides = []
        for declared, count in ((np_, n), (ep, m)):
            if r.one() != len(declared):
                raise ValueError("the file has other columns than declared")
            cols = []
            for _, kind in declared:
                if r.one() != KINDS[kind]:
                    raise ValueError(f"a column isn't of kind {kind}")
                r.one(">u8")
                cols.append(r.take(_LAYOUT[kind], count).astype(np.dtype(_LAYOUT[kind]).newbyteorder("=")))
            sides.append(cols)
        return n, src, dst, key, sides

    def edges(batches):
        for batch in batches:
            for raw in batch.column("content"):
                _, src, dst, _, (_, cols) = load(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), *map(pa.array, cols)], names=["src", "dst", *(c for c, _ in ep)])

    def vertices(batches):
        for batch in batches:
            for raw in batch.column("content"):
                n, _, _, key, (cols, _) = load(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(key) if key is not None else pa.nulls(n, pa.int64()), *map(pa.array, cols)], names=["v", "key", *(c for c, _ in np_)])

    spark_type = {"bool": "boolean", "int": "int", "long": "long", "float": "float", "double": "double", "node": "long", "edge": "long"}
    typed = lambda props: "".join(f", {c} {spark_type[k]}" for c, k in props)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(edges, f"src long, dst long{typed(ep)}"), files.mapInArrow(vertices, f"v long, key long{typed(np_)}")


def _stream(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)


def _packed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(part, chunk, columns...): the rows in order, some ten thousand to a chunk, each column as
    its bytes in the file. Partitions pack their own; the driver only strings the chunks together."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for chunk, batch in enumerate(batches):
            cols = [pa.array([batch.column(c).to_numpy(zero_copy_only=False).astype(_LAYOUT[kind]).tobytes()], pa.binary()) for c, kind in columns.items()]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), *cols], names=["part", "chunk", *columns])

    return cut(rows.select(*columns).mapInArrow(run, ", ".join(["part int", "chunk int", *(f"`{c}` binary" for c in columns)])))


def _column(out, packed: DataFrame, column: str) -> None:
    for row in packed.orderBy("part", "chunk").select(column).toLocalIterator():
        out.write(bytes(row[0]))


def write(graph: Graph, path: str, keys: DataFrame | None = None, node_props: dict[str, str] | None = None, edge_props: dict[str, str] | None = None) -> None:
    """A basic file, or an extended one if keys (v, key) or properties are given. Property
    columns stand in graph.vertices and graph.edges. Vertices must be 0 .. N - 1."""
    spark = graph.edges.sparkSession
    extended = keys is not None or node_props is not None or edge_props is not None
    np_, ep = node_props or {}, edge_props or {}
    begin = graph.offsets().select("v", (F.col("begin") + F.col("degree")).alias("_end"))
    nodes = graph.vertices.select("v", *np_).join(begin, "v")
    if keys is not None:
        nodes = nodes.join(keys.select("v", F.col("key").alias("_key")), "v")
    nodes = _packed(nodes.orderBy("v"), {"_end": "edge", **({"_key": "long"} if keys is not None else {}), **np_})
    edges = _packed(graph.edges.select("src", "dst", *ep).orderBy("src", "dst"), {"dst": "node", **ep})
    n, m = graph.vertices.count(), graph.edges.count()
    out = _stream(spark, path)
    try:
        out.write(struct.pack(">IIIqq", EXTENDED_MAGIC if extended else BASIC_MAGIC, 8, 8, n, m))
        out.write(struct.pack(">q", 0))
        _column(out, nodes, "_end")
        _column(out, edges, "dst")
        if extended:
            out.write(struct.pack(">?", keys is not None))
            if keys is not None:
                _column(out, nodes, "_key")
            for props, packed, count in ((np_, nodes, n), (ep, edges, m)):
                out.write(struct.pack(">I", len(props)))
                for c, kind in props.items():
                    out.write(struct.pack(">IQ", KINDS[kind], count * np.dtype(_LAYOUT[kind]).itemsize))
                    _column(out, packed, c)
    finally:
        out.close()
        discard(nodes)
        discard(edges)
