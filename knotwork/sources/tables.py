"""Graphs as parquet, the format for large ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..graph import Graph

EDGES = T.StructType([T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False)])
VERTICES = T.StructType([T.StructField("v", T.LongType(), False)])


def write(graph: Graph, path: str) -> None:
    """Edges dealt out by source and sorted, so readers of one vertex touch few row groups."""
    graph.edges.repartition("src").sortWithinPartitions("src", "dst").write.parquet(f"{path}/edges")
    graph.vertices.write.parquet(f"{path}/vertices")


def read(spark: SparkSession, path: str, properties: T.StructType | None = None) -> Graph:
    """With properties: the edges must have exactly these further columns, else it fails."""
    edges = spark.read.parquet(f"{path}/edges")
    if properties is not None:
        want = [(f.name, f.dataType) for f in [*EDGES.fields, *properties.fields]]
        have = [(f.name, f.dataType) for f in edges.schema.fields]
        if want != have:
            raise ValueError(f"columns are {have}, not {want}")
    return Graph(edges, spark.read.parquet(f"{path}/vertices"))


def write_bucketed(edges: DataFrame, table: str, buckets: int) -> None:
    """Edges as a table bucketed by source: joins and groupings by source need no shuffle."""
    edges.write.bucketBy(buckets, "src").sortBy("src", "dst").saveAsTable(table)
