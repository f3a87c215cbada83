"""The graph: a table of edges, a table of vertices, and what is read off them directly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .loop import cut


@dataclass(frozen=True)
class Graph:
    """edges(src, dst, ...): a directed multigraph, loops allowed; vertices(v)."""

    edges: DataFrame
    vertices: DataFrame

    # --- making one ---------------------------------------------------------------------

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None) -> "Graph":
        """Without a vertex table the vertices are 0 .. the largest id met, isolated included."""
        edges = edges.withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")})
        if vertices is None:
            top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
            vertices = edges.sparkSession.range(0, -1 if top is None else top + 1)
        return Graph(edges, vertices.select(F.col(vertices.columns[0]).cast("long").alias("v")))

    def frozen(self) -> "Graph":
        """Materialised once, adjacency together and in order: what loops should start from."""
        return Graph(cut(self.edges.repartition("src").sortWithinPartitions("src", "dst")), cut(self.vertices))

    # --- changing it (a new graph each time) ----------------------------------------------

    def with_vertices(self, more: DataFrame) -> "Graph":
        return Graph(self.edges, self.vertices.union(more.select(F.col(more.columns[0]).cast("long"))).distinct())

    def with_edges(self, more: DataFrame, check: bool = False) -> "Graph":
        """Append edges; check: fail if an end is not a vertex."""
        more = more.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        if check and not more.select(F.explode(F.array("src", "dst")).alias("v")).join(self.vertices, "v", "left_anti").isEmpty():
            raise ValueError("an edge ends at a vertex that isn't there")
        return Graph(self.edges.select("src", "dst").unionByName(more), self.vertices)

    def without_edges(self, gone: DataFrame) -> "Graph":
        """Remove all copies of the given (src, dst)."""
        return Graph(self.edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti"), self.vertices)

    def without_vertices(self, gone: DataFrame) -> "Graph":
        """Detach vertices: they go, with every edge at them."""
        v = gone.select(F.col(gone.columns[0]).alias("g"))
        e = self.edges.join(v, F.col("src") == F.col("g"), "left_anti").join(v, F.col("dst") == F.col("g"), "left_anti")
        return Graph(e, self.vertices.join(v, F.col("v") == F.col("g"), "left_anti"))

    def compressed(self) -> tuple["Graph", DataFrame]:
        """Renumber the vertices densely in order; also the table (v, idx)."""
        keys = dense_index(self.vertices.select("v"), "v", "idx")
        e = self.edges.select("src", "dst").join(keys.select(F.col("v").alias("src"), F.col("idx").alias("s")), "src").join(keys.select(F.col("v").alias("dst"), F.col("idx").alias("d")), "dst")
        return Graph(e.select(F.col("s").alias("src"), F.col("d").alias("dst")), keys.select(F.col("idx").alias("v"))), keys

    def reversed(self) -> "Graph":
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest), self.vertices)

    def undirected(self) -> "Graph":
        """Simple undirected graph: every edge in both directions, once."""
        e = self.edges.select("src", "dst")
        return Graph(e.union(e.select("dst", "src")).distinct(), self.vertices)

    def simple(self) -> "Graph":
        """Without loops and copies."""
        return Graph(self.edges.select("src", "dst").filter("src <> dst").distinct(), self.vertices)

    # --- reading it -------------------------------------------------------------------------

    def out_degrees(self) -> DataFrame:
        return self._degrees("src")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst")

    def _degrees(self, end: str) -> DataFrame:
        n = self.edges.groupBy(F.col(end).alias("v")).agg(F.count("*").alias("degree"))
        return self.vertices.join(n, "v", "left").select("v", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def multiplicity(self) -> DataFrame:
        return self.edges.groupBy("src", "dst").agg(F.count("*").alias("copies"))

    def has_edges(self, asked: DataFrame) -> DataFrame:
        """asked(src, dst) with found, the number of edges between, and eid the least id."""
        ids = "eid" in self.edges.columns
        n = self.edges.groupBy("src", "dst").agg(F.count("*").alias("n"), *([F.min("eid").alias("eid")] if ids else []))
        return asked.join(n, ["src", "dst"], "left").select("src", "dst", F.coalesce(F.col("n"), F.lit(0)).alias("copies"), F.isnotnull("n").alias("found"), *(["eid"] if ids else []))

    def max_degree_vertex(self) -> DataFrame:
        """The vertex with most out-edges, the least id among ties; one row or none."""
        d = self.edges.groupBy("src").agg(F.count("*").alias("degree"))
        return d.agg(F.max(F.struct(F.col("degree"), (-F.col("src")).alias("n"))).alias("b")).filter("b is not null").select((-F.col("b.n")).alias("v"), F.col("b.degree").alias("degree"))

    def adjacency(self) -> DataFrame:
        """(v, neighbours): out-neighbours in order, copies kept."""
        n = self.edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))
        return self.vertices.join(n, "v", "left").select("v", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))

    def offsets(self) -> DataFrame:
        """(v, begin, degree): where each vertex's edges begin in an edge array sorted by source."""
        return exclusive_sums(self.out_degrees(), "v", "degree", "begin").select("v", "begin", "degree")

    def numbers(self) -> DataFrame:
        """One row: vertices, edges, loops, and different edges."""
        e = self.edges.agg(F.count("*").alias("edges"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("loops"))
        return self.vertices.agg(F.count("*").alias("vertices")).join(e).join(self.edges.select("src", "dst").distinct().agg(F.count("*").alias("different")))

    def pick_vertices(self, n: int, seed: int) -> DataFrame:
        """n vertices in the order of a seeded hash: random, and the same on every run."""
        return self.vertices.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "v")), "v").limit(n)

    def pick_out_neighbours(self, seed: int) -> DataFrame:
        """One out-neighbour of each vertex that has any, by a seeded hash of the pair."""
        e = self.edges.select("src", "dst").distinct()
        best = e.groupBy("src").agg(F.min(F.struct(F.md5(F.concat_ws(":", F.lit(seed), "src", "dst")).alias("h"), "dst")).alias("b"))
        return best.select(F.col("src").alias("v"), F.col("b.dst").alias("neighbour"))


# --- numbering without a single-task window ------------------------------------------------


def exclusive_sums(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows before it in the order of a unique column: each
    range partition sums its own, the partitions' totals (one number each) are added before."""
    parts = cut(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p")
    totals = parts.groupBy("_p").agg(F.sum(value).alias("_t")).withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum(value).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_in", inside).join(F.broadcast(totals.select("_p", "_before")), "_p").withColumn(name, F.col("_in") + F.col("_before")).drop("_p", "_in", "_before")


def dense_index(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with 0, 1, 2, ... in the order of a unique column."""
    return exclusive_sums(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name).drop("_one")


def key_dictionary(df: DataFrame, key: Column, position: Column) -> DataFrame:
    """(key, idx): external keys numbered by first appearance; position must be unique."""
    first = df.groupBy(key.alias("key")).agg(F.min(position).alias("first"))
    return dense_index(first, "first", "idx").select("key", "idx")


def encode_edges(edges: DataFrame, src: str, dst: str, keys: DataFrame) -> DataFrame:
    """Edges between external keys as (src, dst) of their numbers; unknown keys drop out."""
    a = keys.select(F.col("key").alias(src), F.col("idx").alias("_s"))
    b = keys.select(F.col("key").alias(dst), F.col("idx").alias("_d"))
    return edges.join(a, src).join(b, dst).select(F.col("_s").alias("src"), F.col("_d").alias("dst"))


def path_graph(spark: SparkSession, n: int) -> Graph:
    """0 -> 1 -> ... -> n - 1."""
    return Graph(spark.range(max(n - 1, 0)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), spark.range(n).withColumnRenamed("id", "v"))


def star_graph(spark: SparkSession, n: int) -> Graph:
    """0 -> 1, ..., 0 -> n - 1."""
    return Graph(spark.range(1, max(n, 1)).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")), spark.range(n).withColumnRenamed("id", "v"))
