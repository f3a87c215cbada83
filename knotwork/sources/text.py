"""Edge lists, matrix files, label files and adjacency lists as text, split over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse


def _numbers(spark: SparkSession, path, n: int, extra: str | None = None):
    """Lines whose first n tokens are whole numbers, as columns c0, c1, ...; other lines drop
    out, further tokens are ignored."""
    lines = spark.read.text(path)
    if extra:
        lines = lines.filter(extra)
    parts = F.split(F.trim(F.regexp_replace("value", r"[^0-9+-]+", " ")), " ")
    cols = [F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint").alias(f"c{i}") for i in range(n)]
    return lines.select(*cols).dropna()


def read_edges(spark: SparkSession, path, one_based: bool = True) -> DataFrame:
    """(src, dst) of "u v" lines, 0-based; copies and loops stay."""
    base = 1 if one_based else 0
    return _numbers(spark, path, 2).select((F.col("c0") - base).alias("src"), (F.col("c1") - base).alias("dst"))


def largest_id(edges: DataFrame) -> DataFrame:
    """One row: edges, and the largest 1-based vertex id, which is the number of vertices."""
    return edges.agg(F.count("*").alias("edges"), (F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).alias("vertices"))


def write_edges(edges: DataFrame, path: str, one_based: bool = True) -> None:
    base = 1 if one_based else 0
    edges.select(F.concat_ws(" ", F.col("src") + base, F.col("dst") + base).alias("value")).write.text(path)


def read_matrix(spark: SparkSession, path) -> DataFrame:
    """(src, dst), 0-based, of a coordinate matrix file: lines with % are comments, the first
    other line is the header, loops are dropped. One file only, as the header is its first
    line; byte order within the file finds it."""
    lines = spark.read.text(path).filter(~F.contains("value", F.lit("%")) & (F.trim("value") != "")).select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    head = lines.agg(F.min(F.struct("at", "n")).alias("h"))
    body = lines.join(F.broadcast(head)).filter(F.struct("at", "n") != F.col("h")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    ends = body.select((F.try_element_at("p", F.lit(1)).try_cast("bigint") - 1).alias("src"), (F.try_element_at("p", F.lit(2)).try_cast("bigint") - 1).alias("dst"))
    return ends.dropna().filter("src <> dst")


def read_labels(spark: SparkSession, path) -> DataFrame:
    """(v, label) of "v label" lines, 0-based."""
    return _numbers(spark, path, 2).select(F.col("c0").alias("v"), F.col("c1").alias("label"))


def write_labels(labels: DataFrame, path: str) -> None:
    """labels(v, label) as "v label" lines in vertex order."""
    labels.orderBy("v").select(F.concat_ws(" ", "v", "label").alias("value")).write.text(path)


def convert_tabs(spark: SparkSession, path, to: str) -> None:
    """A tab-separated list with # comments as a space-separated one."""
    lines = spark.read.text(path).filter(~F.startswith("value", F.lit("#")))
    lines.select(F.regexp_replace("value", "\t", " ").alias("value")).write.text(to)


def read_typed_edges(spark: SparkSession, path, properties: dict[str, str], separator: str = " ") -> DataFrame:
    """(src, dst, properties...) of "u v p1 p2 ..." lines, 0-based; properties: name to kind
    (see functions.parse). Missing trailing properties take the kind's default."""
    t = parse.tokens(F.col("value"), separator)
    at = lambda i: F.try_element_at(F.col("t"), F.lit(i))
    rows = spark.read.text(path).select(t.alias("t")).filter(F.size("t") >= 2)
    props = [parse.with_default(F.when(F.size("t") >= i + 3, parse.parse(at(i + 3), k)), k).alias(n) for i, (n, k) in enumerate(properties.items())]
    return rows.select(parse.parse(at(1), "long").alias("src"), parse.parse(at(2), "long").alias("dst"), *props)


def write_typed_edges(edges: DataFrame, path: str, separator: str = " ") -> None:
    edges.select(F.concat_ws(separator, *[F.col(c).cast("string") for c in edges.columns]).alias("value")).write.text(path)


def read_adjacency(spark: SparkSession, path, separator: str = " ", vertex_props: dict[str, str] | None = None, edge_props: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of "v {vertex properties} [neighbour {edge properties}]*" lines."""
    vp, ep = vertex_props or {}, edge_props or {}
    rows = spark.read.text(path).select(parse.tokens(F.col("value"), separator).alias("t")).filter(F.size("t") >= 1)
    at = lambda i: F.try_element_at(F.col("t"), F.lit(1) + i)
    vertices = rows.select(parse.parse(at(F.lit(0)), "long").alias("v"), *[parse.parse(at(F.lit(i + 1)), k).alias(n) for i, (n, k) in enumerate(vp.items())])
    first, width = 1 + len(vp), 1 + len(ep)
    n = F.floor((F.size("t") - first) / width).cast("int")
    each = rows.filter(n > 0).select("t", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    place = F.col("i") * width + first
    edges = each.select(parse.parse(at(F.lit(0)), "long").alias("src"), parse.parse(at(place), "long").alias("dst"), *[parse.parse(at(place + j + 1), k).alias(name) for j, (name, k) in enumerate(ep.items())])
    return edges, vertices


def write_adjacency(edges: DataFrame, vertices: DataFrame, path: str, separator: str = " ") -> None:
    """One line for each vertex; further columns are written as properties."""
    vp = [c for c in vertices.columns if c != "v"]
    ep = [c for c in edges.columns if c not in ("src", "dst")]
    near = edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list(F.struct("dst", *ep))).alias("n"))
    part = F.array_join(F.transform("n", lambda x: F.concat_ws(separator, x["dst"].cast("string"), *[x[p].cast("string") for p in ep])), separator)
    head = [F.col(c).cast("string") for c in ["v", *vp]]
    vertices.join(near, "v", "left").select(F.concat_ws(separator, *head, F.when(F.size("n") > 0, part)).alias("value")).write.text(path)


def to_records(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Adjacency records (v, vertex properties..., neighbours): an array of (dst, properties...)."""
    ep = [c for c in edges.columns if c not in ("src", "dst")]
    near = edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list(F.struct("dst", *ep))).alias("neighbours"))
    return vertices.join(near, "v", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast(near.schema["neighbours"].dataType)))


def from_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of adjacency records."""
    return records.select(F.col("v").alias("src"), F.inline("neighbours")), records.drop("neighbours")


def read_avro_adjacency(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of adjacency records in Avro files; needs Spark's avro package on the
    class path."""
    return from_records(spark.read.format("avro").load(path))


def write_avro_adjacency(edges: DataFrame, vertices: DataFrame, path: str) -> None:
    to_records(edges, vertices).write.format("avro").save(path)
