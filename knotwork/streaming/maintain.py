"""Labels kept up to date under a stream of edge batches.

State is the labels and the condensation, one version for each micro-batch, and a log of edges:
each version adds and deletes some. A batch of insertions reads the last version's labels and
condensation, not the edges; deletions read the edges they touch, too. A version's directory is
the batch number, so a batch that is replayed after a failure finds its result or makes it again,
and nothing is applied twice. Versions before the last but one are deleted; every LOG versions
the log is written anew as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import Graph
from ..operators import dynamic


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _done(spark: SparkSession, folder: str) -> bool:
    p, fs = _path(spark, f"{folder}/DONE")
    return fs.exists(p)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    found = [x for x in _names(spark, folder) if x.startswith("v") and x[1:].lstrip("-").isdigit()]
    return sorted((int(x[1:]) for x in found), reverse=True)


def _latest(spark: SparkSession, folder: str, below: int) -> int:
    """The highest finished version under `below`; -1 is the start."""
    return next(n for n in _versions(spark, folder) if n < below and _done(spark, f"{folder}/v{n}"))


#: Versions whose edges are read one by one before they are written as one table.
LOG = 32


def _names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _path(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _base(spark: SparkSession, folder: str, upto: int) -> int:
    """The latest version up to `upto` whose edges were written as one table."""
    return max(n for n in map(int, _names(spark, f"{folder}/whole")) if n <= upto and _done(spark, f"{folder}/whole/{n}"))


def edges_of(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The edges after a version: what was added and not deleted by a later version."""
    base = _base(spark, folder, version)

    def log(kind: str) -> list[DataFrame]:
        found = sorted(n for n in map(int, _names(spark, f"{folder}/{kind}")) if base < n <= version)
        return [spark.read.schema("src long, dst long").parquet(f"{folder}/{kind}/{n}").withColumn("version", F.lit(n)) for n in found]

    added = spark.read.schema("src long, dst long").parquet(f"{folder}/whole/{base}/edges").withColumn("version", F.lit(base))
    for more in log("added"):
        added = added.union(more)
    deleted = log("deleted")
    if not deleted:
        return added.select("src", "dst")
    gone = deleted[0]
    for more in deleted[1:]:
        gone = gone.union(more)
    last = gone.groupBy("src", "dst").agg(F.max("version").alias("gone"))
    return added.join(last, ["src", "dst"], "left").filter("gone is null or gone <= version").select("src", "dst")


def _note(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.create(p, True).close()


def _write(spark: SparkSession, folder: str, version: int, labels: DataFrame, condensed: DataFrame, added: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
    at = f"{folder}/v{version}"
    labels.select("v", "scc").write.mode("overwrite").parquet(f"{at}/labels")
    condensed.select("src", "dst", "copies").write.mode("overwrite").parquet(f"{at}/condensed")
    for kind, rows in (("added", added), ("deleted", deleted)):
        if rows is not None:
            rows.select("src", "dst").write.mode("overwrite").parquet(f"{folder}/{kind}/{version}")
    _note(spark, f"{at}/DONE")


def _write_whole(spark: SparkSession, folder: str, version: int, edges: DataFrame) -> None:
    edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).write.mode("overwrite").parquet(f"{folder}/whole/{version}/edges")
    _note(spark, f"{folder}/whole/{version}/DONE")


def _tidy(spark: SparkSession, folder: str, version: int) -> None:
    """Delete what nothing reads any more: a replay starts from the version before."""
    base = _base(spark, folder, version - 1)
    stale = [f"v{n}" for n in _versions(spark, folder) if n < version - 1]
    stale += [f"{kind}/{n}" for kind in ("added", "deleted") for n in _names(spark, f"{folder}/{kind}") if int(n) <= base]
    stale += [f"whole/{n}" for n in _names(spark, f"{folder}/whole") if int(n) < base]
    for name in stale:
        p, fs = _path(spark, f"{folder}/{name}")
        fs.delete(p, True)


def start_state(graph: Graph, labels: DataFrame, folder: str) -> None:
    """The state before the first batch."""
    spark = graph.edges.sparkSession
    _write_whole(spark, folder, -1, graph.edges)
    _write(spark, folder, -1, labels, dynamic.condense_counted(graph.edges, labels))


def current(spark: SparkSession, folder: str) -> tuple[Graph, DataFrame]:
    """The latest finished graph and labels."""
    version = _latest(spark, folder, 1 << 62)
    labels = spark.read.parquet(f"{folder}/v{version}/labels")
    return Graph(edges_of(spark, folder, version), labels.select("v")), labels


def maintain(batches: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query over a stream of (op, src, dst), op '+' or '-'. New vertices must be in
    the start state. trigger: as for trigger(), by default all that is there, then stop."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if _done(spark, f"{folder}/v{number}"):
            return  # replayed
        before = _latest(spark, folder, number)
        at = f"{folder}/v{before}"
        ops = batch.select("op", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).persist()
        try:
            labels, condensed = dynamic.apply_to_state(edges_of(spark, folder, before), spark.read.parquet(f"{at}/condensed"), spark.read.parquet(f"{at}/labels"), ops)
            _write(spark, folder, number, labels, condensed, ops.filter("op = '+'"), ops.filter("op = '-'"))
        finally:
            ops.unpersist()
        if number - _base(spark, folder, number) >= LOG:
            _write_whole(spark, folder, number, edges_of(spark, folder, number))
        _tidy(spark, folder, number)

    return batches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
