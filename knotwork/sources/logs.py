"""Run logs as rows, and runs side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path) -> DataFrame:
    """(log, line, value) of log files, lines numbered in their file's order. Files are logs of
    some kilobytes; each is read whole."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("log"), "value")
    return files.select("log", F.posexplode(F.split("value", "\n")).alias("line", "value"))


def runs(lines: DataFrame) -> DataFrame:
    """(log, file, method, threads, runtime_ms, scc_count): one row for each count line, with
    what the lines before it said last."""
    w = Window.partitionBy("log").orderBy("line")
    head = r"data=(\S+) (\d+) (\d+)"
    said = lambda pattern, i: F.last(F.nullif(F.regexp_extract("value", pattern, i), F.lit("")), ignorenulls=True).over(w)
    rows = lines.withColumns({
        "file": said(head, 1), "method": said(head, 2).cast("int"), "threads": said(head, 3).cast("int"),
        "runtime_ms": said(r"running_time\(ms\)=\s*([0-9.]+)", 1).cast("double"),
        "count": F.nullif(F.regexp_extract("value", r"SCCs\s*=\s*(\d+)", 1), F.lit("")).cast("long"),
    })
    return rows.filter("count is not null").select("log", "file", "method", "threads", "runtime_ms", F.col("count").alias("scc_count"))


def write_runs(rows: DataFrame, path: str) -> None:
    """As CSV with a header, without the runs of method 2."""
    rows.filter("method <> 2").select(F.col("file").alias("Filename"), "method", "threads", F.col("runtime_ms").alias("runtime"), "scc_count").write.option("header", True).csv(path)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Runs of two builds, joined by file and method: speedup of b over a, whether the counts
    agree, and which won (a ratio within 5 % is a tie)."""
    x = a.select("file", "method", F.col("runtime_ms").alias("a_ms"), F.col("scc_count").alias("a_count"))
    y = b.select("file", "method", F.col("runtime_ms").alias("b_ms"), F.col("scc_count").alias("b_count"))
    both = x.join(y, ["file", "method"], "full")
    speedup = F.when(F.col("b_ms") > 0, F.col("a_ms") / F.col("b_ms"))
    won = F.when(speedup >= 1.05, "b").when(speedup <= 0.95, "a").when(F.isnotnull(speedup), "tie")
    return both.withColumns({"speedup": speedup, "counts_match": F.coalesce(F.col("a_count") == F.col("b_count"), F.lit(False)), "winner": won})


def totals(compared: DataFrame) -> DataFrame:
    """One row: runs, summed times, overall speedup, wins, and counts that agree."""
    t = compared.agg(
        F.count("*").alias("runs"), F.sum("a_ms").alias("a_ms"), F.sum("b_ms").alias("b_ms"),
        F.count(F.when(F.col("winner") == "a", 1)).alias("a_wins"), F.count(F.when(F.col("winner") == "b", 1)).alias("b_wins"),
        F.count(F.when(F.col("counts_match"), 1)).alias("matches"),
    )
    return t.withColumn("speedup", F.when(F.col("b_ms") > 0, F.col("a_ms") / F.col("b_ms")))
