"""Driver-side iteration: lineage cuts in the shared folder, and fixpoints."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of our own if driver and
    executors are one process, else an error: other machines could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = own.get() if own.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="knotwork-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back. The copy survives the loss of
    executors, df is computed once, and plans stay short however many rounds a loop takes. It
    goes when the driver ends, or with discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _at(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table behind a frame that cut() returned, once nothing reads it any more."""
    path = getattr(df, "cut_path", None)
    if path:
        at, fs = _at(df.sparkSession, path)
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)


@dataclass
class Phases:
    """What each phase of a plan resolved and how long it took."""

    rows: list[tuple[str, int, float]] = field(default_factory=list)

    def timed(self, name: str, work: Callable[[], tuple]):
        begun = time.monotonic()
        out = work()
        self.rows.append((name, out[-1], (time.monotonic() - begun) * 1000))
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *r) for i, r in enumerate(self.rows)], "step int, phase string, resolved long, millis double")


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Callable[[DataFrame], object], max_rounds: int = 10_000) -> DataFrame:
    """Apply step until measure(state) no longer changes; each state is cut."""
    before = measure(state)
    for i in range(max_rounds):
        old, state = state, cut(step(state))
        if i:
            discard(old)
        now = measure(state)
        if now == before:
            return state
        before = now
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
