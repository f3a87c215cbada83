"""What the operators of this subpackage share: session settings, the shared folder,
and a vectorised word splitter over Arrow string buffers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than these (space and \x09-\x0D).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Buckets that a table has at most, whatever its size: each task then takes several keys in turn.
MOST_BUCKETS = 100_000
_U = np.uint64


# --- session -----------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a
    temporary folder if they are one process (local tests), which then becomes the checkpoint
    folder, else an error: other machines could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        folder = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="knotwork-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str, partitions: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, and what
    reads it again survives the loss of any executor. The table goes when the driver ends, or
    with discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)
    at, fs = _at(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that stored() returned, once nothing reads it any more."""
    at, fs = _at(df.sparkSession, df.stored_path)
    fs.delete(at, True)
    fs.cancelDeleteOnExit(at)


class Buckets:
    """A table in the shared folder in n buckets of a key (at most MOST_BUCKETS): what groups or
    joins such tables of equal n by the key moves no row. It goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str, key: str, n: int):
        self.spark, self.key, self.n = spark, key, min(n, MOST_BUCKETS)
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/{self.name}"

    def add(self, df: DataFrame) -> DataFrame:
        """Write more rows, best dealt out by key already, and return the table as it is then."""
        df.write.mode("append").format("parquet").bucketBy(self.n, self.key).option("compression", "zstd").option("path", self.path).saveAsTable(self.name)
        at, fs = _at(self.spark, self.path)
        fs.deleteOnExit(at)
        return self.spark.table(self.name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more rows than its share is dealt out; no more than HEAVY_KEYS keys can have that.
LEAST_SHARE, HEAVY_KEYS = 256, 100_000


def share_of(rows: int) -> int:
    """How many of so many rows a key may have before salted() cuts it."""
    return max(LEAST_SHARE, -(-rows // HEAVY_KEYS))


def salted(many: DataFrame, one: DataFrame, on: list[str], by: str, count: str, share: int, how: str = "inner") -> DataFrame:
    """many joined with one, which has a row for each key of `on` and in `count` (at least) how
    many rows of many have it. A heavy key's rows are cut into parts of about `share` by a hash
    of `by`, and its row of one is repeated for each part, so no task gets a key whole. With
    share = share_of(rows of many) the broadcast list of heavy keys has HEAVY_KEYS rows at most."""
    parts = F.ceil(F.col(count) / share).cast("int")
    heavy = one.filter(F.col(count) > share).select(*on, parts.alias("_parts"))
    dealt = many.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def fresh(name: str, taken) -> str:
    """A column name like `name` that isn't taken (names differ in more than case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def remainder(key: Column, modulus: int) -> Column:
    """crc32(key as text) mod modulus; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def held_out(key: Column, modulus: int, value: int) -> Column:
    """True where crc32(key as text) mod modulus is value; a null key is never held out."""
    return F.coalesce(remainder(key, modulus) == value, F.lit(False))


# --- 64-bit mixing ---------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    start = np.full(n, seed, _U) * _U(0xD1342543DE82EF95)
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + start)


# --- Arrow strings -----------------------------------------------------------------


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offs, kind, len(arr) + 1, arr.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, budget: int = 2 << 20):
    """Ranges (first, last+1) of rows whose bytes stay within budget, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + budget, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE = randoms(256, 7)[_LOWER]  # A-Z hash as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        m = max(n, 1 << 18)
        ones = np.empty(m, _U)
        ones[0] = 1
        both = []
        for b in (_BASE, _INV):
            step = np.full(m, _U(b))
            step[0] = 1
            both.append(np.multiply.accumulate(step))
        _POW[:] = both
    return _POW[0], _POW[1]


def separators(codes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, A-Z lower-cased, and the rows' word offsets.
    between: which bytes separate words, by default white space.

    Words never cross rows. Work is cut into pieces of about a quarter of a megabyte at
    word boundaries, so temporaries stay small for texts of any length."""
    between = _SPACE if between is None else between
    n, out, starts_out = len(data), [], []
    at, row_starts = 0, offsets[:-1]
    piece = 1 << 18
    while at < n:
        end = min(n, at + piece)
        if end < n:  # move on to the next space or row start
            while end < n:
                tail = between[data[end : end + 4096]]
                k = int(tail.argmax()) if tail.any() else -1
                nxt = offsets[np.searchsorted(offsets, end, side="left")]
                stop = end + k if k >= 0 else end + len(tail)
                if nxt <= stop:
                    end = int(nxt)
                    break
                end = stop
                if k >= 0:
                    break
        d = data[at:end]
        m = len(d)
        space = between[d]
        first = np.empty(m, bool)
        first[0] = True
        first[1:] = space[:-1]
        cuts = offsets[np.searchsorted(offsets, at, side="left") : np.searchsorted(offsets, end, side="left")] - at
        first[cuts] = True
        first &= ~space
        last = np.empty(m, bool)
        last[-1] = True
        last[:-1] = space[1:]
        inner = cuts[cuts > 0] - 1
        last[inner] = True
        last &= ~space
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        if len(s):
            p, inv = _powers(m + 1)
            total = np.empty(m + 1, _U)
            total[0] = 0
            np.cumsum(_BYTE[d] * p[:m], out=total[1:])
            h = (total[e + 1] - total[s]) * inv[s]
            out.append(mix(h + (e - s).astype(_U)))
            starts_out.append(s + at)
        at = end
    if not out:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    starts = np.concatenate(starts_out)
    return np.concatenate(out), np.searchsorted(starts, offsets, side="left").astype(np.int64)


def shingle_hashes(words: np.ndarray, woff: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles in order (a row with fewer words: its whole sequence as
    one; without words: none), and the rows' offsets."""
    n = np.diff(woff)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    off = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    if not off[-1]:
        return np.zeros(0, _U), off
    k = randoms(size, 11) | _U(1)
    pad = np.concatenate([words, np.zeros(size, _U)])
    row = np.repeat(np.arange(len(n)), count)
    start = woff[:-1][row] + (np.arange(off[-1]) - off[:-1][row])
    full = n[row] >= size
    h = np.zeros(len(start), _U)
    length = np.minimum(n[row], size)
    for j in range(size):
        part = pad[start + j] * k[j]
        h += part if full.all() else np.where(j < length, part, _U(0))
    return mix(h + length.astype(_U)), off
