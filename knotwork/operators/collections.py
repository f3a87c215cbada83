"""Sets, ordered sets, sequences and maps: as tables for any size, as array columns for small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# --- sets: tables with one column -------------------------------------------------------------


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """a without b."""
    return a.subtract(b)


def is_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: is every element of a in b?"""
    return a.subtract(b).agg((F.count("*") == 0).alias("is_subset"))


def contains(a: DataFrame, asked: DataFrame) -> DataFrame:
    """asked with found."""
    c = asked.columns[0]
    return asked.join(a.select(F.col(a.columns[0]).alias(c), F.lit(True).alias("found")).distinct(), c, "left").select(c, F.coalesce("found", F.lit(False)).alias("found"))


# --- ordered sets and sequences: tables with a position ------------------------------------------


def first_appearances(seq: DataFrame, value: str, position: str) -> DataFrame:
    """The ordered set of a sequence: each value once, where it was met first."""
    return seq.groupBy(value).agg(F.min(position).alias(position))


def reversed_sequence(seq: DataFrame, position: str) -> DataFrame:
    top = seq.agg(F.max(position).alias("_t"), F.min(position).alias("_b"))
    return seq.join(F.broadcast(top)).withColumn(position, F.col("_t") + F.col("_b") - F.col(position)).drop("_t", "_b")


def push_front(seq: DataFrame, more: DataFrame, position: str) -> DataFrame:
    """more before seq: its positions must be unique; seq keeps its own."""
    low = seq.agg(F.min(position).alias("_b"))
    top = more.agg(F.max(position).alias("_t"))
    moved = more.join(F.broadcast(low)).join(F.broadcast(top)).withColumn(position, F.col(position) + F.coalesce("_b", F.lit(0)) - F.col("_t") - 1)
    return moved.select(*seq.columns).union(seq)


def push_back(seq: DataFrame, more: DataFrame, position: str) -> DataFrame:
    top = seq.agg(F.max(position).alias("_t"))
    low = more.agg(F.min(position).alias("_b"))
    moved = more.join(F.broadcast(top)).join(F.broadcast(low)).withColumn(position, F.col(position) + F.coalesce("_t", F.lit(-1)) + 1 - F.col("_b"))
    return seq.union(moved.select(*seq.columns))


def pop(seq: DataFrame, position: str, back: bool = True) -> DataFrame:
    end = seq.agg((F.max(position) if back else F.min(position)).alias("_e"))
    return seq.join(F.broadcast(end)).filter(F.col(position) != F.col("_e")).drop("_e")


# --- maps: tables (key, value) ------------------------------------------------------------------


def get(table: DataFrame, asked: DataFrame, default) -> DataFrame:
    """asked(key) with its value or the default."""
    return asked.join(table.select("key", "value"), "key", "left").select("key", F.coalesce("value", F.lit(default)).alias("value"))


def put(table: DataFrame, new: DataFrame) -> DataFrame:
    """Set values; those of new win."""
    return table.join(new.select("key"), "key", "left_anti").select("key", "value").unionByName(new.select("key", "value"))


def remove(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("key").distinct(), "key", "left_anti")


def add(table: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add deltas(key, value) to the values; missing keys start at 0."""
    return table.select("key", "value").unionByName(deltas.select("key", "value")).groupBy("key").agg(F.sum("value").alias("value"))


def extreme(table: DataFrame, largest: bool = True) -> DataFrame:
    """(key, value) of the largest or least value; of equal ones the least key."""
    if largest:
        best = F.max(F.struct(F.col("value"), (-F.col("key")).alias("k")))
        return table.agg(best.alias("b")).filter("b is not null").select((-F.col("b.k")).alias("key"), F.col("b.value").alias("value"))
    return table.agg(F.min(F.struct("value", "key")).alias("b")).filter("b is not null").select("b.key", "b.value")


# --- small ones as array columns ------------------------------------------------------------------


def array_is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def ordered_set(a: Column) -> Column:
    return F.array_distinct(a)


# --- reductions that the runtime does with atomics -------------------------------------------------


def reductions(df: DataFrame, value: str, flag: str, *by: str) -> DataFrame:
    """sum, product, least, most of value, all and any of flag; identities on no rows."""
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(value), F.lit(0)).alias("total"),
        F.coalesce(F.product(value), F.lit(1.0)).alias("product"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.coalesce(F.bool_and(flag), F.lit(True)).alias("every"),
        F.coalesce(F.bool_or(flag), F.lit(False)).alias("some"),
    )


def bitmaps(members: DataFrame, v: str) -> DataFrame:
    """(bucket, bits): the members as bitmaps of 32 768 bits each."""
    return members.groupBy(F.bitmap_bucket_number(F.col(v) + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(v) + 1)).alias("bits"))
