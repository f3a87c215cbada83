"""Column helpers for the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import LOWER, UPPER


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null or blank text."""
    split = F.split(F.coalesce(lower_ascii(text), F.lit("")), r"[\x20\x09-\x0D]+", -1)
    # only the first and the last piece can be empty
    return F.filter(split, lambda w: w != "")


def running_sums(xs: Column, block: int = 256) -> Column:
    """Sums of xs[0..i] for each i of a bound array column, in n * block steps at most."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def blocks(n: Column) -> Column:
        return F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))

    return F.when(F.size(xs) == 0, F.array().cast("array<bigint>")).otherwise(
        let(
            F.transform(blocks(F.size(xs)), lambda j: total(F.slice(xs, j * block + 1, F.lit(block)))),
            lambda sums: let(
                F.transform(blocks(F.size(xs)), lambda j: total(F.slice(sums, F.lit(1), j))),
                lambda before: F.transform(xs, lambda _, i: F.element_at(before, F.floor(i / block).cast("int") + 1) + total(F.slice(xs, F.floor(i / block).cast("int") * block + 1, i % block + 1))),
            ),
        )
    )
