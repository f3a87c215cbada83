"""Numbers without state: seeded random draws and bit tests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def random_long(key: Column, seed: int) -> Column:
    """A 64-bit draw for a key, the same on every run."""
    return F.xxhash64(key, F.lit(seed))


def random_uniform(key: Column, seed: int) -> Column:
    """A draw from [0, 1)."""
    return F.shiftrightunsigned(random_long(key, seed), 11) * F.lit(2.0**-53)


def random_below(key: Column, seed: int, n: int) -> Column:
    return F.floor(random_uniform(key, seed) * n).cast("long")


def xorshift32(x: Column) -> Column:
    """The next state of a 32-bit xorshift generator (shifts 13, 17, 5)."""
    low = F.lit(0xFFFFFFFF)
    x = x.bitwiseXOR(F.shiftleft(x, 13).bitwiseAND(low))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 17))
    return x.bitwiseXOR(F.shiftleft(x, 5).bitwiseAND(low)).bitwiseAND(low)


def xorshift64(x: Column) -> Column:
    """The next state of a 64-bit xorshift generator (shifts 13, 7, 17) over signed numbers."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftright(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def bit(bits: Column, n: Column) -> Column:
    """Bit n of a number."""
    return F.call_function("bit_get", bits, n.cast("int"))


def with_bit(bits: Column, n: Column, on: bool = True) -> Column:
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    return bits.bitwiseOR(mask) if on else bits.bitwiseAND(F.bitwise_not(mask))
