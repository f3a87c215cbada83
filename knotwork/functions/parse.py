"""Tokens and typed values out of text, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Value kinds and their Spark types; what a missing value is for each.
TYPES = {"bool": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "node": "bigint", "edge": "bigint", "string": "string"}
DEFAULTS = {"bool": False, "int": 0, "long": 0, "float": 0.0, "double": 0.0, "node": -1, "edge": -1, "string": ""}


def tokens(text: Column, delimiters: str = " \t") -> Column:
    """The non-empty tokens between delimiter characters. A token in double quotes may hold
    delimiters; a backslash escapes the next character. Quotes and escapes stay in the token."""
    d = re.escape(delimiters)
    found = F.regexp_extract_all(text, F.lit(rf'((?:"(?:\\.|[^"\\])*"|\\.|[^{d}"\\])+)'), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def unquoted(token: Column) -> Column:
    """Without the quotes around and with escapes resolved."""
    inner = F.regexp_replace(token, r'^"(.*)"$', "$1")
    return F.regexp_replace(inner, r"\\(.)", "$1")


def parse(token: Column, kind: str) -> Column:
    """A token as a value: a leading number as atoi and atof take it (0 if there is none),
    true for 1 or true in any case, unquoted text."""
    if kind == "bool":
        return F.lower(F.trim(token)).isin("1", "true")
    if kind == "string":
        return unquoted(token)
    if kind in ("float", "double"):
        number = F.regexp_extract(token, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    else:
        number = F.regexp_extract(token, r"^\s*([+-]?\d+)", 1)
    return F.coalesce(F.nullif(number, F.lit("")).try_cast(TYPES[kind]), F.lit(0).cast(TYPES[kind]))


def with_default(value: Column, kind: str) -> Column:
    return F.coalesce(value, F.lit(DEFAULTS[kind]).cast(TYPES[kind]))
