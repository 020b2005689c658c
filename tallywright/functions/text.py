"""String helpers that follow Python's rules where Spark's differ."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything Python's str.strip() removes; Spark's trim() removes spaces only.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# The same characters, and Python's word characters, for regexes; Java's own classes are ASCII.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def strip_chars(value: Column, chars: str) -> Column:
    return F.btrim(value, F.lit(chars))


def contains_any(value: Column, words: list[str]) -> Column:
    """Whether any of the words occurs in the text as it is.

    Plain substring searches beat one alternation regex several times over on long texts.
    """
    return reduce(operator.or_, [value.contains(w) for w in words])


def non_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def lines(value: Column) -> Column:
    return F.split(value, "\n")


def ordered_lookup(key: Column, table: dict[str, Column], default: Column) -> Column:
    """Lookup in a small fixed table, kept inside the expression (no join)."""
    out = None
    for name, value in table.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return default if out is None else out.otherwise(default)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often ``use`` names it.

    Inside lambdas Spark evaluates a repeated expression each time it appears; a lambda
    variable is evaluated once.
    """
    return F.transform(F.array(value), use)[0]
