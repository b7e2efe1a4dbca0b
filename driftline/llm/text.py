"""Column expressions on texts that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often
    ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def scanned(values: Column, combine: Callable[..., Column], forward: bool = True, radix: int = 8) -> Column:
    """For each place of an array what ``combine`` makes of all values up to it
    (or from it on): ``radix`` times as many values with each level, so a list
    of n takes n log n steps. ``combine`` takes any number of columns, null
    beyond the ends. A text has fewer than ``radix ** 10`` characters."""

    def level(step: int) -> Callable[[Column], Column]:
        sign = -1 if forward else 1
        return lambda a: F.when(F.size(a) > step, F.transform(a, lambda x, i: combine(x, *[F.get(a, i + sign * j * step) for j in range(1, radix)]))).otherwise(a)

    for k in range(10):
        values = let(values, level(radix**k))
    return values


def added(*values: Column) -> Column:
    """The sum, nulls left out."""
    total = F.coalesce(values[0], F.lit(0))
    for v in values[1:]:
        total = total + F.coalesce(v, F.lit(0))
    return total


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words ``words`` would return, as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text when equal texts are gathered."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
