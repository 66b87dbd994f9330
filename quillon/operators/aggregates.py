"""Reducers of aggregate(): boolean sums count the true rows, and length() counts all rows whatever its argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(e: Column) -> Column:
    return F.sum(e)


def count_true(condition: Column) -> Column:
    """The sum of a condition: rows for which it holds; null does not."""
    return F.count_if(condition)


def length(_: Column | None = None) -> Column:
    """Rows of the group."""
    return F.count(F.lit(1))


def maximum(e: Column) -> Column:
    """The largest value; NaN counts as larger than any number."""
    return F.max(e)


def length_unique(e: Column) -> Column:
    """Different non-null values, exactly."""
    return F.count_distinct(e)
