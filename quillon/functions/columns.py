"""Scalar functions on columns, all inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of 32-bit integers, which stand for missing values in old files.
INT_MIN, INT_MAX = -(2**31), 2**31 - 1

#: The coefficients of formula 7.1.26 of Abramowitz and Stegun, and its p.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def erf(x: Column) -> Column:
    """Error function, to about 1.5e-7; null stays null."""
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    series = F.lit(0.0)
    for a in reversed(ERF):
        series = (series + F.lit(a)) * t
    return F.signum(x) * (1.0 - series * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 + 0.5 * erf(x * 0.707106781)


def log10(x: Column) -> Column:
    """Logarithm of base 10 as in IEEE and SQL: -inf at 0 and NaN below, where Spark's own gives null; null stays null."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log10(x))


def argmin(values: Column) -> Column:
    """1-based place of the least entry of an array, the first of equal ones."""
    return F.array_position(values, F.array_min(values))


def vector(*cols: Column | str) -> Column:
    """Columns side by side as one array of doubles: a row of the sample matrix."""
    return F.array(*((F.col(c) if isinstance(c, str) else c).cast("double") for c in cols))


def dot(values: Column, weights: list[float]) -> Column:
    """Product of an array column with fixed weights, unrolled."""
    total = F.lit(0.0)
    for k, w in enumerate(weights):
        total = total + values[k] * F.lit(float(w))
    return total


def distance(values: Column, centre: list[float]) -> Column:
    """Euclidean distance of an array column from a fixed point, unrolled."""
    total = F.lit(0.0)
    for k, c in enumerate(centre):
        total = total + (values[k] - F.lit(float(c))) * (values[k] - F.lit(float(c)))
    return F.sqrt(total)


def from_sentinel(c: Column, sentinel: int | float = INT_MAX) -> Column:
    """A column in which the sentinel stands for a missing value, with nulls instead."""
    return F.when(c != F.lit(sentinel), c)


def to_sentinel(c: Column, sentinel: int | float = INT_MAX) -> Column:
    return F.coalesce(c, F.lit(sentinel))
