"""Ordered arrays, as DataFrames with idx (unique, long) and value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a span of idx, which one window task sorts; only one row per span meets in a single task.
BLOCK = 1 << 20


def _blocks(a: DataFrame, block: int | None) -> DataFrame:
    """a with its span _b: of `block` in idx, by default as wide as holds BLOCK rows on average, so that gaps in idx do not matter."""
    if block is None:
        low, high, n = a.agg(F.min("idx"), F.max("idx"), F.count("*")).first()
        block = max(1, (high - low + 1) * BLOCK // n) if n else BLOCK
    return a.withColumn("_b", F.expr(f"floor(idx / {block})"))


def cumsum(a: DataFrame, block: int | None = None) -> DataFrame:
    """Inclusive prefix sums (idx, value) in the order of idx.

    Sums within spans of idx, plus the sum of earlier spans: the window without a key runs over one row
    per span. Null values add nothing.
    """
    a = _blocks(a.select("idx", "value"), block)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = a.groupBy("_b").agg(F.sum("value").alias("_s")).select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    run = F.sum("value").over(Window.partitionBy("_b").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return a.withColumn("_run", run).join(base, "_b").select("idx", (F.coalesce("_run", F.lit(0)) + F.col("_base")).alias("value"))


def stencil(a: DataFrame, f: Callable[[Column, Column, Column], Column], block: int | None = None) -> DataFrame:
    """f(previous, this, next) for each element of (idx, value); the first and the last keep their value.

    Neighbours across spans come from a table of each span's first and last value.
    """
    a = _blocks(a.select("idx", "value"), block)
    ends = a.groupBy("_b").agg(F.min_by("value", "idx").alias("_first"), F.max_by("value", "idx").alias("_last"))
    w = Window.orderBy("_b")
    ends = ends.select("_b", F.lag(F.struct(F.col("_last").alias("v"))).over(w).alias("_left"), F.lead(F.struct(F.col("_first").alias("v"))).over(w).alias("_right"))
    within = Window.partitionBy("_b").orderBy("idx")
    here = F.struct(F.col("value").alias("v"))
    x = a.withColumns({"_p": F.lag(here).over(within), "_n": F.lead(here).over(within)}).join(ends, "_b")
    x = x.withColumns({"_p": F.coalesce("_p", "_left"), "_n": F.coalesce("_n", "_right")})
    new = F.when(F.col("_p").isNull() | F.col("_n").isNull(), F.col("value")).otherwise(f(F.col("_p.v"), F.col("value"), F.col("_n.v")))
    return x.select("idx", new.alias("value"))


def mask(a: DataFrame, condition: Column) -> DataFrame:
    return a.where(condition)


def elementwise(a: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return a.select("idx", f(F.col("value")).alias("value"))


def array_sum(a: DataFrame) -> DataFrame:
    return a.agg(F.sum("value").alias("value"))


def array_max(a: DataFrame) -> DataFrame:
    return a.agg(F.max("value").alias("value"))


def concat(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Arrays one after another; idx of later ones moves past the largest so far, by one small action each."""
    for b in others:
        at = (first.agg(F.max("idx")).first()[0] or 0) + 1
        low = b.agg(F.min("idx")).first()[0] or 0
        first = first.unionByName(b.withColumn("idx", F.col("idx") - low + at))
    return first


def prefix_lag_sessions(t: DataFrame, key: str, order: list[str], seconds: Column, timeout: float) -> DataFrame:
    """t plus session (from 0): a new one starts where more than timeout seconds have passed since the row before, per key."""
    w = Window.partitionBy(key).orderBy(*order)
    t = t.withColumn("_at", seconds)
    t = t.withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(w) > timeout).cast("long"), F.lit(0).cast("long")))
    return t.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_at", "_new")
