"""Tables: filter, projection, join on one key, grouped aggregation, union. Plain DataFrame plans, left to Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_rows(t: DataFrame, condition: Column) -> DataFrame:
    return t.where(condition)


def project(t: DataFrame, *columns: str | Column) -> DataFrame:
    return t.select(*columns)


def rename(t: DataFrame, names: dict[str, str]) -> DataFrame:
    """{new: old}."""
    return t.withColumnsRenamed({old: new for new, old in names.items()})


def assign(t: DataFrame, **columns: Column) -> DataFrame:
    return t.withColumns(columns)


def join(a: DataFrame, b: DataFrame, left_key: str, right_key: str, key: str | None = None) -> DataFrame:
    """Inner join on one equality, every pair of matching rows: [key, rest of a, rest of b].

    The key keeps one column, named key, by default as in a. Null keys match nothing. Other names that
    both sides have raise ValueError.
    """
    key = key or left_key
    rest_a, rest_b = [c for c in a.columns if c != left_key], [c for c in b.columns if c != right_key]
    if clash := ({*rest_a} & {*rest_b}) | ({key} & {*rest_a, *rest_b}):
        raise ValueError(f"both sides have the columns {sorted(clash)}")
    return a.withColumnRenamed(left_key, key).join(b.withColumnRenamed(right_key, key), key).select(key, *rest_a, *rest_b)


def aggregate(t: DataFrame, key: str, key_name: str | None = None, **outputs: Column) -> DataFrame:
    """Group by one key: [key, outputs]. Null is a group of its own."""
    return t.groupBy(F.col(key).alias(key_name or key)).agg(*(c.alias(n) for n, c in outputs.items()))


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all operands, duplicates kept; columns by name in the first one's order. Different sets of names raise."""
    for t in others:
        if {*t.columns} != {*first.columns}:
            raise ValueError(f"columns differ: {first.columns} and {t.columns}")
        first = first.unionByName(t)
    return first


def aggregate_python(t: DataFrame, key: str, value: str, f: Callable, result: str = "double") -> DataFrame:
    """Any function of a group's values (a pandas Series), by an Arrow aggregate; for functions that Spark lacks.

    A group's values must fit in one task. Prefer aggregate().
    """
    udf = F.pandas_udf(f, result, F.PandasUDFType.GROUPED_AGG) if not hasattr(f, "evalType") else f
    return t.groupBy(key).agg(udf(t[value]).alias("value"))


def partition_rows(t: DataFrame) -> DataFrame:
    """How the rows lie: (partition, n), of partitions that have any."""
    return t.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))
