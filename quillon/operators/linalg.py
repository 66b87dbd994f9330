"""Matrices: samples as rows with an array `features`, or entries (i, j, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import dot


def project_samples(x: DataFrame, weights: np.ndarray, features: str = "features") -> DataFrame:
    """x with product: the array of the weights' rows times each sample. Per row; the weights are literals."""
    return x.withColumn("product", F.array(*(dot(F.col(features), list(w)) for w in np.atleast_2d(weights))))


#: Sums of products that one aggregation holds as columns; wider matrices are added up block by block in the tasks.
COLUMNS = 64


def reduce_products(x: DataFrame, left: list[Column], right: list[Column]) -> np.ndarray:
    """The matrix of sums of left[a] * right[b] over all samples: what is shuffled is one row per task, or for wide ones one per task and entry."""
    if len(left) * len(right) <= COLUMNS:
        row = x.agg(*(F.sum(a * b) for a in left for b in right)).first()
        return np.array([v or 0.0 for v in row], float).reshape(len(left), len(right))
    return cross_products(x.select(F.array(*(c.cast("double") for c in left)).alias("l"), F.array(*(c.cast("double") for c in right)).alias("r")), len(left), len(right))


def cross_products(x: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The same for array columns l and r of those lengths. Samples with a null in either add nothing."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((rows, columns))
        for b in batches:
            if len(b):
                l, r = np.stack(b["l"].to_list()), np.stack(b["r"].to_list())
                ok = ~(np.isnan(l).any(1) | np.isnan(r).any(1))
                total += l[ok].T @ r[ok]
        yield pd.DataFrame({"k": np.arange(total.size), "v": total.ravel()})

    got = x.where("l is not null and r is not null").mapInPandas(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(rows * columns)
    out[got["k"].to_numpy(int)] = got["v"]
    return out.reshape(rows, columns)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two matrices of entries (i, j, value): a join on the inner index and a sum per entry."""
    return a.select("i", F.col("j").alias("_k"), F.col("value").alias("_a")).join(b.select(F.col("i").alias("_k"), "j", F.col("value").alias("_b")), "_k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))


def to_blocks(m: DataFrame, block: int = 128) -> DataFrame:
    """Entries (i, j, value) as dense square blocks (bi, bj, block): row after row, what is missing is 0."""
    size = block * block

    def fill(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(size)
        np.add.at(v, b["i"].to_numpy() % block * block + b["j"].to_numpy() % block, b["value"].to_numpy(float))
        return pd.DataFrame({"bi": [key[0]], "bj": [key[1]], "block": [v]})

    x = m.select(F.expr(f"i div {block}").alias("bi"), F.expr(f"j div {block}").alias("bj"), "i", "j", "value")
    return x.groupBy("bi", "bj").applyInPandas(fill, "bi long, bj long, block array<double>")


def from_blocks(m: DataFrame, block: int = 128) -> DataFrame:
    """The entries (i, j, value) of blocks that are not 0."""
    x = m.select("bi", "bj", F.posexplode("block").alias("_k", "value")).where("value <> 0")
    return x.select((F.col("bi") * block + F.expr(f"_k div {block}")).alias("i"), (F.col("bj") * block + F.col("_k") % block).alias("j"), "value")


def write_blocks(m: DataFrame, path: str) -> None:
    """Store a blocked matrix: a Parquet table partitioned by row of blocks."""
    m.write.mode("overwrite").partitionBy("bi").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("bi").cast("long").alias("bi"), "bj", "block")


def multiply_blocks(a: DataFrame, b: DataFrame, block: int = 128) -> DataFrame:
    """Product of two blocked matrices: blocks meet on the inner index, each pair is one dense product, and those of an entry of blocks are added up as they come."""

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"bi": p["bi"], "bj": p["bj"], "block": [(np.reshape(x, (block, block)) @ np.reshape(y, (block, block))).ravel() for x, y in zip(p["x"], p["y"])]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for p in batches:
            done = []
            for i, j, v in zip(p["bi"], p["bj"], p["block"]):
                if (i, j) != at:
                    if at is not None:
                        done.append((*at, total))
                    at, total = (i, j), np.zeros(block * block)
                total = total + v
            yield pd.DataFrame(done, columns=["bi", "bj", "block"])
        if at is not None:
            yield pd.DataFrame([(*at, total)], columns=["bi", "bj", "block"])

    shape = "bi long, bj long, block array<double>"
    x = a.select("bi", F.col("bj").alias("_k"), F.col("block").alias("x")).join(b.select(F.col("bi").alias("_k"), "bj", F.col("block").alias("y")), "_k")
    x = x.select("bi", "bj", "x", "y").mapInPandas(product, shape)
    return x.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInPandas(add, shape)


def reshape(a: DataFrame, rows: int) -> DataFrame:
    """An array (idx from 0, value) as a matrix of so many rows, column after column: entries (i, j, value)."""
    return a.select((F.col("idx") % rows).alias("i"), F.expr(f"idx div {rows}").alias("j"), "value")


def product_with_vector(m: DataFrame, v: DataFrame) -> DataFrame:
    """Matrix of entries times an array (idx, value): (idx, value), a join on the inner index and a sum per row."""
    return m.join(v.select(F.col("idx").alias("j"), F.col("value").alias("_v")), "j").groupBy(F.col("i").alias("idx")).agg(F.sum(F.col("value") * F.col("_v")).alias("value"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def entries(x: DataFrame, row: str = "idx", features: str = "features") -> DataFrame:
    """Samples as entries: i is the sample, j the feature from 0."""
    return x.select(F.col(row).alias("i"), F.posexplode(features).alias("j", "value"))
