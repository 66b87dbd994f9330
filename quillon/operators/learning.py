"""Learning over samples with an array `features`: library calls and programs that iterate on the driver.

Each iteration is one aggregation over the samples; only sums reach the driver. Loops hold the samples while they run.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot
from .linalg import reduce_products


def _features(width: int) -> list[Column]:
    return [F.col("features")[k] for k in range(width)]


def linear_step(x: DataFrame, w: np.ndarray, rate: float) -> np.ndarray:
    """One step of gradient descent, w - rate * (w X - Y) X'. x: features, labels (array)."""
    errors = [dot(F.col("features"), list(r)) - F.col("labels")[k] for k, r in enumerate(w)]
    return w - rate * reduce_products(x, errors, _features(w.shape[1]))


@contextmanager
def held(x: DataFrame):
    """x in memory or on disk for the passes of one loop."""
    x = x.persist()
    try:
        yield x
    finally:
        x.unpersist()


def linear_descent(x: DataFrame, width: int, responses: int, iterations: int, rate: float | None = None) -> np.ndarray:
    """Weights (responses by features) from zeros; the default rate is 0.01 by the number of samples."""
    w = np.zeros((responses, width))
    with held(x.select("features", "labels")) as x:
        rate = 0.01 / max(1, x.count()) if rate is None else rate
        for _ in range(iterations):
            w = linear_step(x, w, rate)
    return w


def logistic_step(x: DataFrame, w: np.ndarray) -> np.ndarray:
    """w less the sum of (sigmoid(y w x) - 1) y x; x: features, label (1 or -1). A rate of 1, as programs of this kind use."""
    y = F.col("label")
    pull = (1.0 / (1.0 + F.exp(-y * dot(F.col("features"), list(w)))) - 1.0) * y
    return w - reduce_products(x, [pull], _features(len(w)))[0]


def logistic_regression(x: DataFrame, width: int, iterations: int, start: np.ndarray | None = None) -> np.ndarray:
    """So many logistic steps, from zeros unless start is given."""
    w = np.zeros(width) if start is None else start
    with held(x.select("features", "label")) as x:
        for _ in range(iterations):
            w = logistic_step(x, w)
    return w


def kmeans_step(x: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Means of the samples nearest to each centre, the first of equally near ones; a centre without samples stays.

    Each task adds up its samples by centre; what is shuffled is one row per task and centre.
    """
    k, d = centres.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((k, d)), np.zeros(k, np.int64)
        for b in batches:
            for at in range(0, len(b), max(1, (1 << 20) // (k * d))):
                v = np.stack(b["features"].iloc[at : at + max(1, (1 << 20) // (k * d))].to_list()).astype(float)
                c = ((v[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
                np.add.at(total, c, v)
                n += np.bincount(c, minlength=k)
        if n.any():
            yield pd.DataFrame({"c": np.flatnonzero(n), "n": n[n > 0], "s": list(total[n > 0])})

    part = x.select("features").mapInPandas(sums, "c long, n long, s array<double>").select("c", "n", F.posexplode("s").alias("j", "v"))
    new = centres.astype(float).copy()
    for r in part.groupBy("c", "j").agg((F.sum("v") / F.sum("n")).alias("m")).collect():
        new[r["c"], r["j"]] = r["m"]
    return new


def kmeans(x: DataFrame, k: int, iterations: int, start: np.ndarray | None = None, order: str = "idx", seed: int = 1) -> np.ndarray:
    """Exactly `iterations` Lloyd steps from `start`, or from k random samples by a seeded hash of `order`. Returns k by features."""
    with held(x) as x:
        if start is None:
            start = np.array([r[0] for r in x.orderBy(F.xxhash64(F.lit(seed), F.col(order)), order).limit(k).select("features").collect()], float)
        for _ in range(iterations):
            start = kmeans_step(x, start)
    return start


def linear_regression(x: DataFrame, width: int, responses: int) -> np.ndarray:
    """Least squares with intercept: (features + 1) by responses, the intercept first.

    One pass sums the normal equations, centred by the means of a first pass; lstsq solves them, so collinear features get the least norm.
    """
    f, y = _features(width), [F.col("labels")[k] for k in range(responses)]
    row = x.agg(*(F.avg(c) for c in (*f, *y))).first()
    mean = np.array([v or 0.0 for v in row], float)
    cf, cy = [c - F.lit(m) for c, m in zip(f, mean)], [c - F.lit(m) for c, m in zip(y, mean[width:])]
    s = reduce_products(x, cf, [*cf, *cy])
    w = np.linalg.lstsq(s[:, :width], s[:, width:], rcond=None)[0]
    return np.vstack([mean[width:] - mean[:width] @ w, w])


def naive_bayes(x: DataFrame, width: int, label: str = "label", smoothing: float = 1.0) -> DataFrame:
    """Multinomial naive Bayes: one row per class, with prior (log) and likelihood (array of logs); features must not be negative.

    Both are smoothed, as spark.ml does it. Sums per class are the only shuffle.
    """
    s = x.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.array(*(F.sum(v) for v in _features(width))).alias("s"))
    classes, rows = s.agg(F.count("*"), F.sum("n")).first()
    each = F.aggregate("s", F.lit(0.0), lambda a, v: a + v)
    return s.select("label", (F.log(F.col("n") + smoothing) - F.log(F.lit((rows or 0) + smoothing * classes))).alias("prior"), F.transform("s", lambda v: F.log(v + smoothing) - F.log(each + smoothing * width)).alias("likelihood"))


def spark_kmeans(x: DataFrame, k: int, iterations: int, seed: int = 1) -> np.ndarray:
    """The library's k-means on the same samples, started at random and without an early stop."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    return np.array(KMeans(k=k, maxIter=iterations, initMode="random", tol=0.0, seed=seed).fit(x.select(array_to_vector("features").alias("features"))).clusterCenters())
