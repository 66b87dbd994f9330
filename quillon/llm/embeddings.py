"""Operator 4: near duplicates among embeddings, by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, tasks
from .components import Forest, connected_components

#: Vectors of a sequence interval that one task joins with another, and of a leaf of the recursion.
BLOCK, LEAF = 1024, 128
#: Leading principal dimensions of the grid.
DIMS = 6


def principal_axes(vectors: DataFrame, dims: int = DIMS) -> np.ndarray:
    """The leading principal axes (rows) of all unit vectors, from sums of products added up in Spark.

    The driver receives one row per pair of dimensions, however many vectors there are.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, part in b.groupby(b["unit"].map(len))["unit"]:
                x = np.stack(part.to_list())
                x = np.c_[np.ones(len(x)), x]
                total[d] = total.get(d, 0) + x.T @ x
        for d, t in total.items():
            yield pd.DataFrame({"d": d, "k": np.arange(t.size), "v": t.ravel()})

    rows = vectors.select("unit").mapInPandas(sums, "d long, k long, v double").groupBy("d", "k").agg(F.sum("v").alias("v")).toPandas()
    if rows.empty:
        return np.zeros((dims, 1))
    d = int(rows[rows["k"] == 0].sort_values(["v", "d"])["d"].iloc[-1])
    t = rows[rows["d"] == d].sort_values("k")["v"].to_numpy().reshape(d + 1, d + 1)
    mean = t[0, 1:] / t[0, 0]
    _, axes = np.linalg.eigh(t[1:, 1:] / t[0, 0] - np.outer(mean, mean))
    axes = axes[:, ::-1].T[:dims]
    return np.pad(axes, ((0, dims - len(axes)), (0, 0)))


def _sequence(axes: np.ndarray, eps: float):
    """Adds the projections p and the grid cells of vectors of the axes' length; others stay at the origin, which skips nothing."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = np.stack([axes @ u if len(u) == axes.shape[1] else np.zeros(len(axes)) for u in b["unit"]]) if len(b) else np.zeros((0, len(axes)))
            yield b.assign(p=list(p), cell=list(np.floor(p / eps).astype(np.int64)))

    return each


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cuts each group's sorted rows into intervals of at most BLOCK; an interval bears its first id."""
    group, first, n = None, None, 0
    for b in batches:
        names = []
        for g, i in zip(b["grp"], b["id"]):
            if g != group or n == BLOCK:
                group, first, n = g, i, 0
            n += 1
            names.append(first)
        yield b.assign(block=names)[["grp", "block", "id", "n", "unit", "p"]]


def join_intervals(a: tuple, b: tuple, eps: float, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts and roots for two intervals (ids, weights, unit vectors, projections).

    Halves the longer interval until both are short, skipping pairs whose boxes lie further apart than
    eps; short ones are compared exactly. Returns weights linked and,
    per row of each, the smallest id that the links of all short ones together reach.
    """
    (ia, wa, ua, pa), (ib, wb, ub, pb) = a, b
    na, nb, f = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64), Forest()
    if same:
        nb = na
    todo = [(0, len(ia), 0, len(ib))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and a0 > b0:
            continue
        x, y = pa[a0:a1], pb[b0:b1]
        gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        if gap @ gap > eps * eps:
            continue
        if max(a1 - a0, b1 - b0) > LEAF:
            ma, mb = (a0 + a1) // 2, (b0 + b1) // 2
            todo += [(i, j, k, m) for i, j in ((a0, ma), (ma, a1)) for k, m in ((b0, mb), (mb, b1)) if i < j and k < m]
            continue
        near = ua[a0:a1] @ ub[b0:b1].T >= least
        diagonal = same and a0 == b0
        if diagonal:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        na[a0:a1] += near @ wb[b0:b1]
        if not diagonal:
            nb[b0:b1] += near.T @ wa[a0:a1]
        ra, rb = ia[a0:a1].copy(), ib[b0:b1].copy()
        while True:  # roots sink to the smallest of the linked ones
            ra = np.minimum(ra, np.where(near, rb[None, :], np.iinfo(np.int64).max).min(1))
            yb = np.minimum(rb, np.where(near, ra[:, None], np.iinfo(np.int64).max).min(0))
            done = (yb == rb).all()
            rb = yb
            if done:
                break
        for x, r in zip((*ia[a0:a1].tolist(), *ib[b0:b1].tolist()), (*ra.tolist(), *rb.tolist())):
            if x != r:
                f.link(x, r)
    root = lambda ids: np.array([f.root(x) for x in ids.tolist()], np.int64)
    return na, nb, root(ia), root(ib)


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per vector (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only equal, non-null labels and equal lengths are compared, by cosine in double precision. A vector
    that is null, empty, zero or holds null or non-finite values links with nothing; it keeps itself.
    Equal vectors of a label become one row with a count first, so copies never meet. Cosine >= least
    means that unit vectors lie within eps = sqrt(2 - 2 * least): rows are sorted by label and grid
    cells of width eps on the leading principal axes and cut into intervals; only intervals whose boxes
    lie within eps are joined, each pair in a task of its own of at most 2 * BLOCK rows, which returns a
    count and a root per row, never pairs.
    """
    spark, eps = vectors.sparkSession, float(np.sqrt(2 - 2 * least)) * (1 + 1e-9)
    e = F.transform("embedding", lambda x: x.cast("double"))
    all_ = vectors.select("vec_id", F.col("label").cast("string").alias("grp"), e.alias("vec"))
    fine = F.col("grp").isNotNull() & F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    all_ = durable(all_.withColumn("vec", F.when(fine, F.transform("vec", lambda x: x + F.lit(0.0)))))
    one = all_.where("vec is not null and vec_id is not null").groupBy("grp", "vec").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("n"))

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scaled = [v / np.abs(v).max() for v in b["vec"]]
            u = [v / np.sqrt(v @ v) for v in scaled]
            yield b.drop(columns="vec").assign(unit=u)

    one = durable(one.mapInPandas(unit, "grp string, id long, n long, unit array<double>"))
    placed = one.mapInPandas(_sequence(principal_axes(one), eps), "grp string, id long, n long, unit array<double>, p array<double>, cell array<long>")
    placed = placed.repartitionByRange(tasks(spark), "grp", "cell", "id").sortWithinPartitions("grp", "cell", "id").drop("cell")
    rows = durable(placed.mapInPandas(_intervals, "grp string, block long, id long, n long, unit array<double>, p array<double>"))

    p = [F.col("p")[k] for k in range(DIMS)]
    box = rows.groupBy("grp", "block").agg(*(F.min(x).alias(f"lo{k}") for k, x in enumerate(p)), *(F.max(x).alias(f"hi{k}") for k, x in enumerate(p)))
    box = durable(box.withColumn("c", F.explode(F.sequence(F.floor(F.col("lo0") / eps), F.floor(F.col("hi0") / eps) + 1))))
    a, b = box.alias("a"), box.alias("b")
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}")), 2) for k in range(DIMS)), F.lit(0.0))
    near = (F.col("a.grp") == F.col("b.grp")) & (F.col("a.c") == F.col("b.c")) & (F.col("a.block") <= F.col("b.block")) & (gap <= eps * eps)
    pairs = a.join(b, near).select(F.col("a.block").alias("i"), F.col("b.block").alias("j")).distinct()
    ways = pairs.select(F.col("i").alias("block"), "i", "j").unionByName(pairs.where("i <> j").select(F.col("j").alias("block"), "i", "j"))

    def joined(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        i, j = key

        def side(x: pd.DataFrame) -> tuple:
            p = np.stack(x["p"].to_list())
            order = np.lexsort(np.floor(p / eps).T[::-1])
            return x["id"].to_numpy()[order], x["n"].to_numpy()[order], np.stack(x["unit"].to_list())[order], p[order]

        out = []
        for _, c in b.groupby(b["unit"].map(len)):
            x, y = c[c["block"] == i], c[c["block"] == j]
            if len(x) and len(y):
                sx = side(x)
                sy = sx if i == j else side(y)
                na, nb, ra, rb = join_intervals(sx, sy, eps, least, i == j)
                out.append(pd.DataFrame({"id": sx[0], "n": na, "root": ra}))
                if i != j:
                    out.append(pd.DataFrame({"id": sy[0], "n": nb, "root": rb}))
        r = pd.concat(out) if out else pd.DataFrame({"id": [], "n": [], "root": []}, dtype="int64")
        return r[r["n"] > 0]

    found = durable(rows.join(ways, "block").groupBy("i", "j").applyInPandas(joined, "id long, n long, root long"))
    parts = connected_components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("id").agg(F.sum("n").alias("m"))
    reps = all_.where("vec is not null and vec_id is not null").groupBy("grp", "vec").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("n"))
    reps = reps.join(links, "id", "left").join(parts, "id", "left").select("grp", "vec", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = all_.join(reps, ["grp", "vec"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", F.col("vec_id")).cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
