import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import columns as fn
from quillon.operators import arrays as ar
from quillon.operators import learning as ml
from quillon.operators import linalg as la
from quillon.operators import loops
from quillon.plans import bigbench as bb
from quillon.plans import catalog
from quillon.sources import tables as src


def array(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "idx long, value double").repartition(3)


def values(a):
    return [r["value"] for r in a.orderBy("idx").collect()]


@pytest.mark.parametrize("block", [2, 3, 100])
def test_stencil_and_cumsum(spark, block):
    a = array(spark, [1.2, 2.1, 3.1, 3.2, 1.9])
    assert values(ar.stencil(a, lambda p, x, n: (p + 2 * x + n) / 4, block)) == pytest.approx([1.2, 2.125, 2.875, 2.85, 1.9])
    assert values(ar.cumsum(a, block)) == pytest.approx([1.2, 3.3, 6.4, 9.6, 11.5])
    assert ar.array_sum(ar.cumsum(src.ones(spark, 5), block)).first()[0] == 15.0


def test_one_element_and_none(spark):
    assert values(ar.stencil(array(spark, [7.0]), lambda p, x, n: p)) == [7.0]
    assert values(ar.cumsum(array(spark, []))) == []


def test_functions(spark):
    x = spark.createDataFrame([(v,) for v in (-2.0, -0.3, 0.0, 0.5, 3.0)], "x double").select("x", fn.erf(F.col("x")).alias("y")).collect()
    assert all(abs(math.erf(r["x"]) - r["y"]) < 2e-7 for r in x)
    assert spark.range(1).select(fn.argmin(F.array(F.lit(3.0), F.lit(1.0), F.lit(1.0)))).first()[0] == 2


def test_sources_round_trip(spark, tmp_path):
    a = array(spark, [4.0, 1.0, 3.0])
    src.write_array(a, f"{tmp_path}/f", "/y")
    src.write_array(src.zeros(spark, 2), f"{tmp_path}/f", "/z")
    assert values(src.read_array(spark, f"{tmp_path}/f", "/y")) == [4.0, 1.0, 3.0]
    src.write_text(a, f"{tmp_path}/t")
    assert values(src.read_text(spark, f"{tmp_path}/t")) == [4.0, 1.0, 3.0]
    m = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.5])], "idx long, features array<double>")
    src.write_text(m, f"{tmp_path}/m")
    assert [r["features"] for r in src.read_text(spark, f"{tmp_path}/m", 2).orderBy("idx").collect()] == [[1.0, 2.0], [3.0, 4.5]]
    (tmp_path / "c.csv").write_text("1,2.5\n2,\n")
    assert [tuple(r) for r in src.read_csv_table(spark, f"{tmp_path}/c.csv", {"a": "Int64", "b": "Float64"}).collect()] == [(1, 2.5), (2, None)]
    with pytest.raises(ValueError):
        src.read_table(spark, f"{tmp_path}/f/y", {"value": "Int64"})


def test_linear_algebra(spark):
    a, b = np.arange(6.0).reshape(2, 3), np.arange(12.0).reshape(3, 4)
    e = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, value double")
    got = np.zeros((2, 4))
    for i, j, v in la.multiply(e(a), e(b)).collect():
        got[i, j] = v
    assert (got == a @ b).all()
    got = la.from_blocks(la.multiply_blocks(la.to_blocks(e(a), 2), la.to_blocks(e(b), 2), 2), 2).collect()
    assert {(r["i"], r["j"]): r["value"] for r in got} == {(i, j): v for (i, j), v in np.ndenumerate(a @ b) if v}


def test_learning(spark):
    w = [[1.0, -2.0, 0.5], [0.0, 3.0, 1.0]]
    x = src.regression_data(spark, 300, w).cache()
    got = ml.linear_regression(x, 3, 2)
    assert got == pytest.approx(np.vstack([np.zeros(2), np.array(w).T]), abs=1e-8)
    p = np.array([r["features"] for r in x.orderBy("idx").collect()])
    y = np.array([r["labels"] for r in x.orderBy("idx").collect()])
    want = np.zeros((2, 3))
    for _ in range(3):
        want = want - 0.01 / 300 * (want @ p.T - y.T) @ p
    assert ml.linear_descent(x, 3, 2, 3) == pytest.approx(want)
    cost = lambda c: ((p[:, None] - c[None]) ** 2).sum(2).min(1).sum()
    costs = [cost(ml.kmeans(x, 4, k)) for k in (0, 1, 3)]
    assert costs[0] >= costs[1] >= costs[2]
    l = src.regression_data(spark, 200, [[1.0, -1.0]], logistic=True).withColumn("label", F.col("labels")[0])
    v = np.zeros(2)
    for _ in range(5):
        v = ml.logistic_step(l, v)
    assert v[0] > 0 > v[1]


def test_empty_cluster_keeps_its_centre(spark):
    x = spark.createDataFrame([([0.0],), ([1.0],)], "features array<double>")
    assert ml.kmeans_step(x, np.array([[0.5], [99.0]])).tolist() == [[0.5], [99.0]]


def test_loop_restarts(spark, tmp_path):
    def step(i, s):
        if i == 3 and not s.get("again"):
            raise KeyError
        return s | {"n": s["n"] + i}

    with pytest.raises(KeyError):
        loops.run(spark, step, {"n": 0}, 6, f"{tmp_path}/c", every=0)
    it, state = loops.Checkpoints(spark, f"{tmp_path}/c").latest()
    assert (it, state["n"]) == (3, 3)
    seen = []
    out = loops.run(spark, lambda i, s: seen.append(i) or s | {"n": s["n"] + i}, {"n": 0}, 6, f"{tmp_path}/c", every=0, restart=True)
    assert (seen, out["n"]) == ([3, 4, 5], 15) and not (tmp_path / "c").exists()


def test_text_files_of_unequal_size_keep_their_order(spark, tmp_path):
    """Tasks take files by size; lines count by name of file all the same, and so do the splits of one long file."""
    at = 0
    for k, n in enumerate((10, 1000, 100, 40_000)):
        (tmp_path / f"part-{k}.txt").write_text("".join(f"{x}\n" for x in range(at, at + n)))
        at += n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        got = src.read_text(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["idx"], r["value"]) for r in got) == [(x, float(x)) for x in range(at)]


def test_sparse_arrays(spark, monkeypatch):
    """Gaps in idx do not give each row a span of its own."""
    monkeypatch.setattr(ar, "BLOCK", 100)
    rnd = np.random.default_rng(1)
    idx = np.sort(rnd.choice(10**12, 3000, replace=False)).tolist()
    a = spark.createDataFrame([(i, 1.0) for i in idx], "idx long, value double").repartition(5)
    assert ar._blocks(a, None).select("_b").distinct().count() <= 40
    assert [r["value"] for r in ar.cumsum(a).orderBy("idx").collect()] == list(range(1, 3001))


def test_wide_products(spark):
    rnd = np.random.default_rng(2)
    f = rnd.normal(size=(300, 40))
    x = spark.createDataFrame([(v.tolist(), [float(v[:3].sum())]) for v in f] + [(None, None)], "features array<double>, labels array<double>")
    cols = [F.col("features")[k] for k in range(40)]
    assert np.allclose(la.reduce_products(x, cols, cols), f.T @ f)
    w = ml.linear_regression(x, 40, 1)
    assert np.allclose(w[:, 0], [0, 1, 1, 1] + [0] * 37, atol=1e-9)


def test_q05_model(spark):
    """The regression of the whole program against least squares of the same samples."""
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    x = bb.q05_samples(catalog.q05(spark, d).withColumns({"cd_education_status": F.col("n_regionkey"), "cd_gender": F.col("n_regionkey") % 2}), 3, 1).collect()
    a, y = np.array([[1.0, *r["features"]] for r in x]), np.array([r["labels"] for r in x])
    got = np.array([r["value"] for r in sorted(catalog.QUERIES["q05_model"](spark, d).collect(), key=lambda r: r["i"])])
    assert np.allclose(((a @ got - y[:, 0]) ** 2).sum(), ((a @ np.linalg.lstsq(a, y, rcond=None)[0] - y) ** 2).sum(), rtol=1e-6)
