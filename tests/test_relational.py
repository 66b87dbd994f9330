import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quillon.operators import aggregates as ag
from quillon.operators import relational as rel
from quillon.plans import bigbench as bb

T1 = [(1, 1.1), (2, 2.1), (3, 3.1), (1, 3.2), (2, 1.9)]
T2 = [(1, 7.1), (3, 8.3)]


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def t1(spark):
    return spark.createDataFrame(T1, "userid long, val2 double")


@pytest.fixture(scope="module")
def t2(spark):
    return spark.createDataFrame(T2, "userid long, val3 double")


def test_filter(t1):
    assert rows(rel.filter_rows(t1, F.col("userid") > 2)) == [(3, 3.1)]


def test_join_keeps_every_pair(t1, t2):
    j = rel.join(t1, t2, "userid", "userid", "k")
    assert j.columns == ["k", "val2", "val3"]
    assert rows(j.select("k", "val3")) == [(1, 7.1), (1, 7.1), (3, 8.3)]
    assert rows(j.where("val2 > 2.0").select("k", "val3")) == [(1, 7.1), (3, 8.3)]


def test_join_names_that_clash(t1):
    with pytest.raises(ValueError):
        rel.join(t1, t1, "userid", "userid")


def test_null_keys_match_nothing(spark, t1):
    n = spark.createDataFrame([(None, 1.0)], "userid long, v double")
    assert rel.join(n, t1, "userid", "userid").count() == 0
    assert rows(rel.aggregate(n, "userid", n=ag.length())) == [(None, 1)]


def test_aggregate(t1):
    a = rel.aggregate(t1, "userid", "uid", s=ag.total(F.col("val2")), n=ag.length(F.col("val2") > 2), c=ag.count_true(F.col("val2") > 2))
    assert rows(a) == [(1, 4.3, 2, 1), (2, 4.0, 2, 1), (3, 3.1, 1, 1)]


def test_count_distinct(spark):
    s = spark.createDataFrame([(1, 0, 37580, 101.0), (1, 3, 34000, 24.0), (2, 5, 35000, 3.5), (2, 6, 36000, 50.0), (1, 0, 37600, 3.2)], "c long, t long, d long, p double")
    a = rel.aggregate(s, "c", n=ag.length_unique(F.col("t")), last=ag.maximum(F.col("d")), paid=ag.total(F.col("p")))
    assert rows(a) == [(1, 2, 37600, 128.2), (2, 2, 36000, 53.5)]


def test_union_all(t1):
    a = rel.aggregate(t1, "userid", "uid", ss=ag.total(F.col("val2")))
    b = rel.aggregate(t1, "userid", "uid", ss=ag.count_true(F.col("val2") > 2))
    assert rows(rel.union_all(a, b)) == [(1, 1.0), (1, 4.3), (2, 1.0), (2, 4.0), (3, 1.0), (3, 3.1)]
    with pytest.raises(ValueError):
        rel.union_all(a, b.withColumnRenamed("ss", "x"))


def test_q26(spark):
    sales = spark.createDataFrame(list(zip((1, 1, 2, 1, 2, 3), (1, 2, 1, 3, 3, 1))), "ss_customer_sk long, ss_item_sk long")
    item = spark.createDataFrame([(1, 3, 1), (2, 1, 2), (3, 2, 1)], "i_item_sk long, i_class_id long, i_category long")
    assert rows(bb.q26(sales, item, F.col("i_category") == 1, 1).select("ss_item_count", "id3")) == [(2, 1), (2, 1)]


def test_q05(spark):
    make = lambda cols, *names: spark.createDataFrame(list(zip(*cols)), ", ".join(f"{n} long" for n in names))
    clicks = make(((2, 3, 5, 7, 9, 11, 1, 1, 9), (3, 3, 3, 3, 8, 2, 2, 3, 3)), "wcs_item_sk", "wcs_user_sk")
    item = make(((1, 2, 2, 2, 2, 6, 7, 8, 9), (3, 3, 3, 3, 8, 2, 2, 3, 3), (2, 3, 4, 4, 8, 8, 7, 7, 7)), "i_item_sk", "i_category_id", "i_category")
    customer = make(((1, 2, 2, 2, 8, 6, 7, 8, 9), (3, 3, 3, 3, 8, 2, 2, 3, 3)), "c_customer_sk", "c_current_cdemo_sk")
    demo = make(((1, 12, 2, 2, 2, 3, 3, 8, 9), (3, 3, 3, 3, 8, 9, 9, 9, 9), (2, 7, 7, 4, 8, 8, 7, 7, 7)), "cd_demo_sk", "cd_gender", "cd_education_status")
    r = bb.q05(clicks, item, customer, demo, 3)
    assert rows(r.select("customer_clicks_sk", "customer_demo_clicks_sk", "clicks_in_2", "clicks_in_3")) == [(2, 3, 0, 1)] * 6 + [(8, 3, 0, 1)] * 2 + [(8, 8, 0, 1)]
    assert len(bb.q05_samples(r, 7, 9).first()["features"]) == 9


def test_q25(spark):
    kind = "cid long, ticket long, sold long, paid double"
    store = spark.createDataFrame([(1, 0, 37580, 101.0), (1, 3, 34000, 24.0), (2, 5, 35000, 3.5), (2, 6, 36000, 50.0), (1, 0, 37600, 3.2)], kind)
    web = spark.createDataFrame([(1, 0, 37581, 100.0), (1, 0, 37610, 30.2), (1, 3, 34000, 240.0), (2, 5, 35000, 35.0), (2, 5, 36000, 50.3), (3, 4, 37620, 30.1)], kind)
    r = bb.q25(store, web, 33000).selectExpr("cid", "double(37621 - recency < 60) as r", "frequency", "totalspend")
    assert rows(r) == [(1, 1.0, 4, 498.4), (2, 0.0, 3, 138.8), (3, 1.0, 1, 30.1)]


def test_pair_counts(spark):
    rng = random.Random(3)
    sales = [(rng.choice([None, *range(150)]), rng.choice([None, *range(12)])) for _ in range(1000)] + [(None, k) for k in (1, 2)] * 9
    frame = spark.createDataFrame(sales, "ticket long, item long")
    tickets = {t: {i for s, i in sales if s == t and i is not None} for t, _ in sales if t is not None}
    want = Counter(p for items in tickets.values() for p in combinations(sorted(items), 2))
    want = sorted(((*p, n) for p, n in want.items() if n > 20), key=lambda r: (-r[2], r[:2]))
    assert len(want) > 40
    assert [tuple(r) for r in bb.pair_counts(frame, "ticket", "item", 20, 40).collect()] == want[:40]
    dealt = bb.pair_counts(frame, "ticket", "item", 20, 40, per_task=100)
    assert [tuple(r) for r in dealt.collect()] == want[:40]
    assert bb.pair_counts(frame.where("false"), "ticket", "item", 1, 9).count() == 0
    # tickets, and then pairs, are dealt out to as many tasks as the rows need, which Spark does not join again
    parts = -(-sum(t is not None and i is not None for t, i in sales) // 100)
    plan = dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(rf"Exchange .*, {parts}\), REPARTITION_BY_NUM", plan)) == 2 and "coalesced" not in plan


def test_empty_tables(spark, t1):
    e = t1.where("false")
    assert rel.join(e, t1.withColumnRenamed("val2", "v"), "userid", "userid").count() == 0
    assert rel.aggregate(e, "userid", n=ag.length()).count() == 0
