"""Retail queries over tables with integer keys, as programs that go from tables to a sample matrix and a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import vector
from ..operators.aggregates import count_true, length, length_unique, maximum, total
from ..operators.arrays import prefix_lag_sessions
from ..operators.relational import aggregate, filter_rows, join, union_all


def q05(clicks: DataFrame, item: DataFrame, customer: DataFrame, demographics: DataFrame, category: int, classes: range = range(1, 8)) -> DataFrame:
    """Clicks per user by category, with the user's demographics.

    clicks: wcs_item_sk, wcs_user_sk; item: i_item_sk, i_category_id, i_category; customer: c_customer_sk,
    c_current_cdemo_sk; demographics: cd_demo_sk and what else is to be kept.
    """
    user_items = join(filter_rows(clicks, F.col("wcs_item_sk").isNotNull() & F.col("wcs_user_sk").isNotNull()), item, "wcs_item_sk", "i_item_sk", "user_items_sk")
    counts = {f"clicks_in_{k}": count_true(F.col("i_category_id") == k) for k in classes}
    per_user = aggregate(user_items, "wcs_user_sk", clicks_in_category=count_true(F.col("i_category") == category), **counts)
    per_customer = join(per_user, filter_rows(customer, F.col("c_current_cdemo_sk").isNotNull()), "wcs_user_sk", "c_customer_sk", "customer_clicks_sk")
    return join(per_customer, demographics, "c_current_cdemo_sk", "cd_demo_sk", "customer_demo_clicks_sk")


def q05_samples(result: DataFrame, education: int, gender: int, classes: range = range(1, 8)) -> DataFrame:
    """(features, labels) of a regression of clicks in the category on demographics and the other clicks."""
    return result.select(vector((F.col("cd_education_status") == education), (F.col("cd_gender") == gender), *(F.col(f"clicks_in_{k}") for k in classes)).alias("features"), vector("clicks_in_category").alias("labels"))


def q25(store_sales: DataFrame, web_sales: DataFrame, after) -> DataFrame:
    """Recency, frequency and spend per customer over two channels. Both inputs: cid, ticket, sold, paid."""
    side = lambda t: aggregate(filter_rows(t, F.col("sold") > after), "cid", frequency=length_unique(F.col("ticket")), most_recent=maximum(F.col("sold")), amount=total(F.col("paid")))
    return aggregate(union_all(side(store_sales), side(web_sales)), "cid", recency=maximum(F.col("most_recent")), frequency=total(F.col("frequency")), totalspend=total(F.col("amount")))


def q25_samples(result: DataFrame, today: int, days: int = 60) -> DataFrame:
    return result.select("cid", vector("cid", today - F.col("recency") < days, "frequency", "totalspend").alias("features"))


def q26(sales: DataFrame, item: DataFrame, wanted: Column, least: int, classes: range = range(1, 16)) -> DataFrame:
    """Items bought per customer in a category, by class, of customers with more than `least` of them.

    sales: ss_item_sk, ss_customer_sk; item: i_item_sk, i_class_id and what `wanted` tests.
    """
    bought = filter_rows(join(sales, item, "ss_item_sk", "i_item_sk", "ss_item_sk"), wanted)
    per = aggregate(bought, "ss_customer_sk", ss_item_count=length(), **{f"id{k}": count_true(F.col("i_class_id") == k) for k in classes})
    return filter_rows(per, F.col("ss_item_count") > least)


def pair_counts(sales: DataFrame, ticket: str, item: str, least: int, top: int, per_task: int = 1 << 19, direct: int = 200) -> DataFrame:
    """The `top` pairs of items that share most tickets, of those with more than `least`: item_1 < item_2, n.

    A ticket's pairs come from its set of items, so a ticket must be of moderate size, as a basket is. Tasks have
    `per_task` rows of sales on average, however many those are: Spark would join the small parts of a shuffle of sets
    to tasks whose pairs fill memory. They have up to four times as many before there are more than `direct` tasks, as
    to more than that (spark.shuffle.sort.bypassMergeThreshold) a task deals out by sorting its rows in memory. Pairs
    are counted in each part of the tickets before they are dealt out.
    """
    sales = sales.select(F.col(ticket).alias("_t"), F.col(item).alias("_i")).where(F.col("_t").isNotNull() & F.col("_i").isNotNull())
    rows = sales.count()
    parts = max(1, min(-(-rows // per_task), direct), -(-rows // (4 * per_task)))
    dealt = sales.withColumn("_b", F.pmod(F.hash("_t"), F.lit(parts))).repartitionById(parts, "_b")
    sets = dealt.groupBy("_b", "_t").agg(F.sort_array(F.collect_set("_i")).alias("_i")).where(F.size("_i") > 1)
    first = sets.select("_b", F.posexplode("_i").alias("_p", "item_1"), "_i").select("_b", "item_1", F.expr("slice(_i, _p + 2, size(_i))").alias("_r"))
    pairs = first.select("_b", "item_1", F.explode("_r").alias("item_2")).groupBy("_b", "item_1", "item_2").agg(F.count("*").alias("n"))
    counts = pairs.repartition(parts, "item_1", "item_2").groupBy("item_1", "item_2").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") > least).orderBy(F.desc("n"), "item_1", "item_2").limit(top)


def session_mates(clicks: DataFrame, user: str, order: list[str], seconds: Column, item: str, mine, timeout: float, top: int) -> DataFrame:
    """The `top` items met most often in sessions that hold the item `mine`: item, n."""
    s = prefix_lag_sessions(clicks, user, order, seconds, timeout)
    w = Window.partitionBy(user, "session")
    s = s.withColumn("_has", F.max(F.col(item) == F.lit(mine)).over(w)).where(F.col("_has") & (F.col(item) != F.lit(mine)))
    return s.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(top)


def views_before(clicks: DataFrame, user: str, order: list[str], seconds: Column, bought: Column, within: float, views: int) -> DataFrame:
    """The last `views` rows before each user's next purchase, not older than `within` seconds before it; purchases start anew. Adds sale_at and back (1: the last one)."""
    later = Window.partitionBy(user).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    x = clicks.withColumns({"_at": seconds, "_sale": bought}).withColumn("sale_at", F.min(F.when(F.col("_sale"), F.col("_at"))).over(later))
    x = x.withColumn("_n", F.sum(F.col("_sale").cast("long")).over(later)).where(~F.col("_sale") & F.col("sale_at").isNotNull())
    x = x.withColumn("back", F.row_number().over(Window.partitionBy(user, "_n").orderBy(*(F.col(c).desc() for c in order))))
    return x.where((F.col("back") <= views) & (F.col("_at") >= F.col("sale_at") - within)).drop("_at", "_sale", "_n")
