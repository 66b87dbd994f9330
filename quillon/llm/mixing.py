"""Operator 10: mixing sources to target weights under a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, key_of, table, words


#: Documents that an md5 range of a source should hold.
PER_RANGE = 20_000


def source_targets(sized: DataFrame, weights: tuple = (1.0, 2.0, 3.0), most: int = 3, tilts: tuple = (-0.5, 0.0, 0.5)) -> DataFrame:
    """One row per source: _key, source_size, target, quota (whole words), tilt.

    Sources by code point, null last, take the weights in turn. The words of all sources are shared by
    weight; a target stops at most times its source's size, and what is left goes to the others by
    weight until none is above: the least level whose capped sources are exactly those below it. The
    two windows run over one row per source.
    """
    per = sized.groupBy("_key", "_source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1) % len(weights) + 1
    per = per.withColumn("_turn", turn).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.col("_turn"))).withColumn("_cap", (F.col("source_size") * most).cast("double"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), "_key")
    everything = Window.partitionBy()
    per = per.withColumn("_rank", F.row_number().over(by_cap)).withColumn("_before", F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("_left", F.sum("_w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))).withColumn("_level", (F.sum("source_size").over(everything) - F.col("_before")) / F.col("_left"))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_rank", "_level"))
    per = per.withColumn("_at", F.min(fits).over(everything))
    target = F.when(F.col("_rank") < F.col("_at._rank"), F.col("_cap")).otherwise(F.col("_w") * F.col("_at._level"))
    return per.select("_key", "source_size", target.alias("target"), F.floor(target).cast("long").alias("quota"), F.element_at(F.array(*map(F.lit, tilts)), F.col("_turn")).alias("tilt"))


def curriculum(docs: DataFrame, weights: tuple = (1.0, 2.0, 3.0), most: int = 3, tilts: tuple = (-0.5, 0.0, 0.5), rows: bool = False) -> DataFrame:
    """One row per document, with the copies the mix takes of it and when.

    docs: doc_id, text, source; other columns are ignored, null texts have size 0, null sources are one
    source, repeated rows count each. Returns doc_id, size, source_size, target, quota, tilt, starts
    (array: the document's place in its source's stream, once per pass) and taken_each (array: words
    taken on each pass); with rows, also the whole input row as the struct row.

    A source's stream is its documents by md5 of doc_id, passed up to `most` times, and ends after the
    whole words of the target, so the last document may be taken in part. Places are running sums within
    md5 ranges of a source plus the sums of earlier ranges, so no task sorts a whole source; there are PER_RANGE
    documents to a range, 4,096 ranges at least.
    """
    carried = [F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")] if rows else []
    sized = docs.select(*carried, "doc_id", F.col("source").alias("_source"), key_of(F.col("source")).alias("_key"), F.size(words(F.col("text"))).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order"))
    whole, sized = sized, durable(sized.drop("row"))
    ranges = max(4096, sized.count() // PER_RANGE + 1)
    at = F.floor(F.conv(F.substring("_order", 1, 12), 16, 10).cast("double") / 2.0**48 * ranges).cast("long")
    whole, sized = whole.withColumn("_range", at), sized.withColumn("_range", at)
    ranges = sized.groupBy("_key", "_range").agg(F.sum("size").alias("_sum"))
    ranges = ranges.withColumn("_base", F.sum("_sum").over(Window.partitionBy("_key").orderBy("_range")) - F.col("_sum")).drop("_sum")
    within = Window.partitionBy("_key", "_range").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (whole if rows else sized).withColumn("_run", F.sum("size").over(within) - F.col("size")).join(ranges, ["_key", "_range"]).join(source_targets(sized, weights, most, tilts), "_key")
    start = F.col("_run") + F.col("_base")
    passes = F.array(*(F.lit(p) for p in range(most)))
    starts = F.transform(passes, lambda p: start + p * F.col("source_size"))
    each = F.transform(passes, lambda p: F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - start - p * F.col("source_size"))))
    return placed.select(*(["row"] if rows else []), "doc_id", "size", "source_size", "target", "quota", "tilt", starts.alias("starts"), each.alias("taken_each"))


def position(at, target, tilt):
    """Training time in [0, 1] at which a source's cumulative demand reaches `at` words.

    The source's rate is target * (1 - tilt + 2 * tilt * time); its integral, target * ((1 - tilt) * t +
    tilt * t * t), is inverted in closed form.
    """
    u = F.when(target > 0, at / target).otherwise(F.lit(0.0))
    return 2 * u / ((1 - tilt) + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u))


def schedule(mixed: DataFrame, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """Explode curriculum() to one row per taken copy, range-sorted by training position.

    Columns doc_id, copy, taken, size, position and those of carry.
    """
    x = mixed.select("doc_id", "size", "target", "tilt", *carry, F.posexplode(F.arrays_zip("starts", "taken_each")).alias("copy", "_c")).where("_c.taken_each > 0")
    x = x.select("doc_id", "copy", F.col("_c.taken_each").alias("taken"), "size", position(F.col("_c.starts"), F.col("target"), F.col("tilt")).alias("position"), *carry)
    return x.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix in training order, with the input's columns: one row per taken copy.

    A copy that ends its source's stream keeps only the words taken, joined by single spaces; n_chars,
    if a column, follows the text. Documents that the mix does not reach are left out. The texts are
    shuffled twice: to their ranges, and to their positions.
    """
    x = schedule(curriculum(docs, rows=True), carry=("row",))
    text = F.when(F.col("taken") < F.col("size"), F.array_join(F.slice(words(F.col("row.text")), 1, F.col("taken").cast("int")), " ")).otherwise(F.col("row.text"))
    size = F.length(text).cast(dict(docs.dtypes).get("n_chars", "int"))
    return x.select(*(text.alias(c) if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = curriculum(table(spark, sf_dir, "documents"))
    taken = F.aggregate("taken_each", F.lit(0).cast("long"), lambda a, x: a + x)
    first = position(F.element_at("starts", 1), F.col("target"), F.col("tilt"))
    return m.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.round(F.when(taken > 0, first), 9).alias("first_position"))


SQL = r"""
with d as (
  select doc_id, source, coalesce('=' || source, 'null') as k, md5(coalesce(doc_id::varchar, '')) as o,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select k, source, sum(size)::bigint as source_size from d group by all),
w as (select *, (row_number() over (order by source asc nulls last) - 1) % 3 + 1 as turn, (3 * source_size)::double as cap from s),
l as (select *, turn::double as wt, case turn when 1 then -0.5 when 2 then 0.0 else 0.5 end::double as tilt,
       row_number() over (order by cap / turn::double, k) as rk,
       coalesce(sum(cap) over (order by cap / turn::double, k rows between unbounded preceding and 1 preceding), 0) as bef,
       sum(turn::double) over (order by cap / turn::double, k rows between current row and unbounded following) as lft,
       sum(source_size) over ()::bigint as total from w),
v as (select *, (total - bef) / lft as lev from l),
f as (select rk as frk, lev as flev from v where lev * wt <= cap order by rk limit 1),
t as (select k, source_size, tilt, case when rk < frk then cap else wt * flev end as target from v, f),
p as (select d.*, t.source_size, t.target, t.tilt, floor(t.target)::bigint as quota,
       (sum(size) over (partition by k order by o, size rows between unbounded preceding and current row))::bigint - size as start
      from d join t using (k)),
r as (select *, (greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - start - source_size))
       + greatest(0, least(size, quota - start - 2 * source_size)))::bigint as taken,
       case when target > 0 then start / target else 0 end as u from p)
select doc_id, size, source_size, target, taken,
  round(case when taken > 0 then 2 * u / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u)) end, 9) as first_position from r
"""
