"""Operator 1: quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, key_of, table, words

#: Measures in thousandths: (name, expression, least width of the fence below and above; None: no fence on that side).
MEASURES = (
    ("symbols", "n_symbols * 1000 div n_words", None, 150),
    ("dup_lines", "n_dup_lines * 1000 div n_lines", None, 300),
    ("repeats", "n_repeat_words * 1000 div n_words", None, 100),
    ("length", "word_chars * 1000 div n_words", 2000, 4000),
)
#: Pairs of a language and a source, some hundred bytes each, that may be broadcast.
MOST_LIMITS = 100_000
#: Widths of the interquartile range that a fence lies beyond the quartiles.
REACH = 4


def metrics(docs: DataFrame) -> DataFrame:
    """docs plus the contract's counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed.

    The input row is kept whole in the struct _row. Null and empty texts have no words and fail the base
    rules. Windows of five words are compared by 64-bit hash within one text; only texts in which a
    window repeats sort their windows. All is per row: no shuffle.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    x = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), t.alias("_t"), words(F.col("text")).alias("_w"), lines.alias("_l"))
    bare = F.translate("_t", " \t\n\x0b\f\r", "")
    x = x.select(
        "_row", "_w", F.size("_w").cast("long").alias("n_words"), F.length(bare).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("if(size(_w) > 5, transform(sequence(1, size(_w) - 4), i -> xxhash64(slice(_w, i, 5))), cast(array() as array<bigint>))").alias("_h"),
    ).drop("_w")
    x = x.withColumn("_s", F.expr("if(size(_h) > size(array_distinct(_h)), sort_array(arrays_zip(_h, sequence(0, size(_h) - 1))), null)")).drop("_h")
    twice = "filter(arrays_zip(slice(_s, 1, size(_s) - 1), slice(_s, 2, size(_s) - 1)), x -> x.`0`._h = x.`1`._h)"
    x = x.withColumn("_p", F.expr(f"if(_s is null, null, sort_array(array_distinct(flatten(transform({twice}, x -> array(x.`0`.`1`, x.`1`.`1`))))))")).drop("_s")
    x = x.withColumn("n_repeat_words", F.expr("if(_p is null, 0L, aggregate(arrays_zip(slice(_p, 1, size(_p) - 1), slice(_p, 2, size(_p) - 1)), 5L, (a, x) -> a + least(5, x.`1` - x.`0`)))")).drop("_p")
    return x.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """Quantile sketches of each measure per language and source, and merged per language and over all.

    A sketch is a histogram whose bins keep the six leading bits of a value (relative error at most 1/32),
    so it is at most some 2,000 rows whatever the input, merges by adding counts, and is the same in
    every run. Rows that fail the base rules are left out. Columns: level (0 language and source, 1
    language, 2 all), _lang, _source, measure, bin, n.
    """
    each = F.array(*(F.struct(F.lit(m).alias("measure"), F.expr(e).alias("v")) for m, e, _, _ in MEASURES))
    x = measured.where("not base_failed").select("_lang", "_source", F.explode(each).alias("x")).select("_lang", "_source", "x.*")
    x = x.withColumn("_e", F.expr("greatest(length(bin(v)) - 6, 0)")).withColumn("bin", F.expr("shiftleft(shiftright(v, _e), _e)"))
    fine = x.groupBy("_lang", "_source", "measure", "bin").agg(F.count("*").alias("n"))
    low = fine.withColumn("level", F.lit(0))
    mid = fine.groupBy("_lang", "measure", "bin").agg(F.sum("n").alias("n")).withColumns({"_source": F.lit("*"), "level": F.lit(1)})
    top = fine.groupBy("measure", "bin").agg(F.sum("n").alias("n")).withColumns({"_lang": F.lit("*"), "_source": F.lit("*"), "level": F.lit(2)})
    return low.unionByName(mid).unionByName(top)


def fences(measured: DataFrame, least_docs: int = 100) -> DataFrame:
    """Per language and source: the lowest and highest value of each measure that is kept (lo_*, hi_*).

    Quartiles come from the source's own sketch if it holds least_docs documents, else from the merged
    sketch of its language, else from that of all. A fence lies REACH interquartile ranges beyond the
    quartile, and never nearer than the measure's least width, so a uniform clean source loses nothing.
    """
    s = durable(sketches(measured))
    w = Window.partitionBy("level", "_lang", "_source", "measure")
    c = s.withColumn("_c", F.sum("n").over(w.orderBy("bin"))).withColumn("_n", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("_c") >= F.ceil(F.col("_n") * q), F.col("bin")))
    q = c.groupBy("level", "_lang", "_source", "measure").agg(F.first("_n").alias("_n"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    names = q.where("level = 0").select("_lang", "_source", "measure", F.col("_n").alias("n0"), F.struct("q1", "q3").alias("s0"))
    lang = q.where("level = 1").select("_lang", "measure", F.col("_n").alias("n1"), F.struct("q1", "q3").alias("s1"))
    every = q.where("level = 2").select("measure", F.struct("q1", "q3").alias("s2"))
    x = names.join(lang, ["_lang", "measure"]).join(every, "measure")
    x = x.withColumn("s", F.when(F.col("n0") >= least_docs, F.col("s0")).when(F.col("n1") >= least_docs, F.col("s1")).otherwise(F.col("s2")))
    out = []
    for m, _, below, above in MEASURES:
        here = F.col("measure") == m
        iqr = F.col("s.q3") - F.col("s.q1")
        if below is not None:
            out.append(F.max(F.when(here, F.col("s.q1") - F.greatest(REACH * iqr, F.lit(below)))).alias(f"lo_{m}"))
        out.append(F.max(F.when(here, F.col("s.q3") + F.greatest(REACH * iqr, F.lit(above)))).alias(f"hi_{m}"))
    return x.groupBy("_lang", "_source").agg(*out)


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured plus kept: inside every fence of its language and source, and base_failed false. Up to MOST_LIMITS fences go to every task, so that no document is moved."""
    inside = F.lit(True)
    for m, e, below, _ in MEASURES:
        if below is not None:
            inside = inside & (F.expr(e) >= F.col(f"lo_{m}"))
        inside = inside & (F.expr(e) <= F.col(f"hi_{m}"))
    limits = durable(limits)
    x = measured.join(F.broadcast(limits) if limits.count() <= MOST_LIMITS else limits, ["_lang", "_source"], "left")
    return x.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(True))))


def _keyed(measured: DataFrame) -> DataFrame:
    return measured.withColumn("_lang", key_of(F.col("_row.lang"))).withColumn("_source", key_of(F.col("_row.source")))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the input's columns. Null languages and sources form groups of their own.

    Repeated rows are judged alike, null and empty texts go, an empty table gives no rows. Texts are measured once and
    written with their counts (the checkpoint takes their size), as a filter that the optimizer pushed into the measures would
    evaluate them many times over.
    """
    m = durable(_keyed(metrics(docs)))
    return judged(m, fences(m)).where("kept").select("_row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    m = _keyed(metrics(docs))
    m = durable(m.select(F.col("_row.doc_id").alias("doc_id"), *(c for c in m.columns if c != "_row")))
    return judged(m, fences(m)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
with d as (
  select doc_id, coalesce('=' || lang, 'null') as lg, coalesce('=' || source, 'null') as sr, coalesce(text, '') as t, row_number() over () as r from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ln from d),
g as (select r, i, array_to_string(ws[i:i+4], ' ') as g from (select r, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) > 4)),
h as (select r, i from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1),
k as (select r, count(distinct i + j) as n from (select r, i, unnest([0, 1, 2, 3, 4]) as j from h) group by r),
m as (select w.r, doc_id, lg, sr, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(ln)::bigint as n_lines,
        (len(ln) - len(list_distinct(ln)))::bigint as n_dup_lines, coalesce(k.n, 0)::bigint as n_repeat_words
      from w left join k on k.r = w.r),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
u as (select *, n_symbols * 1000 // n_words as v1, n_dup_lines * 1000 // n_lines as v2, n_repeat_words * 1000 // n_words as v3, word_chars * 1000 // n_words as v4 from b where not base_failed),
z as (select lg, sr, unnest([{'m': 1, 'v': v1}, {'m': 2, 'v': v2}, {'m': 3, 'v': v3}, {'m': 4, 'v': v4}], recursive := true) from u),
s as (select lg, sr, m, ((v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0)) as v, count(*) as n from z group by all),
a as (select 0 as lv, lg, sr, m, v, n from s union all select 1, lg, '*', m, v, sum(n) from s group by all
      union all select 2, '*', '*', m, v, sum(n) from s group by all),
c as (select *, sum(n) over (partition by lv, lg, sr, m order by v) as cum, sum(n) over (partition by lv, lg, sr, m) as tot from a),
q as (select lv, lg, sr, m, any_value(tot) as tot, min(v) filter (where cum >= ceil(tot * 0.25::double)) as q1, min(v) filter (where cum >= ceil(tot * 0.75::double)) as q3 from c group by all),
f as (select x.lg, x.sr, x.m, case when x.tot >= 100 then x.q1 when y.tot >= 100 then y.q1 else e.q1 end as q1,
        case when x.tot >= 100 then x.q3 when y.tot >= 100 then y.q3 else e.q3 end as q3
      from q x join q y on y.lv = 1 and y.lg = x.lg and y.m = x.m join q e on e.lv = 2 and e.m = x.m where x.lv = 0),
l as (select lg, sr, max(q3 + greatest(4 * (q3 - q1), 150)) filter (where m = 1) as h1, max(q3 + greatest(4 * (q3 - q1), 300)) filter (where m = 2) as h2,
        max(q3 + greatest(4 * (q3 - q1), 100)) filter (where m = 3) as h3, max(q3 + greatest(4 * (q3 - q1), 4000)) filter (where m = 4) as h4,
        max(q1 - greatest(4 * (q3 - q1), 2000)) filter (where m = 4) as l4 from f group by all)
select b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed,
  coalesce(not b.base_failed and u.v1 <= h1 and u.v2 <= h2 and u.v3 <= h3 and u.v4 <= h4 and u.v4 >= l4, false) as kept
from b left join u on u.r = b.r left join l on l.lg = b.lg and l.sr = b.sr
"""
