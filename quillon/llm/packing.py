"""Operator 6: packing documents into training sequences by cutting-stock column generation."""

from __future__ import annotations

import sys
import warnings
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

#: Tokens of a sequence; step of the length classes and of the places at which a rest may be cut; steps of a sequence.
CAPACITY, STEP = 1024, 16
STEPS = CAPACITY // STEP
#: Sequences that a pattern may fill together, and what a cut costs in sequences.
TOGETHER, CUT = 2, 0.02
#: Md5 ranges within which pieces of a length are ranked, at least; pieces that a range should hold.
RANGES, PER_RANGE = 256, 20_000


class Tokens:
    """Token ids of whole texts, equal to those of the tokenizers library for byte_bpe_50k.json."""

    def __init__(self, path: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def ids(self, text: str) -> np.ndarray:
        """The ids and a closing 0."""
        x = array("I", self.encode(text))
        x.append(0)
        return np.frombuffer(x, np.uint32).astype("<u4", copy=False)


_tokens: dict[str, Tokens] = {}


def tokens_of(path: str | None = None) -> Tokens:
    """This worker's tokenizer; path: a tiktoken file of ranks, by default that of byte_bpe_50k."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def pieces(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Cut each document (doc_id, text) into pieces of CAPACITY tokens and a rest, which may be the whole document.

    A document's tokens are the ids of its whole text, null as empty, and a closing 0, so even an empty
    one has a piece. Columns doc_id, start, length, ids_crc32, doc_tokens; of what could be cut, before and after: the
    checksums of both parts of the piece for each multiple of STEP tokens, four bytes each, high ones first; and ids when asked for.
    Repeated rows are documents of their own; other columns are not looked at.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, crc = tokens_of(path), zlib.crc32
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = tokens.ids(text if isinstance(text, str) else "")
                raw, n = memoryview(ids).cast("B"), len(ids)
                for s in range(0, n, CAPACITY):
                    e = min(s + CAPACITY, n)
                    before, after = array("I"), array("I")
                    if e - s <= CAPACITY - STEP:
                        c = 0
                        for k in range(s, e - STEP, STEP):
                            c = crc(raw[4 * k : 4 * (k + STEP)], c)
                            before.append(c)
                            after.append(crc(raw[4 * (k + STEP) : 4 * e]))
                    if sys.byteorder == "little":
                        before.byteswap()
                        after.byteswap()
                    out.append((doc, s, e - s, crc(raw[4 * s : 4 * e]), n, before.tobytes(), after.tobytes(), *([ids[s:e].tolist()] if with_ids else [])))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "before", "after", *(["ids"] if with_ids else [])]).astype({"doc_id": b["doc_id"].dtype})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, before binary, after binary" + ", ids array<long>" * with_ids)


def knapsack(values: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: item k weighs k + 1. For every room up to `room`, the best value and the item put in last (-1: none, one less is as good)."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        m = min(r, len(values))
        at = values[:m] + best[r - m : r][::-1]
        k = int(at.argmax())
        best[r], last[r] = (at[k], k) if at[k] > best[r - 1] else (best[r - 1], -1)
    return best, last


def filled(last: np.ndarray, room: int, n: int) -> np.ndarray:
    counts, r = np.zeros(n, np.int64), room
    while r > 0:
        if last[r] < 0:
            r -= 1
        else:
            counts[last[r]] += 1
            r -= last[r] + 1
    return counts


def cutting_stock(demand: np.ndarray, steps: int = STEPS, together: int = TOGETHER, cut: float = CUT, gap: float = 1e-3, most: int = 5000) -> list[tuple[int, int, np.ndarray]]:
    """Patterns that meet the demand for items of 1, 2, ... steps: [(times, sequences of the pattern, items of each weight)].

    A pattern fills 1 to `together` sequences of `steps` steps and costs that number, plus `cut` for each boundary in it, where
    an item may be cut. Column generation: the basis starts with one pattern per weight in demand, knapsack
    dynamic programming over the duals prices the next column for each number of sequences, and the ratio test puts the best in,
    until the cost is within a share of `gap` of the bound that the duals prove. Times are rounded down, then
    up by the largest parts left while the demand lasts; what is then left fills patterns of `together` sequences
    by decreasing weight. The work depends on the number of weights, not on that of documents. A warning says so if
    `most` columns do not reach the gap; the patterns are whole even then.
    """
    n, left = len(demand), demand.astype(np.int64).copy()
    asked = np.flatnonzero(demand)
    need = demand[asked].astype(float)
    cost = lambda k: k + cut * (k - 1)
    per = steps // (asked + 1)
    basis, price, stock = np.diag(per.astype(float)), np.ones(len(asked)), np.ones(len(asked), np.int64)
    inverse = np.diag(1.0 / per)
    x, bound = inverse @ need, 0.0
    for step in range(most if len(asked) else 0):
        prices = np.zeros(n)
        prices[asked] = np.maximum(price @ inverse, 0)
        best, last = knapsack(prices, together * steps)
        ratios = [best[k * steps] / cost(k) for k in range(1, together + 1)]
        k = int(np.argmax(ratios)) + 1
        bound = max(bound, prices[asked] @ need / ratios[k - 1])
        if ratios[k - 1] <= 1 + 1e-9 or price @ x <= bound * (1 + gap):
            break
        column = filled(last, k * steps, n)[asked]
        d = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-7, x / d, np.inf)
        ties = np.flatnonzero(ratio <= ratio.min() + 1e-12)
        r = int(ties[d[ties].argmax()])
        basis[:, r], price[r], stock[r] = column, cost(k), k
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[r] / d[r]
            inverse -= np.outer(d, row)
            inverse[r] = row
        x = np.maximum(inverse @ need, 0)
    else:
        if len(asked):
            warnings.warn(f"the linear program stopped after {most} columns at a cost of {price @ x:.1f}; the proven bound is {bound:.1f}", stacklevel=2)
    out: list[tuple[int, int, np.ndarray]] = []

    def take(c: np.ndarray, times: int, k: int) -> None:
        nonlocal left
        used = c > 0
        times = min(times, int((left[used] // c[used]).min())) if used.any() else 0
        if times > 0:
            out.append((times, k, c))
            left -= times * c

    def whole(column: np.ndarray) -> np.ndarray:
        c = np.zeros(n, np.int64)
        c[asked] = column.round().astype(np.int64)
        return c

    for column, times, k in zip(basis.T, np.floor(x + 1e-9), stock):
        take(whole(column), int(times), int(k))
    for r in np.argsort(-(x % 1), kind="stable"):
        take(whole(basis[:, r]), 1, int(stock[r]))
    while left.any():
        c, free = np.zeros(n, np.int64), together * steps
        for k in range(n - 1, -1, -1):
            t = min(int(left[k]), free // (k + 1))
            c[k] += t
            free -= t * (k + 1)
        take(c, int((left[c > 0] // c[c > 0]).min()), -(-int(c @ np.arange(1, n + 1)) // steps))
    return out


def pack(cut: DataFrame) -> DataFrame:
    """pieces(), of which some are cut once more, plus sequence_id and offset.

    Pieces are counted by length in steps; the driver sees those counts, at most STEPS, and nothing else of the documents.
    Pieces of a length are ranked by md5 of doc_id within ranges, whose number grows with the table, and patterns claim runs of ranks; the
    claims are a table of at most some thousands of rows. A pattern lays its items one after the other, longer
    ones first, over its sequences, by their lengths in steps; one that lies across a boundary is cut there. Pieces of over
    CAPACITY - STEP tokens are sequences of their own. So a document of up to CAPACITY tokens is whole or cut once.
    Ties and repeated rows rank in any order, each once; an empty table gives no rows.
    """
    spark = cut.sparkSession
    cut = cut.withColumn("_class", F.ceil(F.col("length") / STEP).cast("int")).withColumn("_md5", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    cut = durable(cut)
    demand = np.zeros(STEPS, np.int64)
    for k, n in cut.groupBy("_class").agg(F.count("*")).collect():
        demand[k - 1] = n
    ranges = max(RANGES, int(demand.sum()) // PER_RANGE + 1)
    cut = cut.withColumn("_range", F.pmod(F.conv(F.substring("_md5", 1, 12), 16, 10).cast("long"), F.lit(ranges)).cast("int"))
    counts = cut.groupBy("_class", "_range").agg(F.count("*").alias("_n"))
    claims, taken, sequence = [(STEPS, 0, int(demand[-1]), 1, 1, 0, 0)], np.zeros(STEPS, np.int64), int(demand[-1])
    for times, k, items in cutting_stock(demand[:-1]):
        at = 0
        for c in np.flatnonzero(items)[::-1]:
            each = int(items[c])
            claims.append((int(c) + 1, int(taken[c]), int(taken[c] + times * each), each, k, sequence, at))
            taken[c] += times * each
            at += each * (int(c) + 1)
        sequence += times * k
    claims = spark.createDataFrame(claims, "_class int, _from long, _to long, _each long, _k long, _first long, _place long")
    base = counts.withColumn("_base", F.sum("_n").over(Window.partitionBy("_class").orderBy("_range")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_class", "_range").orderBy("_md5", "start", "length", "ids_crc32")) - 1
    x = cut.withColumn("_rank", rank).join(base, ["_class", "_range"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    # A claim is found in its row of the class, which holds all its claims: at most as many as there are patterns.
    rows = claims.groupBy("_class").agg(F.array_sort(F.collect_list(F.struct("_from", "_to", "_each", "_k", "_first", "_place"))).alias("_claims"))
    x = x.join(F.broadcast(rows), "_class")
    at = F.element_at(F.filter("_claims", lambda c: (c["_from"] <= F.col("_rank")) & (F.col("_rank") < c["_to"])), 1)
    x = x.withColumn("_at", at).withColumn("_slot", F.col("_rank") - F.col("_at._from"))
    x = x.withColumn("_place", F.col("_at._place") + F.col("_slot") % F.col("_at._each") * F.col("_class"))
    x = x.withColumn("_sequence", F.col("_at._first") + F.expr("_slot div _at._each") * F.col("_at._k") + F.expr(f"_place div {STEPS}"))
    x = x.withColumn("_cut", F.when(F.expr(f"_place div {STEPS} < (_place + _class - 1) div {STEPS}"), STEPS - F.col("_place") % STEPS))  # in steps of the piece
    crc = lambda of: F.conv(F.hex(F.substring(of, (F.col("_cut") - 1) * 4 + 1, F.lit(4))), 16, 10).cast("long")
    ids = [c for c in cut.columns if c == "ids"]
    part = lambda start, length, crc, n, slices: F.struct(start.alias("start"), length.alias("length"), crc.alias("ids_crc32"), n.alias("sequence_id"), *(s.alias("ids") for s in slices))
    size = F.col("_cut") * STEP
    parts = F.when(F.col("_cut").isNull(), F.array(part(F.col("start"), F.col("length"), F.col("ids_crc32"), F.col("_sequence"), [F.col(c) for c in ids]))).otherwise(
        F.array(
            part(F.col("start"), size, crc("before"), F.col("_sequence"), [F.slice(c, F.lit(1), size.cast("int")) for c in ids]),
            part(F.col("start") + size, F.col("length") - size, crc("after"), F.col("_sequence") + 1, [F.slice(c, size.cast("int") + 1, F.lit(CAPACITY)) for c in ids]),
        )
    )
    x = x.select("doc_id", "doc_tokens", "_place", F.explode(parts).alias("_p")).select("doc_id", "doc_tokens", "_place", "_p.*")
    within = Window.partitionBy("sequence_id").orderBy("_place", "start")
    x = x.withColumn("offset", F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    return x.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *ids)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
