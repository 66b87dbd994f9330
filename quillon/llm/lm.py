"""Operator 3: language-model scores with stupid backoff, from n-gram count tables joined to exploded n-grams.

Rows of n-grams are packed: all that a block of documents asks of one range of hashes is one row, whose
sorted hashes are kept as differences, plane by plane of bytes, some five bytes an n-gram.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tasks

#: Longest n-gram; factor of each backoff.
ORDER, BACKOFF = 3, 0.4
#: Bytes of text of a block of documents, at most and at least, and of all texts per range of hashes.
BLOCK, LEAST, RANGE = 16 << 20, 1 << 20, 4 << 20
#: Bits of a hash beyond those that number all n-grams: an n-gram takes another's count once in 2 ** SPARE.
SPARE = 28
#: Words whose hashes a task remembers.
MEMORY = 1 << 19
#: The empty n-gram, which every word has as a context.
EMPTY = np.uint64(0x5851F42D4C957F2D)


def _mix(context: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    v = context * np.uint64(0x9E3779B97F4A7C15) + word * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k)
    v ^= v >> np.uint64(31)
    v *= np.uint64(0xD6E8FEB86659FD93)
    return v ^ (v >> np.uint64(32))


class Hashes:
    """64-bit hashes of the words of texts, A-Z in lower case."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: str) -> np.ndarray:
        ws, known = text.encode().lower().split(), self.known
        try:
            return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        except KeyError:
            if len(known) > MEMORY:
                known.clear()
            for w in ws:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w, 1)
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def planes(x: np.ndarray) -> bytes:
    """64-bit values as bytes: how many, the length of each plane of bytes, least first, and the planes. Planes of small values are Huffman-coded, those of zeros left out."""
    out = []
    for p in np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T):
        b = p.tobytes() if p.any() else b""
        if b and p.mean() < 64:
            z = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
            b = min(z.compress(b) + z.flush(), b, key=len)
        out.append(b)
    return struct.pack("<9I", len(x), *map(len, out)) + b"".join(out)


def values(b: bytes) -> np.ndarray:
    n, *sizes = struct.unpack_from("<9I", b)
    x, at = np.zeros((8, n), np.uint8), 36
    for k, size in enumerate(sizes):
        if size:
            x[k] = np.frombuffer(b[at : at + size] if size == n else zlib.decompress(b[at : at + size], -15), np.uint8)
            at += size
    return np.ascontiguousarray(x.T).reshape(-1).view(np.uint64)


def width(size: int, order: int) -> int:
    """Bits of a hash that are kept for so many bytes of text: SPARE more than their n-grams need to be numbered, 64 at most."""
    return min(64, SPARE + (size * order // 4).bit_length())


class Grams:
    """The n-grams of a block of texts: of each order, the hash (its leading bits) of the one that ends at each word, if the text has it."""

    def __init__(self, texts: list[str | None], order: int, bits: int, hashes: Hashes) -> None:
        parts = [hashes.of(t) if t else np.zeros(0, np.uint64) for t in texts]
        self.sizes = np.array([len(x) for x in parts], np.int64)
        word = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        place = np.arange(len(word)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.empty, drop = EMPTY >> np.uint64(64 - bits), np.uint64(64 - bits)
        self.ends, self.hash, self.slot = [], [], []  # of each order: positions, different hashes in order, slot of each position's
        h = word
        for k in range(1, order + 1):
            at = np.flatnonzero(place >= k - 1)
            if k > 1:
                longer = np.zeros_like(h)
                longer[at] = _mix(h[at - 1], word[at], k)
                h = longer
            u, slot = np.unique(h[at] >> drop, return_inverse=True)
            self.ends.append(at)
            self.hash.append(u)
            self.slot.append(slot)

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """All different hashes of the block, sorted, the empty n-gram's among them, and how often each occurs."""
        h = np.concatenate([np.array([self.empty]), *self.hash])
        n = np.concatenate([np.array([self.sizes.sum()]), *(np.bincount(s, minlength=len(u)) for s, u in zip(self.slot, self.hash))])
        order = np.argsort(h, kind="stable")
        return h[order], n[order]

    def scores(self, h: np.ndarray, c: np.ndarray, backoff: float) -> np.ndarray:
        """The logarithm of each text's score, given the corpus's count c of each hash of asked()."""
        count = np.full((len(self.hash), int(self.sizes.sum())), 0.0)
        for k, (at, u, slot) in enumerate(zip(self.ends, self.hash, self.slot)):
            count[k, at] = c[np.searchsorted(h, u)][slot]
        every = float(c[np.searchsorted(h, self.empty)])
        total, open_ = np.zeros(count.shape[1]), np.ones(count.shape[1], bool)
        longest = np.zeros(count.shape[1], np.int64)
        for k, at in enumerate(self.ends):
            longest[at] = k
        for k in range(len(self.hash) - 1, -1, -1):
            at = np.flatnonzero(open_ & (longest >= k) & (count[k] > 0))
            below = count[k - 1, at - 1] if k else every
            total[at] = np.log(count[k, at] / below) + (longest[at] - k) * math.log(backoff)
            open_[at] = False
        return np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes), total, len(self.sizes))


def blocks(docs: DataFrame, size: int) -> DataFrame:
    """docs (doc_id, text) dealt out to blocks of some megabytes of text by a number of the row, so that equal rows part."""
    most = max(-(-size // BLOCK), min(3 * tasks(docs.sparkSession), -(-size // LEAST)), 1)
    return docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(most)).cast("int").alias("block"), "doc_id", "text")


def requests(dealt: DataFrame, order: int, bits: int, ranges: int, counted: bool) -> DataFrame:
    """(range, block, h, n): the n-grams of each block by range of their hashes; n holds their counts, or zeros unless counted."""
    cuts = np.array([(r << bits) // ranges for r in range(1, ranges)], np.uint64)

    def each(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        h, n = Grams(b["text"].tolist(), order, bits, Hashes()).asked()
        n = n.astype(np.uint64) * np.uint64(counted)
        edge = np.r_[0, np.searchsorted(h, cuts), len(h)].tolist()
        rows = [(r, key[0], planes(np.diff(h[s:e], prepend=np.uint64(0))), planes(n[s:e])) for r, (s, e) in enumerate(zip(edge, edge[1:])) if s < e]
        return pd.DataFrame(rows, columns=["range", "block", "h", "n"])

    return dealt.groupBy("block").applyInPandas(each, "range int, block int, h binary, n binary")


def _totals(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of the rows of one range: different hashes, their counts, and of each row its slots among them and own counts."""
    own = [np.cumsum(values(x)) for x in b["h"]]
    n = [values(x) for x in b["n"]]
    h, slot = np.unique(np.concatenate(own), return_inverse=True)
    total = np.bincount(slot, np.concatenate(n).astype(float), len(h)).astype(np.uint64)
    return h, total, np.split(slot, np.cumsum([len(x) for x in own])[:-1]), n


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(h, c): the count table of all n-grams of up to `order` words, and of the empty one (all words), partitioned by ranges of hashes."""
    size = text_bytes(docs)

    def each(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        h, total, _, _ = _totals(b)
        return pd.DataFrame({"h": h.view(np.int64), "c": total.astype(np.int64)})

    return requests(blocks(docs, size), order, width(size, order), 1 + size // RANGE, True).groupBy("range").applyInPandas(each, "h long, c long")


def scores(docs: DataFrame, corpus: DataFrame | None = None, backoff: float = BACKOFF, order: int = ORDER) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_words, log_score, mean_log_score, both rounded to 4 places.

    A word after two others scores the count of the three over that of the two, if the corpus has the
    three; else backoff times the score after one other, and so on down to its share of all words. Words
    that the corpus (docs itself, unless given) lacks add nothing. Null texts and those without words
    have log_score 0 and no mean; repeated rows are documents of their own; columns other than doc_id and
    text are not looked at. An empty table gives none.

    Documents are dealt out to blocks of at most some BLOCK bytes besides the longest text. A block asks
    each range of hashes for the counts of its different n-grams; the range adds up its part of the count
    table and answers in the order asked; the block joins the answers to its n-grams and adds up each
    document. Texts are shuffled once. A frequent n-gram is one entry per block, however often it occurs,
    and all counts are whole: none is dropped, however rare. There are as many rows of requests as pairs of
    a block and a range, at most one per n-gram asked.
    """
    size = text_bytes(docs)
    dealt = blocks(docs.select("doc_id", "text"), size)
    more = text_bytes(corpus) if corpus is not None else 0
    bits, ranges = width(size + more, order), 1 + (size + more) // RANGE
    asked = requests(dealt, order, bits, ranges, corpus is None)
    if corpus is not None:
        told = requests(blocks(corpus.select(F.lit(None).alias("doc_id"), "text"), more), order, bits, ranges, True)
        asked = asked.unionByName(told.withColumn("block", -1 - F.col("block")))

    def answer(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        _, total, slots, _ = _totals(b)
        rows = [(key[0], block, planes(total[s])) for block, s in zip(b["block"], slots) if block >= 0]
        return pd.DataFrame(rows, columns=["range", "block", "c"])

    def score(key: tuple, b: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        g = Grams(b["text"].tolist(), order, bits, Hashes())
        h, _ = g.asked()
        c = np.concatenate([values(x) for x in answers.sort_values("range")["c"]]).astype(float)
        if len(c) != len(h):
            raise RuntimeError(f"block {key[0]} asked for {len(h)} n-grams and has {len(c)} answers")
        s, n = g.scores(h, c, backoff), g.sizes
        mean = np.divide(s, n, out=np.full(len(s), np.nan), where=n > 0)
        return pd.DataFrame({"doc_id": b["doc_id"], "n_words": n, "s": s, "m": mean})

    answers = asked.groupBy("range").applyInPandas(answer, "range int, block int, c binary")
    kind = dict(docs.dtypes)["doc_id"]
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, f"doc_id {kind}, n_words long, s double, m double")
    return out.select("doc_id", "n_words", F.round("s", 4).alias("log_score"), F.round(F.nanvl("m", F.lit(None)), 4).alias("mean_log_score"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
p as (select r, ws, unnest(range(1, len(ws) + 1)) as i from d),
x as (select r, ws[i] as w, case when i > 1 then ws[i-1] end as v, case when i > 2 then ws[i-2] end as u from p),
c1 as (select w, count(*)::double as c from x group by w),
n as (select count(*)::double as n from x),
c2 as (select v, w, count(*)::double as c from x where v is not null group by all),
c3 as (select u, v, w, count(*)::double as c from x where u is not null group by all),
s as (select x.r, case when c3.c is not null then ln(c3.c / b.c) when c2.c is not null then ln(0.4::double ** (x.u is not null)::int::double) + ln(c2.c / a.c)
        else ln(0.4::double ** ((x.u is not null)::int + (x.v is not null)::int)::double) + ln(c1.c / n.n) end as g
      from x join c1 on c1.w = x.w cross join n left join c2 on c2.v = x.v and c2.w = x.w left join c3 on c3.u = x.u and c3.v = x.v and c3.w = x.w
        left join c1 a on a.w = x.v left join c2 b on b.v = x.u and b.w = x.v),
t as (select r, sum(g) as g from s group by r)
select d.doc_id, len(d.ws)::bigint as n_words, round(coalesce(t.g, 0), 4) as log_score, round(case when len(d.ws) > 0 then t.g / len(d.ws) end, 4) as mean_log_score
from d left join t on t.r = d.r
"""
