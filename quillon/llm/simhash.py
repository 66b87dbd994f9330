"""Operator 8: near duplicates by SimHash, compared bit-sliced; and the pipeline's stage, which checks what that finds for Jaccard similarity."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, tasks
from .components import Forest, connected_components

#: Fingerprints of a run that one task compares; longer runs are dealt out as pairs of blocks of this size.
BLOCK = 2048
#: Of pairs at the least Jaccard similarity, the share that may meet under no key; rows that a key should have.
MISSED, RUN = 1 / 1500, 256
#: Words of a shingle set's fingerprints that are compared, and the deviations of their differing bits that the radius allows for.
COMPARED, SIGMA = 4, 4.5
#: Shingle sets, and shingles, of a candidate group's block; larger groups are dealt out as pairs of blocks.
SETS, SHINGLES = 512, 500_000


def shingles(text: str, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 values of all k-word shingles, A-Z lower-cased; fewer words make one shingle, none makes none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return np.array([h(line[s:e], seed) for s, e in zip(starts, ends[min(k, len(words)) - 1 :].tolist())], np.uint64)


def fingerprint(text: str, k: int = 4, seed: int = 42) -> int:
    """SimHash of all k-word shingles; 0 without words."""
    hashes = shingles(text, k, seed)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp) with fp as a signed long; null texts have no words. Per row, without a shuffle."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t if isinstance(t, str) else "", k) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "fp": fp.view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(each, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def planes(x: np.ndarray) -> np.ndarray:
    """Bit planes of uint64 values, or of rows of several: row b holds bit b of every value, 64 values to a word."""
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").T
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, -len(x) % 64))), axis=1, bitorder="little")).view(np.uint64)


def within(differences: Iterable[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose differing bits number at most radius.

    Takes one array of difference words per bit plane and adds it to vertical counters by carry-save: two
    words that wait at a counter are added to it at once, and their carry waits at the next one. Stops as soon as every lane
    is past the radius.
    """
    top = max(1, radius.bit_length())
    counters: list[np.ndarray] = []
    waiting: list[np.ndarray | None] = [None] * top
    over = np.zeros(0, np.uint64)
    for n, x in enumerate(differences):
        if not counters:
            counters, over = [np.zeros_like(x) for _ in range(top)], np.zeros_like(x)
        for k in range(top):
            if (y := waiting[k]) is None:
                waiting[k] = x
                break
            c, waiting[k] = counters[k], None
            u = c ^ x
            counters[k] = u ^ y
            x = (c & x) | (u & y)
        else:
            over |= x
        if n % (1 << top) == (1 << top) - 1:
            # Every counter's words have been added up by now.
            if (past(counters, over, radius) == ~np.uint64(0)).all():
                return np.zeros_like(over)
    carry = None
    for k in range(top):
        left, carry = [x for x in (waiting[k], carry) if x is not None], None
        for x in left:
            both = counters[k] & x
            counters[k] = counters[k] ^ x
            carry = both if carry is None else carry | both
    if carry is not None:
        over |= carry
    return ~past(counters, over, radius)


def past(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is above radius, bit by bit from the highest."""
    above, equal = over.copy(), ~over
    for bit in reversed(range(len(counters))):
        c = counters[bit]
        if radius >> bit & 1:
            equal = equal & c
        else:
            above |= equal & c
            equal = equal & ~c
    return above


def run_links(fp: np.ndarray, ids: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Stars that connect what is linked among the fingerprints of one long run; fp: a row per fingerprint, of one word or more."""
    p, m, step = planes(fp), len(fp), 256
    fp = np.ascontiguousarray(fp.reshape(m, -1))
    near = []
    full = ~np.uint64(0)
    for at in range(0, m, step):
        q = np.unpackbits(fp[at : at + step].view(np.uint8), axis=1, bitorder="little").T
        flips = np.where(q, full, np.uint64(0))[:, :, None]
        near.append(within((x ^ f for x, f in zip(p, flips)), radius))
    rows = np.concatenate(near)
    bits = lambda words: np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:m])
    left = np.zeros(p.shape[1], np.uint64)
    left.view(np.uint8)[: (m + 7) // 8] = np.packbits(np.bitwise_count(rows).sum(axis=1, dtype=np.int64) > 1, bitorder="little")  # those near to others than themselves
    out = []
    while left.any():
        part = np.zeros_like(left)
        w = int(np.flatnonzero(left)[0])
        part[w] = left[w] & (~left[w] + np.uint64(1))
        fresh = part.copy()
        left &= ~part
        while len(at := bits(fresh)):
            fresh = np.bitwise_or.reduce(rows[at], axis=0) & left
            left &= ~fresh
            part |= fresh
        group = ids[bits(part)]
        out += [(int(x), int(group.min())) for x in group if x != group.min()]
    return out


def _compare(words: list[str], radius: int):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        keys = ["table", "key", "i", "j"]

        def links(b: pd.DataFrame) -> pd.DataFrame:
            fp, ids = np.ascontiguousarray(b[words].to_numpy()).view(np.uint64), b["id"].to_numpy()
            k = b[keys].to_numpy()
            edge = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1), True])
            sizes = np.diff(edge)
            f = Forest()
            for s in np.flatnonzero(sizes >= 64):
                for x, y in run_links(fp[edge[s] : edge[s + 1]], ids[edge[s] : edge[s + 1]], radius):
                    f.link(x, y)
            run = np.repeat(np.where(sizes < 64, np.arange(len(sizes)), -1 - np.arange(len(sizes))), sizes)
            for d in range(1, 64):
                a = np.flatnonzero((run[:-d] == run[d:]) & (run[d:] >= 0)) if d < len(run) else run[:0]
                if not len(a):
                    break
                for at in range(0, len(a), 1 << 16):
                    i = a[at : at + (1 << 16)]
                    ok = within(iter(planes(fp[i] ^ fp[i + d])), radius)
                    i = i[np.unpackbits(ok.view(np.uint8), bitorder="little")[: len(i)].astype(bool)]
                    for x, y in zip(ids[i].tolist(), ids[i + d].tolist()):
                        f.link(x, y)
            return pd.DataFrame(f.edges(), columns=["src", "dst"])

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = (b[keys] == b[keys].iloc[-1]).all(axis=1).to_numpy()
            rest, b = b[last], b[~last]
            if len(b):
                yield links(b)
        if rest is not None:
            yield links(rest)

    return each


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(src, dst): links that connect exactly what fingerprints within radius bits connect.

    fps: fp and id, both long, each fp once. Of radius + 2 bit blocks two at least are equal in any such
    pair, so it meets under the key of those two; there is a key for each choice of two. The rows of a
    key are compared bit-sliced. A key with more than BLOCK rows is dealt out by hash as pairs of blocks,
    so no task holds more than some 2 * BLOCK rows of a key, and no pair is left out.
    """
    n = radius + 2
    cut = [round(64 * b / n) for b in range(n + 1)]
    mask = [((1 << cut[b + 1]) - 1) ^ ((1 << cut[b]) - 1) for b in range(n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*(F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(mask[a] | mask[b])).cast("long")).alias("key")) for t, (a, b) in enumerate(combinations(range(n), 2))))
    return links_by_key(fps.select("fp", "id", F.explode(keys).alias("k")).select("fp", "id", "k.table", "k.key"), ["fp"], radius)


def links_by_key(rows: DataFrame, words: list[str], radius: int) -> DataFrame:
    """(src, dst): links that connect what fingerprints within radius bits connect that share a key.

    rows: table, key, id and the words of the fingerprint, all but table long.
    """
    long = rows.groupBy("table", "key").agg(F.count("*").alias("_n")).where(f"_n > {BLOCK}").select("table", "key", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_b"))
    rows = rows.join(long, ["table", "key"], "left").withColumn("_b", F.coalesce("_b", F.lit(1)))
    rows = rows.withColumn("_at", F.pmod(F.xxhash64(*words), F.col("_b")).cast("int"))
    rows = rows.select("table", "key", *words, "id", "_at", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_o"))
    rows = rows.select("table", "key", F.least("_at", "_o").alias("i"), F.greatest("_at", "_o").alias("j"), *words, "id")
    rows = rows.repartition(tasks(rows.sparkSession), "table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j", *words)
    return rows.mapInPandas(_compare(words, radius), "src long, dst long")


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """One row per document (doc_id, text): doc_id, fp, component_id, the smallest doc_id reachable by links.

    Documents with equal fingerprints are one node, those without words included; repeated rows stay
    rows. Nothing is sampled or capped.
    """
    f = durable(fingerprints(docs, k))
    node = f.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").cast("long").alias("id"))
    parts = connected_components(near_links(node, radius)).withColumnRenamed("component", "_c")
    node = node.join(parts, "id", "left").select("fp", F.coalesce("_c", "id").alias("component_id"))
    return f.join(node, "fp", "left").select("doc_id", "fp", "component_id")


def scheme(rows: int, least: float) -> tuple[int, int, int]:
    """Bits of a key, keys, and the radius on COMPARED words, for shingle sets of a Jaccard similarity of least or more.

    At a Jaccard similarity of s, the cosine is 2 s / (1 + s) or more, and a bit of a SimHash differs once in pi / angle
    times. Keys have more bits in a larger table, so that some RUN rows meet under each, and are then as many as MISSED asks for.
    """
    differ = math.acos(2 * least / (1 + least)) / math.pi
    bits = min(32, max(6, math.ceil(math.log2(max(1, rows) / RUN))))
    keys = math.ceil(math.log(MISSED) / math.log1p(-((1 - differ) ** bits)))
    mean = 64 * COMPARED * differ
    return bits, keys, math.ceil(mean + SIGMA * math.sqrt(mean * (1 - differ)))


def simhashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """Independent SimHash words of a shingle set: of each hash, several mixed values vote; a tie is 0."""
    r = np.random.default_rng(42).integers(0, 1 << 64, (2, words), dtype=np.uint64)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):  # 255 ones fill a byte
        x = (hashes[at : at + 255, None] ^ r[0]) * (r[1] | np.uint64(1))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        votes = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(votes.view(np.uint64), axis=0).view(np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)


def name_of(hashes: np.ndarray) -> int:
    """A signed long that stands for a sorted set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def signatures(docs: DataFrame, k: int, words: int) -> DataFrame:
    """(doc_id, row, node, n, words) per row: the row's hash, and its shingle set's name, size and SimHash words (none without words of text)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.unique(shingles(t if isinstance(t, str) else "", k)) for t in b["text"]]
            yield b[["doc_id", "row"]].assign(node=[name_of(x) for x in sets], n=[len(x) for x in sets], words=[simhashes(x, words) if len(x) else np.zeros(0, np.int64) for x in sets])

    x = docs.select("doc_id", F.xxhash64(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), "text")
    return x.mapInPandas(each, f"doc_id {dict(docs.dtypes)['doc_id']}, row long, node long, n long, words array<long>")


def similar(ids: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect exactly what pairs of sets with a Jaccard similarity of least or more connect."""
    f, size = Forest(), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held, start = owner[np.argsort(token, kind="stable")], np.cumsum(times) - times
    edge = np.r_[0, np.cumsum(size)]
    for x in range(len(sets) - 1):
        t = token[edge[x] : edge[x + 1]]
        t = t[times[t] > 1]
        n = times[t]
        at = np.repeat(start[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(held[at], minlength=len(sets))
        near = both >= least * (size + size[x] - both) - 1e-9
        for y in np.flatnonzero(near[x + 1 :]) + x + 1:
            f.link(ids[x], ids[y])
    return f.edges()


def _check(k: int, least: float):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, {}

        def links() -> pd.DataFrame:
            e = similar(list(held), list(held.values()), least) if len(held) > 1 else []
            return pd.DataFrame(e, columns=["src", "dst"], dtype="int64")

        for b in batches:
            for *now, node, text in b[["group", "i", "j", "node", "text"]].itertuples(index=False):
                if now != key:
                    yield links()
                    key, held = now, {}
                if node not in held and name_of(x := np.unique(shingles(text, k))) == node:
                    held[node] = x
        yield links()

    return each


def similar_links(docs: DataFrame, f: DataFrame, k: int, least: float, bits: int, keys: int, radius: int) -> DataFrame:
    """(src, dst) of nodes: links that connect what shingle sets of a Jaccard similarity of least or more connect.

    f: signatures(docs). Sets whose SimHashes agree in one of `keys` blocks of `bits` bits and differ by at most radius
    bits of the compared words are candidates; all pairs within a group of connected candidates are checked exactly on the
    shingles. At 0.8 two words differ by 9.7 bits of 64 on average: hence several independent words, keys that are
    short, as the bit-sliced comparison bears long runs, and a radius over all compared words.
    """
    node = f.where("n > 0").groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("words").alias("words"))
    node = durable(node)
    per, names = 64 // bits, [f"w{k}" for k in range(COMPARED)]
    key = lambda t: F.shiftrightunsigned(F.col("words")[t // per], t % per * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    at = F.explode(F.array(*(F.struct(F.lit(t).alias("table"), key(t).alias("key")) for t in range(keys)))).alias("k")
    rows = node.select(F.col("node").alias("id"), *(F.col("words")[k].alias(x) for k, x in enumerate(names)), at).select("id", *names, "k.table", "k.key")
    group = connected_components(links_by_key(rows, names, radius))
    group = durable(node.drop("words").join(group.select(F.col("id").alias("node"), F.col("component").alias("group")), "node"))
    cut = group.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("_b"))
    group = group.join(cut, "group").withColumn("_at", F.pmod(F.xxhash64("node"), F.col("_b")).cast("int"))
    group = group.select("group", "node", "row", "_at", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_o"))
    group = group.select("group", F.least("_at", "_o").alias("i"), F.greatest("_at", "_o").alias("j"), "node", "row")
    texts = docs.select(F.xxhash64(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), "text").where("text is not null")
    pairs = texts.join(group, "row").repartition(tasks(docs.sparkSession), "group", "i", "j").sortWithinPartitions("group", "i", "j")
    return pairs.select("group", "i", "j", "node", "text").mapInPandas(_check(k, least), "src long, dst long")


def keep_one(docs: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each component, that of least doc_id (null last), with the input's columns; of equal rows one.

    Components connect documents whose sets of k-word shingles have a Jaccard similarity of least or more.
    """
    bits, keys, radius = scheme(docs.count(), least)
    f = durable(signatures(docs, k, max(COMPARED, -(-keys // (64 // bits)))))
    parts = connected_components(similar_links(docs, f, k, least, bits, keys, radius)).withColumnRenamed("id", "node")
    f = f.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = f.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x")).select(F.col("x.row").alias("row"))
    first = durable(first.join(f.groupBy("row").agg(F.count("*").alias("times")), "row"))
    rows = docs.withColumn("_hash", F.xxhash64(*(docs[f"`{c}`"] for c in docs.columns)))
    take = lambda which: rows.join(first.where(which).select(F.col("row").alias("_hash")), "_hash", "left_semi")
    return take("times = 1").unionByName(take("times > 1").dropDuplicates(["_hash"])).drop("_hash")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = near_duplicates(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
