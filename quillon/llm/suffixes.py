"""Operator 5: removal of repeated byte strings, by induced sorting of the suffixes that can repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, key_of, table, tasks

#: Bytes of a repeated string; bytes of the sample string by which windows are grouped.
LENGTH, SAMPLE = 400, 32
#: Different strings of a group that one task sorts together; larger groups are halved until they fit.
GROUP = 2000
#: Window starts that one pass over a text takes; strings that are sorted together.
PASS, BATCH = 1 << 22, 8000
#: Width of the first group of offsets: all of them.
WIDEST = 512

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n of each."""
    base = 0x9E3779B97F4A7C15
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def samples(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups the windows of LENGTH bytes of a text by the sample they choose: (sample value, position, least and largest offset).

    A window chooses the leftmost of its SAMPLE-byte strings with the least hash, which depends on the
    window's bytes alone, so equal windows choose equal samples at equal offsets.
    """
    out = []
    for first in range(0, max(0, len(text) - LENGTH + 1), PASS):
        b = np.frombuffer(text, np.uint8, min(len(text) - first, PASS + LENGTH - 1), first).astype(np.uint64)
        power, inverse = _power(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * inverse[: len(b)], out=total[1:])
        n = len(b) - SAMPLE + 1
        v = (total[SAMPLE:] - total[:n]) * power[:n]
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(29)
        w = LENGTH - SAMPLE + 1
        k = np.full(-(-n // w) * w, ~np.uint64(0))
        k[:n] = (v & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
        rows = k.reshape(-1, w)
        left = np.minimum.accumulate(rows, axis=1).ravel()
        right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        m = n - w + 1
        at = (np.minimum(right[:m], left[w - 1 : w - 1 + m]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        hi = np.r_[lo[1:], m] - 1
        a = at[lo]
        out.append((v[a].view(np.int64), a + first, a - hi, a - lo))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def strings(docs: DataFrame) -> DataFrame:
    """One row per text that has samples: doc, text_md5, and by sample h (its value), a (position), lo and hi (offsets), f1 and f2 (128-bit hash of all that its windows cover)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for s in range(0, len(b), 256):
                out = []
                for doc, md5, text in b.iloc[s : s + 256].itertuples(index=False):
                    t = text.encode()
                    h, a, lo, hi = samples(t)
                    if len(h):
                        f = np.frombuffer(b"".join(digest(t[i:j]) for i, j in zip((a - hi).tolist(), (a - lo + LENGTH).tolist())), ">i8").astype(np.int64)
                        out.append((doc, md5, h, a.astype(np.int32), lo.astype(np.int16), hi.astype(np.int16), f[::2], f[1::2]))
                if out:
                    yield pd.DataFrame(out, columns=["doc", "text_md5", *SAMPLES])

    return docs.select("doc", "text_md5", "text").mapInPandas(each, "doc long, text_md5 binary, h array<long>, a array<int>, lo array<smallint>, hi array<smallint>, f1 array<long>, f2 array<long>")


SAMPLES = ["h", "a", "lo", "hi", "f1", "f2"]


def meeting(docs: DataFrame) -> DataFrame:
    """A row per sample of strings() whose value occurs more than once; what occurs once repeats nothing.

    Texts are written with their samples in arrays, and their values counted alone, as most samples go here.
    """
    packed = durable(strings(docs))
    found = packed.select("doc", "text_md5", F.inline(F.arrays_zip(*SAMPLES))).toDF("doc", "text_md5", *SAMPLES)
    found = found.select("doc", "text_md5", "h", F.col("a").cast("long"), F.col("lo").cast("int"), F.col("hi").cast("int"), "f1", "f2")
    # The values are written first: both sides of the join are plain shuffles, so Spark splits the samples of a very common one.
    common = durable(found.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h"))
    return durable(found.join(common, "h", "left_semi"))


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the strings wanted of each text."""
    for b in batches:
        out = []
        for doc, md5, text, wanted in zip(b["doc"], b["text_md5"], b["text"], b["wanted"]):
            t = text.encode()
            for w in wanted:
                out.append((w["g"], w["lo"], w["hi"], w["f"], w["n"], doc, md5, w["a"], t[w["a"] - w["hi"] : w["a"] - w["lo"] + LENGTH]))
        yield pd.DataFrame(out, columns=COLUMNS)


ITEM = "g binary, lo int, hi int, f binary, n long, doc long, text_md5 binary, a long, s binary"
COLUMNS = [x.split()[0] for x in ITEM.split(", ")]


def _halve(width: int):
    """Cuts the offsets of each string at half of `width`; halves group by what all windows of the half have in common."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = width // 2
        for b in batches:
            out = []
            for g, lo, hi, _, n, doc, md5, a, s in b.itertuples(index=False):
                for part in (lo // width * width, lo // width * width + half):
                    x, y = max(lo, part), min(hi, part + half - 1)
                    if x <= y:
                        t = s[hi - y : hi - x + LENGTH]
                        core = t[y - part : y - (part + half - 1) + LENGTH] if half < LENGTH else b""
                        out.append((xxhash.xxh3_128_digest(g + part.to_bytes(4, "little") + core), x, y, xxhash.xxh3_128_digest(bytes([x % 256, x // 256, y % 256, y // 256]) + t), n, doc, md5, a, t))
            yield pd.DataFrame(out, columns=COLUMNS)

    return each


def repeated(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which windows occur twice or more within their group: a row per string, a column per offset.

    A string covers the windows at offsets lo to hi left of its sample. The suffixes at offset 0 are
    sorted, with the lengths of common prefixes of neighbours; the order at offset x follows from that at
    x - 1 by the byte in front (a stable sort), and the common prefix of neighbours with the same byte is
    one more than the least between them before. A window repeats if a neighbour at its offset shares LENGTH
    bytes.
    """
    m, top = len(texts), int(hi.max()) + 1
    low = np.array([min(int(x), LENGTH) for x in lo])
    base = np.zeros(m, np.int64)  # the least offset of the group, at which it starts
    np.minimum.at(first := np.full(int(group.max()) + 1, LENGTH), group, low)
    base[:] = first[group]
    tails = [t[h - b :] for t, h, b in zip(texts, hi.tolist(), base.tolist())]
    order = np.array(sorted(range(m), key=lambda i: (group[i], tails[i])), np.int64)
    size = np.array([len(t) for t in tails])
    same = np.zeros(m, np.int64)
    for at in range(1, m, 2048):
        rows = order[at - 1 : at + 2048]
        x = np.zeros((len(rows), LENGTH + 1), np.uint8)
        for r, i in enumerate(rows):
            x[r, : size[i]] = np.frombuffer(tails[i], np.uint8)
        differ = x[1:] != x[:-1]
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
        same[at : at + len(rows) - 1] = np.minimum(n, np.minimum(size[rows[1:]], size[rows[:-1]]))
    same[1:][group[order[1:]] != group[order[:-1]]] = 0
    front = np.zeros((top + 1, m), np.uint8)  # byte in front at offset x, counted from the group's base
    for i, (t, h, b) in enumerate(zip(texts, hi.tolist(), base.tolist())):
        front[1 : h - b + 1, i] = np.frombuffer(t, np.uint8, h - b)[::-1]
    span, out = hi - base, np.zeros((m, top), bool)

    def mark(step: int) -> None:
        twin = same >= LENGTH
        i = np.union1d(order[twin], order[np.flatnonzero(twin) - 1]) if twin.any() else order[:0]
        out[i, base[i] + step] = True

    mark(0)
    for step in range(1, int(span.max()) + 1):
        keep = np.flatnonzero(span[order] >= step)
        if not len(keep):
            break
        ways = [same]
        while (1 << len(ways)) <= len(same):
            w, d = ways[-1], 1 << (len(ways) - 1)
            ways.append(np.minimum(w[: len(w) - d], w[d:]) if len(w) > d else w)
        key = group[order[keep]] * 256 + front[step, order[keep]]
        new = keep[np.argsort(key, kind="stable")]
        key = np.sort(key, kind="stable")
        n = np.zeros(len(new), np.int64)
        twin = np.flatnonzero(key[1:] == key[:-1]) + 1
        i, j = new[twin - 1] + 1, new[twin]  # least of same[i..j]
        level = np.log2(j - i + 1).astype(np.int64)
        level[(1 << (level + 1)) <= j - i + 1] += 1
        for k in np.unique(level):
            at = level == k
            n[twin[at]] = np.minimum(ways[k][i[at]], ways[k][j[at] - (1 << int(k)) + 1]) + 1
        order, same = order[new], n
        mark(step)
    return out


def _sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated windows of the strings that occur once, as (text_md5, s, e) in bytes; rows come sorted by group."""

    def solve(b: pd.DataFrame) -> pd.DataFrame:
        group = (b["g"] != b["g"].shift()).cumsum().to_numpy() - 1
        lo, hi = b["lo"].to_numpy(np.int64), b["hi"].to_numpy(np.int64)
        found = repeated(group, lo, hi, b["s"].tolist())
        out = []
        for i in np.flatnonzero((b["n"].to_numpy() == 1) & found.any(axis=1)):
            edge = np.flatnonzero(np.diff(np.r_[False, found[i], False]))
            a = int(b["a"].iat[i])
            out += [(b["text_md5"].iat[i], a - int(y) + 1, a - int(x) + LENGTH) for x, y in zip(edge[::2], edge[1::2])]
        return pd.DataFrame(out, columns=["text_md5", "s", "e"])

    rest: list[pd.DataFrame] = []
    held = 0
    for b in batches:
        last = (b["g"] == b["g"].iat[-1]).to_numpy()
        cut = int(np.flatnonzero(last)[0])
        if held + len(b) > BATCH and (cut or (rest and b["g"].iat[0] != rest[-1]["g"].iat[-1])):
            yield solve(pd.concat([*rest, b.iloc[:cut]], ignore_index=True))
            rest, held = [], 0
            b = b.iloc[cut:]
        rest.append(b)
        held += len(b)
    if rest:
        yield solve(pd.concat(rest, ignore_index=True))


def repeats(docs: DataFrame) -> DataFrame:
    """(text_md5, spans): byte ranges of each text that strings of LENGTH bytes found elsewhere cover; texts without any are absent.

    docs: doc (long), text_md5, text. Windows are grouped by sample; strings (all that the windows of a sample
    cover) that are equal need no sorting: they are counted. What differs within a group is sorted by
    induction, in tasks that Spark's spilling sort feeds group by group. A group of more than GROUP
    different strings, such as the edges of a very common passage, is first cut into halves of its offsets,
    grouped by their common bytes and counted again, down to single windows if need be: no group is
    gathered whole, no window left out.
    """
    found, string = meeting(docs), ["h", "lo", "hi", "f1", "f2"]
    kinds = durable(found.groupBy(*string).agg(F.count("*").alias("n"), F.min(F.struct("doc", "text_md5", "a")).alias("rep")))
    twice = kinds.where("n > 1").select(*string)
    out = found.join(twice, string).select("text_md5", (F.col("a") - F.col("hi")).alias("s"), (F.col("a") - F.col("lo") + LENGTH).alias("e")).distinct()

    mixed = kinds.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("h")
    name = lambda *cols: F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in cols)))
    want = kinds.join(mixed, "h", "left_semi").select("rep.doc", "rep.text_md5", F.struct(name("h").alias("g"), "lo", "hi", name("f1", "f2").alias("f"), "n", F.col("rep.a").alias("a")).alias("w"))
    want = want.groupBy("doc", "text_md5").agg(F.collect_list("w").alias("wanted"))
    items = durable(docs.join(want, ["doc", "text_md5"]).select("doc", "text_md5", "text", "wanted").mapInPandas(_fetch, ITEM))

    width, sets = WIDEST, []
    while True:
        size = items.groupBy("g").agg(F.count_distinct("f").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
        fits = items.join(size.where(f"m <= {GROUP}").select("g"), "g", "left_semi")
        sets.append(fits.select("g", "lo", "hi", "n", "text_md5", "a", "s"))
        large = durable(size.where(f"m > {GROUP}").select("g"))
        if width == 1 or large.isEmpty():
            break
        halves = durable(items.join(large, "g", "left_semi").select(*COLUMNS).mapInPandas(_halve(width), ITEM))
        width //= 2
        count = halves.groupBy("g", "f").agg(F.sum("n").alias("all"), F.min(F.struct("doc", "text_md5", "a")).alias("rep"))
        halves = durable(halves.join(count, ["g", "f"]))
        now = halves.where("n = 1 and all > 1").select("text_md5", (F.col("a") - F.col("hi")).alias("s"), (F.col("a") - F.col("lo") + LENGTH).alias("e"))
        out = out.unionByName(now)
        items = halves.where(F.struct("doc", "text_md5", "a") == F.col("rep")).withColumn("n", F.col("all"))
    todo = sets[0]
    for x in sets[1:]:
        todo = todo.unionByName(x)
    # By a hash of g: a repartition by g itself counts as done by the joins before, and Spark then takes their shuffles apart at run time.
    todo = todo.repartition(tasks(docs.sparkSession), F.xxhash64("g")).sortWithinPartitions("g")
    out = out.unionByName(todo.mapInPandas(_sort, "text_md5 binary, s long, e long"))
    return out.groupBy("text_md5").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for text, spans in zip(b["text"], b["spans"]):
            t, kept, at, n = text.encode(), hashlib.sha256(), 0, 0
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in spans) if spans is not None else ():
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            for s, e in merged:
                kept.update(t[at:s])
                at = e
                n += e - s
            kept.update(t[at:])
            out.append((len(t), n, len(merged), kept.hexdigest()))
        yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])], axis=1)


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of LENGTH bytes that also starts elsewhere, in any document, goes.
    Null texts are empty; repeated rows are documents of their own, so both lose what they share. Other columns are
    not looked at, and an empty table gives no rows. Texts of LENGTH bytes or more meet their spans by hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # Short texts repeat nothing and meet nothing: they are dealt out by doc_id.
    name = F.when(F.octet_length(text) >= LENGTH, F.md5(text)).otherwise(F.md5(F.concat(F.lit("short"), key_of(F.col("doc_id")))))
    docs = docs.select("doc_id", F.xxhash64(key_of(F.col("doc_id"))).alias("doc"), F.unhex(name).alias("text_md5"), text.alias("text"))
    x = docs.select("doc_id", "text_md5", "text").join(repeats(docs), "text_md5", "left")
    return x.select("doc_id", "text", "spans").mapInPandas(_cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
