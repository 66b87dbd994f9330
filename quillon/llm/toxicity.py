"""Operator 7: toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, words

#: The bounded sample: labelled rows that teach, those of least md5.
MOST_ROWS = 20_000
#: Lengths of the beginnings that may enter the lexicon; a short word is its own beginning.
SHORTEST, LONGEST = 3, 8
FEATURES = ("density", "weight", "kinds", "hidden", "near", "capitals", "shouts", "marks", "digits", "obfuscated", "log_words")
PERSON = re.compile(r"\b(?:you|your|you're|u|ur|yourself|tu|te|toi|vous|du|dich|dir|ihr|usted|ti)\b")
OBFUSCATED = re.compile(r"[^\W\d_]+(?:[0-9@$*!|._\-]+[^\W\d_]+)+")
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "_": None, "-": None})
UPPER, MARKS, DIGITS = bytes(range(65, 91)), b"!\"'(),-./:;?*#%&$@", b"0123456789"


def finder(lexicon: dict[str, float]):
    a = ahocorasick.Automaton()
    for w, x in lexicon.items():
        a.add_word(w, (w, x))
    if lexicon:
        a.make_automaton()
    return a


def features(text: str, lexicon: dict[str, float], find) -> list[float]:
    """Dense features of a whole text, rates by word or byte: lexicon density and weight, different and hidden
    lexicon words, those within 40 characters of a second person, capitals, shouts, marks, digits, obfuscated words, length."""
    raw, low = text.encode(), text.lower()
    n, size = max(1, len(raw.split())), max(1, len(raw))
    hits: list[tuple[int, str, float]] = []
    if lexicon:
        for end, (w, x) in find.iter(low):
            s = end - len(w) + 1
            if not (s and low[s - 1].isalnum()) and not (hits and hits[-1][0] == s and hits.pop() is None):
                hits.append((s, w, x))  # of beginnings at one place the longest, which ends last
    hidden = 0
    odd = OBFUSCATED.findall(low)
    for w in odd:
        plain = w.translate(LEET)
        if (k := next((k for k in range(LONGEST, SHORTEST - 1, -1) if plain[:k] in lexicon), None)) is not None and not w.startswith(plain[:k]):
            hidden += 1
            hits.append((-1000, plain[:k], lexicon[plain[:k]]))
    near = sum(PERSON.search(low, max(0, s - 40), s + 40) is not None for s, _, _ in hits if s >= 0)
    lacks = lambda signs: (len(raw) - len(raw.translate(None, signs))) / size
    return [len(hits) / n, sum(x for _, _, x in hits) / n, float(len({w for _, w, _ in hits})), hidden / n, near / n, lacks(UPPER), lacks(b"!"), lacks(MARKS), lacks(DIGITS), len(odd) / n, float(np.log1p(n))]


class Trees:
    """Gradient boosting of logistic loss with histogram trees, and isotonic calibration of its margin."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10) -> None:
        self.rate, self.trees = rate, []
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)
        margin = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            tree: list = []
            self._grow(tree, b, g, h, np.arange(len(y)), depth, bins, least)
            self.trees.append(tree)
            margin += rate * self._leaf(tree, x)
        self.knots = (np.array([0.0]), np.array([0.5]))

    def _grow(self, tree: list, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, bins: int, least: int) -> int:
        at, (gs, hs) = len(tree), (g[rows].sum(), h[rows].sum())
        tree.append((None, 0.0, 0, 0, gs / (hs + 1.0)))
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * least:
            for k in range(b.shape[1]):
                col = b[rows, k]
                n = np.cumsum(np.bincount(col, minlength=bins))[:-1]
                gl, hl = (np.cumsum(np.bincount(col, w[rows], minlength=bins))[:-1] for w in (g, h))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(n < least) | (len(rows) - n < least)] = 0
                if gain.max(initial=0) > best[0]:
                    best = (gain.max(), k, int(gain.argmax()))
        if best[1] is not None:
            _, k, cut = best
            left = b[rows, k] <= cut
            i = self._grow(tree, b, g, h, rows[left], depth - 1, bins, least)
            j = self._grow(tree, b, g, h, rows[~left], depth - 1, bins, least)
            tree[at] = (k, float(self.edges[k][cut]), i, j, 0.0)
        return at

    @staticmethod
    def _leaf(tree: list, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x)), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            k, edge, i, j, value = tree[at]
            if k is None:
                out[rows] = value
            else:
                left = x[rows, k] < edge
                todo += [(i, rows[left]), (j, rows[~left])]
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((self._leaf(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Pool adjacent violators over the margins of rows that did not fit the trees."""
        m = self.margin(x)
        order = np.argsort(m, kind="stable")
        blocks: list[list[float]] = []  # sum of y, rows, least and largest margin
        for v, t in zip(m[order], y[order]):
            blocks.append([t, 1, v, v])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                s, n, _, hi = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
        if blocks:
            at = [v for s, n, lo, hi in blocks for v in (lo, hi)]
            self.knots = (np.array(at), np.repeat([s / n for s, n, _, _ in blocks], 2))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, plus a share of the margin too small to cross 0.5 that orders equal ones."""
        m = self.margin(x)
        p = np.interp(m, *self.knots)
        return np.clip(p + 1e-6 * (1 / (1 + np.exp(-m)) - 0.5) * (np.abs(p - 0.5) > 1e-5), 0, 1)


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5


def teach(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> tuple[dict[str, float], Trees | None]:
    """(lexicon, calibrated trees) from labelled rows whose crc32(doc_id) mod 5 is not 0.

    At most most_rows labels are used, those of least md5 of doc_id, so their ids may be broadcast; of several
    documents with one doc_id the least text teaches, and of several labels the largest. The lexicon takes every
    beginning that passes its test, so it is bounded by those rows' words.
    Remainders 1 and 2 give the lexicon (words of toxic texts by log-likelihood ratio), 3 the trees and 4
    the calibration, so no part is fitted to what it has seen. Null labels are left out. Without both
    classes in remainder 3 there are no trees.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold(F.col("doc_id")) != 0)
    one = one.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most_rows)
    rows = durable(docs.select("doc_id", "text").join(F.broadcast(one), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").cast("int").alias("toxic")).withColumn("part", fold(F.col("doc_id"))))
    bare = F.array_distinct(F.transform(words(F.lower("text")), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    starts = F.array_distinct(F.flatten(F.transform(F.filter(bare, lambda w: F.length(w) >= SHORTEST), lambda w: F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length(w), F.lit(LONGEST))), lambda k: F.left(w, k)))))
    told = rows.where("part in (1, 2)").select("toxic", F.explode(starts).alias("w"))
    n1, n0 = (rows.where("part in (1, 2)").agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first())
    lexicon: dict[str, float] = {}
    if n1 and n0:
        c = told.groupBy("w").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")).where("a >= 5")
        odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
        c = c.withColumn("x", odds).where("x > 2").collect()
        seen_in = {r["w"]: (r["a"], r["b"]) for r in c}
        shorter = {w[:-1] for w in seen_in if seen_in.get(w[:-1]) == seen_in[w]}  # the longer beginning says the same
        lexicon = {r["w"]: float(r["x"]) for r in sorted(c, key=lambda r: r["w"]) if r["w"] not in shorter}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = finder(lexicon)
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "part": b["part"], "x": [features(t if isinstance(t, str) else "", lexicon, find) for t in b["text"]]})

    seen = rows.where("part in (3, 4)").mapInPandas(each, "toxic int, part long, x array<double>").toPandas()
    seen = seen.iloc[np.lexsort(np.stack(seen["x"].to_list()).T)] if len(seen) else seen
    part = lambda k: (np.stack(seen[seen["part"] == k]["x"].to_list()), seen[seen["part"] == k]["toxic"].to_numpy().astype(float))
    if not (seen["part"] == 3).any() or len(set(part(3)[1])) < 2:
        return lexicon, None
    trees = Trees(*part(3))
    return lexicon, trees.calibrate(*part(4 if (seen["part"] == 4).any() else 3))


def toxicity(docs: DataFrame, lexicon: dict[str, float], trees: Trees | None) -> DataFrame:
    """One row per document (doc_id, text): doc_id, held_out, score, predicted.

    Scores depend on the text alone. Null and empty texts are scored as texts without words; without
    trees every score is 0; a null doc_id is not held out. Repeated rows are scored each, other columns are not
    looked at, and an empty table gives no rows. Per row, without a shuffle.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = finder(lexicon)
        for b in batches:
            x = np.array([features(t if isinstance(t, str) else "", lexicon, find) for t in b["text"]]).reshape(len(b), len(FEATURES))
            yield b[["doc_id", "held_out"]].assign(score=trees.score(x) if trees else np.zeros(len(b)))

    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    out = out.mapInPandas(each, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, *teach(docs, table(spark, sf_dir, "labels")))
