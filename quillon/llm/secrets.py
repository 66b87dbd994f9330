"""Operator 9: secret scans. Fixed patterns, and probabilistic automata inferred from the credentials they find."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What may be a credential without a name before it.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
PIECE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    out = [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if NAMES.search(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def sign(c: str) -> str:
    """The alphabet of the automata: digits 0, a-f b, other small letters z, A-F B, other capitals Z, else the sign itself."""
    return "0" if c.isdigit() else ("b" if c in "abcdef" else "z") if c.islower() else ("B" if c in "ABCDEF" else "Z") if c.isupper() else c


#: Logarithms of how many characters stand for a sign.
LOG_SIZE = {"0": math.log(10), "b": math.log(6), "z": math.log(20), "B": math.log(6), "Z": math.log(20)}
#: A candidate is a credential if a format is so many times as likely as ordinary text: a logarithm.
ODDS = math.log(100)
#: What the shares of single characters count for beside those after another: a small corpus must not take its few credentials for ordinary text.
SMOOTH = 50
#: Characters of ordinary text: digits are one, and all that credentials lack is another, as is the space around a word.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_.=-"
CODES = len(LETTERS) + 2
CODE = np.zeros(256, np.int64)
CODE[list(b"0123456789")] = 1
CODE[list(LETTERS.encode())] = np.arange(2, CODES)


class Ordinary:
    """How likely a word is as ordinary text: the chance of each character after the one before. Longer chains would learn unnamed credentials that have many copies."""

    def __init__(self, counts: np.ndarray) -> None:
        c2 = counts.reshape(CODES, CODES).astype(float)
        c1 = c2.sum(0)
        p1 = (c1 + 0.5) / (c1 + 0.5).sum()
        self.log = np.log((c2 + SMOOTH * p1) / (c2.sum(1, keepdims=True) + SMOOTH))
        self.log[:, 1] -= math.log(10)

    def score(self, word: str) -> float:
        x = np.r_[0, CODE[np.frombuffer(word.encode(), np.uint8)], 0]
        return float(self.log[x[:-1], x[1:]].sum())


def pairs(text: str) -> np.ndarray:
    """Codes of all pairs of neighbouring characters of a text."""
    x = CODE[np.frombuffer(text.encode(), np.uint8)]
    return x[:-1] * CODES + x[1:]


class Automaton:
    """A deterministic probabilistic automaton inferred by merging compatible states of a prefix tree (Alergia).

    Two states are compatible if their frequencies of ending and of each next sign differ by less than
    the Hoeffding bound at `alpha`, and so do those of their successors. Blue states are visited in
    order of depth and sign, so the result depends on the multiset of words alone.
    """

    def __init__(self, words: Counter, alpha: float = 0.01) -> None:
        self.words = sorted(words)
        self.n, self.end, self.to = [0], [0], [{}]
        for w, times in sorted(words.items()):
            at = 0
            self.n[0] += times
            for c in map(sign, w):
                if c not in self.to[at]:
                    self.to[at][c] = [len(self.n), 0]
                    self.n.append(0)
                    self.end.append(0)
                    self.to.append({})
                self.to[at][c][1] += times
                at = self.to[at][c][0]
                self.n[at] += times
            self.end[at] += times
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, seen = [0], {0}
        while True:
            blue = next(((r, c, t[0]) for r in red for c, t in sorted(self.to[r].items()) if t[0] not in seen), None)
            if blue is None:
                break
            r, c, b = blue
            for q in red:
                if self.compatible(q, b):
                    self.to[r][c][0] = q
                    self.fold(q, b)
                    break
            else:
                red.append(b)
                seen.add(b)

    def differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self.differ(self.end[a], self.n[a], self.end[b], self.n[b]):
                return False
            for c in self.to[a].keys() | self.to[b].keys():
                x, y = self.to[a].get(c), self.to[b].get(c)
                if self.differ(x[1] if x else 0, self.n[a], y[1] if y else 0, self.n[b]):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.n[a] += self.n[b]
            self.end[a] += self.end[b]
            for c, (t, times) in self.to[b].items():
                if c in self.to[a]:
                    self.to[a][c][1] += times
                    todo.append((self.to[a][c][0], t))
                else:
                    self.to[a][c] = [t, times]

    def score(self, word: str) -> float:
        """The logarithm of the word's likelihood; a sign that the automaton has no way for costs half a word's share, and leads to its start."""
        at, total = 0, 0.0
        for c in map(sign, word):
            step = self.to[at].get(c)
            total += (math.log(step[1] / self.n[at]) if step else math.log(0.5 / (self.n[at] + 1)) - 2.0) - LOG_SIZE.get(c, 0.0)
            at = step[0] if step else 0
        return total + math.log(max(self.end[at], 0.5) / self.n[at])


class Model:
    """Automata of formats, and ordinary text to hold them against."""

    def __init__(self, automata: list[Automaton], ordinary: Ordinary) -> None:
        self.automata, self.ordinary = automata, ordinary
        self.known = dict.fromkeys((w for a in automata for w in a.words), math.inf)  # a copy of a labelled word needs no likelihood

    def __len__(self) -> int:
        return len(self.automata)

    def odds(self, word: str) -> float:
        """The logarithm of how many times as likely the word is as the best format than as ordinary text."""
        if (x := self.known.get(word)) is not None:
            return x
        return max((a.score(word) for a in self.automata), default=-math.inf) - self.ordinary.score(word)


def labelled(docs: DataFrame) -> DataFrame:
    """(kind, word, n): what the base patterns find in all documents, counted; word is the credential itself. Kind "text" has the pairs of neighbouring characters of all else, by code."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = np.zeros(CODES**2, np.int64)
        for b in batches:
            c, parts = Counter(), [np.zeros(0, np.int64)]
            for t in b["text"]:
                if isinstance(t, str):
                    at, rest = 0, []
                    for kind, s, e in base_spans(t):
                        c[kind, ASSIGN.match(t, s, e)[2] if kind == "assign" else t[s:e]] += 1
                        rest.append(t[at:s])
                        at = max(at, e)
                    parts.append(pairs(" \n".join([*rest, t[at:]])))
            text += np.bincount(np.concatenate(parts), minlength=len(text))
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["kind", "word", "n"])
        k = np.flatnonzero(text)
        yield pd.DataFrame({"kind": "text", "word": k.astype(str), "n": text[k]})

    return docs.select("text").mapInPandas(found, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, per_kind: int = 2000) -> Model:
    """One automaton per kind of labelled credential that has at least 20 different words, and the corpus's ordinary text.

    Automata are fitted on at most per_kind distinct words of each kind, those with the smallest md5: a bounded
    sample of labelled words that does not depend on order or partitions; only words that mix digits and letters, as
    candidates do, and whole ones. Ordinary text is counted over all documents, base credentials left out; the driver
    receives at most CODES ** 2 counts of it.
    """
    found = durable(labelled(docs))
    mixed = found.where("word rlike '[0-9]' and word rlike '[A-Za-z]'")
    automata = []
    for kind in KINDS[:3]:
        rows = mixed.where(F.col("kind") == kind).orderBy(F.md5("word"), "word").limit(per_kind).select("word").collect()
        if len(rows) >= 20:
            automata.append(Automaton(Counter(r["word"] for r in rows)))
    counts = np.zeros(CODES**2, np.int64)
    if automata:
        text = found.where("kind = 'text'").select(F.col("word").cast("long").alias("k"), "n").toPandas()
        counts[text["k"].to_numpy(np.int64)] = text["n"]
    return Model(automata, Ordinary(counts))


def spans(text: str, base: list[tuple[str, int, int]], model: Model) -> list[tuple[str, int, int]]:
    """base plus a format span for each candidate outside them that some format is ODDS likelier for than ordinary text."""
    out = list(base)

    def likely(s: int, e: int) -> bool:
        w = text[s:e]
        return e - s >= 12 and not w.isalpha() and any(map(str.isdigit, w)) and any(map(str.isalpha, w)) and all(e <= x or y <= s for _, x, y in base) and model.odds(w) >= ODDS

    if len(model):
        for m in CANDIDATE.finditer(text):
            s, e = m.span()
            ways = [[(s, e)]]
            if "." in m[0]:  # the run without dots around it, else the whole run, else what lies between the dots
                ways = [[(e - len(m[0].lstrip(".")), s + len(m[0].rstrip(".")))], *ways, [p.span() for p in PIECE.finditer(text, s, e)]]
            for way in ways:
                if found := [("format", *x) for x in way if likely(*x)]:
                    out += found
                    break
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def join(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Spans of every document (doc_id, text); null and empty texts have none.

    Repeated rows are scanned each, other columns are not looked at, an empty table gives no rows. Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans. Per row, without a shuffle.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                t = t if isinstance(t, str) else ""
                base = base_spans(t)
                n = Counter(k for k, _, _ in base)
                out.append((n["assign"], n["access"], n["hex"], hashlib.sha256(join(base).encode()).hexdigest(), join(spans(t, base, model))))
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])], axis=1)

    return docs.select("doc_id", "text").mapInPandas(read, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: Model, mask: str = "[SECRET]") -> DataFrame:
    """docs with each secret replaced by mask in text (for a named credential, the value alone), n_chars (if a column) set anew.

    Overlapping spans are replaced once. No document is dropped; null texts stay null.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if not isinstance(t, str) or not (found := spans(t, base_spans(t), model)):
                return t
            out, at = [], 0
            for kind, s, e in found:
                s = ASSIGN.match(t, s, e).start(2) if kind == "assign" else s
                if s >= at:
                    out += [t[at:s], mask]
                at = max(at, e)
            return "".join(out) + t[at:]

        return texts.map(one)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
