"""The pipeline's stages take effect, each on what the one before kept."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline as cp
from quillon.llm import simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    tokens = docs.selectExpr("sum(length)").first()[0]
    assert tokens == docs.where("start = 0").selectExpr("sum(doc_tokens)").first()[0]
    assert docs.where("start = 0").count() == before.count() == sizes[4]


@pytest.mark.parametrize("sets", [7, 512])
def test_near_duplicate_recall(spark, sets, monkeypatch):
    """Every planted pair with a five-word Jaccard similarity of 0.8 to 0.95 loses its later document, and none below 0.8 does."""
    monkeypatch.setattr(simhash, "SETS", sets)
    rnd = random.Random(4)
    new = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, gone, seen = [], set(), []
    for k in range(300):
        a = [new() for _ in range(300)]
        b = list(a)
        for at in rnd.sample(range(300), 2 + k % 8):
            b[at] = new()
        share = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        gone |= {2 * k + 1} if share >= 0.8 else set()
        seen.append(share)
    last = [new() for _ in range(120)]
    for k in range(600, 640):  # a chain, and one candidate group larger than a block of 7
        rows.append((k, " ".join(last)))
        gone |= {k} if k > 600 else set()
        last = [*last[:-1], new()] if k % 2 else [new(), *last[1:]]
    assert sum(0.8 <= x <= 0.95 for x in seen) > 150 and min(seen) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert {i for i, _ in rows} - kept == gone


def test_near_duplicates_keep_one_row(spark):
    """Clean rows without a doc_id stay; of repeated rows, and of copies under one doc_id, one stays."""
    long = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    rows = [(None, long[0]), (None, long[1]), (1, long[2]), (1, long[2]), (1, long[2] + " tail"), (None, long[3]), (7, long[3]), (2, long[4]), (2, long[5])]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r["text"].split()[0] for r in got) == [f"w{k}x0" for k in range(6)]
    assert {r["doc_id"] for r in got if r["text"] == long[3]} == {7}


@pytest.mark.parametrize("radius,words", [(4, 1), (7, 1), (52, 3), (65, 4)])
def test_bits_within_a_radius(radius, words):
    r = np.random.default_rng(3)
    x = np.packbits(r.random((500, 64 * words)) < radius / 64 / words, axis=1).view(np.uint64)
    near = simhash.within(iter(simhash.planes(x)), radius).view(np.uint8)
    want = np.bitwise_count(x).sum(axis=1) <= radius
    assert np.array_equal(np.unpackbits(near, bitorder="little")[:500].astype(bool), want) and 0 < want.sum() < 500


@pytest.mark.parametrize("rows", [1000, 200_000, 5_000_000])
@pytest.mark.parametrize("size,shared", [(9, 8), (45, 40), (450, 400)])
def test_simhash_candidates_at_least_similarity(rows, size, shared):
    """Of shingle sets at 0.8, all but some in 1,500 agree in a block of their SimHashes and differ by at most the radius; others differ by more."""
    bits, keys, radius = simhash.scheme(rows, 0.8)
    per, r, missed = 64 // bits, np.random.default_rng(7), 0
    words = max(simhash.COMPARED, -(-keys // per))
    for _ in range(400):
        x = r.integers(0, 1 << 64, 2 * size - shared, dtype=np.uint64)
        a, b = (simhash.simhashes(s, words).view(np.uint64) for s in (x[:size], x[size - shared :]))
        d = a ^ b
        met = any(int(d[t // per]) >> t % per * bits & ((1 << bits) - 1) == 0 for t in range(keys))
        missed += not met or np.bitwise_count(d[: simhash.COMPARED]).sum() > radius
        other = simhash.simhashes(r.integers(0, 1 << 64, size, dtype=np.uint64), words).view(np.uint64)
        assert np.bitwise_count((a ^ other)[: simhash.COMPARED]).sum() > radius
    assert missed <= 4


def test_near_duplicates_are_found_by_simhash(spark, monkeypatch):
    """The stage links what SimHash finds: without equal blocks of fingerprints nothing goes."""
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(60 + k))) for k in range(2)], "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 1
    signs = simhash.signatures
    apart = lambda d, k, words: signs(d, k, words).withColumn("words", simhash.F.transform("words", lambda w: simhash.F.xxhash64(w, "node")))
    monkeypatch.setattr(simhash, "signatures", apart)
    assert simhash.keep_one(docs).count() == 2
