"""Repeated rows, null ids, nulls in every column and clashing column names: one defined result each, for all ten operators and the pipeline."""

import collections

import pytest

import corpus_pipeline as cp
from quillon.llm import embeddings, htmltext, lm, mixing, packing, quality, secrets, simhash, suffixes, toxicity

#: Names that the operators use inside, and a few more.
CLASH = ("_text", "_row", "_key", "row", "h", "n", "word", "block", "component", "kept", "size", "label", "host", "_hash")
#: What an operator returns for a row depends on all rows, but is the same for equal ones.
OPS = {
    "quality": lambda d: quality.judged(m := quality._keyed(quality.metrics(d)), quality.fences(m)).selectExpr("_row.doc_id as doc_id", "n_words", "kept"),
    "lm": lm.scores,
    "suffixes": suffixes.without_repeats,
    "simhash": lambda d: simhash.near_duplicates(d),
    "secrets": lambda d: secrets.scan(d, secrets.train(d)),
    "toxicity": lambda d: toxicity.toxicity(d, *toxicity.teach(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))),
}


@pytest.fixture(scope="module")
def docs(spark):
    words = " ".join(f"word{k} and" for k in range(60))
    texts = [None, "", " \n", "short one", words, f"{words} with a tail", f"password = \"abc{1}DEF456xyz\" {words[::-1]}", "x" * 30_000]
    rows = [(None if k == 3 else k, t, "en" if k % 2 else None, None if k % 3 == 0 else f"s{k % 2}", len(t or ""), *CLASH) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], rows[3], (None, None, None, None, None, *[None] * len(CLASH))]
    kinds = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame(rows, kinds).repartition(4)


@pytest.mark.parametrize("op", sorted(OPS))
def test_a_result_for_each_row(docs, op):
    got, want = OPS[op](docs).collect(), collections.Counter(r["doc_id"] for r in docs.collect())
    assert collections.Counter(r["doc_id"] for r in got) == want
    assert len({repr(r) for r in got if r["doc_id"] == 4}) == 1


def test_packing_takes_each_row(docs):
    got, n = packing.pack(packing.pieces(docs)).collect(), docs.count()
    assert sum(r["start"] == 0 for r in got) == n
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
    assert sum(r["start"] == 0 for r in got if r["doc_id"] == 4) == 3


def test_mixing_takes_each_row(docs):
    got = mixing.curriculum(docs).collect()
    assert len(got) == docs.count() and sum(r["doc_id"] == 4 for r in got) == 3
    assert mixing.mixed_documents(docs).columns == docs.columns
    ties = mixing.schedule(mixing.curriculum(docs)).collect()
    assert [r["position"] for r in ties] == sorted(r["position"] for r in ties)


def test_pages_and_vectors(spark):
    page = "<body><div class=c><h1>Head</h1><p>One &amp; two</p></div></body>"
    rows = [(1, "http://a.example/1", page, "x", "y"), (1, "http://a.example/1", page, "x", "y"), (None, None, None, None, None), (2, "http://a.example/2", "", "x", "y"), (3, "", "<p>" + "long " * 200_000 + "</p>", "x", "y")]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string")).collect()
    assert sorted((str(r["page_id"]), r["text"][:14], r["n_chars"]) for r in got) == [("1", "Head\nOne & two", 14), ("1", "Head\nOne & two", 14), ("2", "", 0), ("3", "long long long", 999_999), ("None", "", 0)]
    v = [0.5, 1.0]
    rows = [(1, v, 1, "x", "y"), (1, v, 1, "x", "y"), (2, v, 1, "x", "y"), (3, v, None, "x", "y"), (None, v, 1, "x", "y"), (None, None, None, None, None)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, grp string, n string")).collect()
    assert len(got) == len(rows) and {(r["n_links"], r["component_id"]) for r in got if r["vec_id"] in (1, 2)} == {(2, 1)}


def test_pipeline_stages(spark, docs):
    """Contents after each stage; clean documents stay, copies go but one, secrets are masked, all tokens are packed."""
    kept = cp.keep_quality(spark, docs, "")
    assert collections.Counter(r["doc_id"] for r in kept.collect())[4] in (0, 3) and kept.columns == docs.columns
    one = cp.drop_near_duplicates(spark, docs, "").collect()
    assert sum((r["text"] or "").startswith("word0 and") for r in one) == 1
    assert {r["text"] for r in one} >= {"short one", "x" * 30_000} and sum(not (r["text"] or "").split() for r in one) == 1  # texts without words are copies
    clean = cp.mask_secrets(spark, docs, "").collect()
    assert len(clean) == docs.count() and not any("DEF456xyz" in (r["text"] or "") for r in clean)
    mixed = cp.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns and mixed.count()
    assert cp.pack_sequences(spark, docs, "").where("start = 0").count() == docs.count()
    none = docs.where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, none, "").count() == 0
