"""The corpus operators against brute force, round trips and held-out accuracy, on small fixtures."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from quillon.llm import components, embeddings, htmltext, lm, mixing, packing, quality, secrets, simhash, suffixes, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars int, _row string, size string, h string"


def body(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Nulls, empty and long texts, repeated rows, near copies, shared passages, secrets."""
    rnd = random.Random(5)
    out = [None, "", " \n\t", "x", "One two three", "a" * 1500, "same line here again\n" * 30, body(rnd, 6000)]
    shared = body(rnd, 120)
    for k in range(40):
        out.append(f"{body(rnd, rnd.randint(3, 120))}\n{shared[: rnd.randint(0, len(shared))]} {body(rnd, 9)}")
    base = body(rnd, 80)
    out += [base, base, base + " tail", base.upper(), base.replace("é", "e", 1)]
    out += [f'password = "abc{k}DEF456xyz" AKIA{k:016d} {"0123456789abcdef" * 2}' for k in range(25)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 9 == 0 else "ab"[i % 2], None if i % 7 == 0 else f"s{i % 3}", i, "clash", "1", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND).repartition(5)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def components_of(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("op, sql", [(quality.op1, quality.SQL), (lm.op3, lm.SQL), (mixing.op10, mixing.SQL)])
def test_sql(spark, op, sql):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = op(spark, SF).toPandas(), con.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    pd.testing.assert_frame_equal(got[columns].sort_values("doc_id", ignore_index=True), want[columns].sort_values("doc_id", ignore_index=True), check_dtype=False, atol=1e-4)


def test_quality(docs, texts):
    m = quality.metrics(docs).selectExpr("_row.doc_id as doc_id", "*").drop("_row")
    for i, r in by_id(m).items():
        t = texts[i] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(twice) > 20 * len(w))
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and 40 <= kept.count() < len(texts) - 25  # the last 25 texts have under ten words


def test_fences_of_small_and_large_sources(spark):
    """A source of fewer than least_docs documents is judged by its language, one of as many by itself, on both sides of that number."""
    rows = [(k, " ".join(f"{'w' * (3 + k % 3)}{j}" for j in range(10, 30)), "en", "big") for k in range(50)]
    rows += [(100 + k, " ".join(f"{'x' * 40}{j}" for j in range(10, 30)), "en", "small") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    m = quality._keyed(quality.metrics(docs).where("true"))
    high = {n: {r["_source"]: r["hi_length"] for r in quality.fences(m, n).collect()} for n in (9, 10)}
    assert high[9]["=small"] > 40_000 > high[10]["=small"] and high[9]["=small"] != high[9].get("=big")


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><div class="nav"><ul><li><a href="/">Home</a></li></ul></div>
<div id="cookie-notice">We use cookies</div><div class="content"><h1>Head {0}</h1><p>First   &amp; {0} <b>bold</b>.</p><p>{1}</p></div>
<div class="comments"><p>Nice post</p></div><div class="sidebar"><p>Ad</p></div><script>var x = "<p>no</p>";</script><footer>Foot</footer></body></html>"""


def test_html(spark):
    rnd = random.Random(1)
    long = [body(rnd, 60) for _ in range(6)]
    rows = [(k, f"http://h.example/{k}", PAGE.format(k, long[k])) for k in range(6)] + [(6, None, None), (7, "http://x.example/", ""), (8, "http://y.example", "<article><p>Only &lt;this&gt;</p></article>")]
    got = by_id(htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    for k in range(6):
        assert got[k]["text"] == f"Head {k}\nFirst & {k} bold.\n{long[k]}"
        assert got[k]["n_chars"] == len(got[k]["text"])
    assert [got[k]["text"] for k in (6, 7, 8)] == ["", "", "Only <this>"]


def html_texts(spark, pages):
    rows = [(k, f"http://h.example/{k}", f"<html><body>{p}</body></html>") for k, p in enumerate(pages)]
    return [r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_html_optional_groups(spark):
    """What only one page of a host has is no boilerplate, and neither is what all articles of a host begin with."""
    rnd = random.Random(2)
    long = [body(rnd, 40) for _ in range(6)]
    extra = ["", "<h2>Only here</h2>", "<pre>code</pre>", "<ul><li>one item</li></ul>", "<table><tr><td>cell</td></tr></table>", ""]
    pages = [f'<div>Same line</div><section><div class="content"><h1>Same head</h1><p>{long[k]}</p>{extra[k]}</div></section><div>Same end</div>' for k in range(6)]
    assert html_texts(spark, pages) == ["\n".join(["Same head", long[k], *filter(None, [re.sub("<[^>]*>", "", extra[k])])]) for k in range(6)]


def shaped(rnd, shape):
    """A page of a site without telling tags or labels unless the shape is about them, and its article's lines."""
    t, n, lines = body(rnd, 5), rnd.randint(0, 999), [body(rnd, rnd.randint(20, 60)) for _ in range(rnd.randint(2, 5))]
    p, links = "".join(f"<p>{x}</p>" for x in lines), "".join(f'<li><a href="/{k}">{body(rnd, 2)}</a></li>' for k in range(5))
    menu, end = f"<div class=x1><ul>{links}</ul></div>", "<div class=x9>All rights kept by nobody at all</div>"
    ad = f"<div class=q>{body(rnd, 4)}</div>"
    return {
        "content": (f"{menu}{ad}<div class=c><h1>{t}</h1>{p}</div>{end}", [t, *lines]),
        "title beside": (f"{menu}<div class=h><h1>{t}</h1></div><div class=c>{p}</div>{ad}{end}", [t, *lines]),
        "own ids": (f"{menu}<div id=post-{n}><h2>{t}</h2>{p}</div>{end}", [t, *lines]),
        "words as ids": (f"{menu}<div id={t.replace(' ', '-')}>{p}</div>{end}", lines),
        "comments as articles": (f"<main><article><h1>{t}</h1>{p}<article class='comment'><p>{body(rnd, 9)}</p></article></article></main>", [t, *lines]),
        "comment list": (f"<div class=c><h1>{t}</h1>{p}</div><ol><li class=comment>{body(rnd, 9)}</li></ol>", [t, *lines]),
        "links inside": (f"{menu}<div class=c><h1>{t}</h1>{p}<ul><li><a href=/r>{t}</a></li></ul><p><a href=/s>See the reference list</a></p></div>{end}", [t, *lines, t, "See the reference list"]),
        "table": (f"<table><tr><td>{ad}</td></tr></table><table class=c><tr><td><h1>{t}</h1>{p}</td></tr></table>{end}", None),
        "two templates": ((f"{menu}<div class=news><h1>{t}</h1>{p}</div>{end}" if n % 2 else f"{menu}<section class=blog><h1>{t}</h1>{p}</section>{end}"), [t, *lines]),
        "form and notice": (f"<form>{ad}<label>Name</label></form><div class='cookie notice'>{t}</div><div class=c>{p}</div><aside>{t}</aside>", lines),
        "unclosed": (f"<ul><li><a href=/>a</a><li><a href=/b>b</a></ul><div class=c><h1>{t}{''.join('<p>' + x for x in lines)}</div><footer>x", [t, *lines]),
        "entities": (f"{menu}<div class=c><h1>{t} &amp; &eacute;&#33;</h1>{p.replace('<p>', '<p> &nbsp; ')}</div>{end}", [f"{t} & \u00e9!", *lines]),
        "deep": (f"{menu}{'<div>' * 1500}{p}{'</div>' * 1500}{end}", lines),
    }[shape]


SHAPES = ("content", "title beside", "own ids", "words as ids", "comments as articles", "comment list", "links inside", "two templates", "form and notice", "unclosed", "entities", "deep")


def test_html_shapes(spark):
    """Twelve page shapes, a host each; repeated rows, null ids and clashing columns; pages that are moved to their rules and not."""
    rnd = random.Random(9)
    rows, want = [], {}
    for s, shape in enumerate(SHAPES):
        for k in range(20):
            page, lines = shaped(rnd, shape)
            rows.append((100 * s + k, f"http://h{s}.example/{k}", f"<html><head><title>T</title></head><body>{page}</body></html>", "host", 1, "rule"))
            want[100 * s + k] = "\n".join(lines)
    rows += [(None, *rows[0][1:]), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, part int, rule string").repartition(3)
    for broadcast in (htmltext.BROADCAST, 0):
        got = htmltext.extract(df, broadcast).collect()
        wrong = {SHAPES[(r["page_id"] or 0) // 100] for r in got if r["text"] != want[r["page_id"] or 0]}
        assert len(got) == len(rows) and not wrong


def wrapper_of(pages):
    w = None
    for page in pages:
        old = w.kept if w else None
        x = htmltext.Wrapper(1, htmltext.stream(htmltext.parse(page, old)), old)
        w = x.shrink() if w is None else w.add(x)
    return htmltext.Wrapper.load(w.dump())


def test_html_wrapper_stays_small(monkeypatch):
    """Labels of each page's own do not let a wrapper grow, and lose no text."""
    monkeypatch.setattr(htmltext, "GROUPS", 60)
    monkeypatch.setattr(htmltext, "LABELS", 6)
    rnd = random.Random(6)
    new = lambda: "".join(rnd.choice("abcdefgh") for _ in range(8))
    pages = []
    for _ in range(80):
        t, lines = body(rnd, 4), [body(rnd, 20) for _ in range(4)]
        menu = "".join(f"<div id={new()}><a href=/>{body(rnd, 2)}</a></div>" for _ in range(5))
        pages.append((f"<div class=menu-x>{menu}</div><div class=c><h1>{t}</h1>{''.join(f'<section id={new()}><p>{x}</p></section>' for x in lines)}</div><div class=end>The same end</div>", [t, *lines]))
    w = wrapper_of(p for p, _ in pages)
    assert w.kept is not None and htmltext.size(w.groups) <= 60
    r = htmltext.Rule(htmltext.rule(w))
    assert all(htmltext.main_text(page, r) == "\n".join(lines) for page, lines in pages)


def test_html_wrapper_decides():
    """Without the host's rule, varying boilerplate without telling tags or labels stays in the text."""
    rnd = random.Random(4)
    pages = [shaped(rnd, "content") for _ in range(12)]
    w = wrapper_of(p for p, _ in pages)
    r = htmltext.Rule(htmltext.rule(w))
    e = htmltext.expression(w.groups)
    assert '<h1>#<' in e and "<div.x9>'" in e  # a slot, and a text that never varies
    assert all(htmltext.main_text(page, r) == "\n".join(lines) for page, lines in pages)
    assert not any(htmltext.main_text(page, None) == "\n".join(lines) for page, lines in pages)


def test_html_sibling_holders(spark):
    """An article in several holders stays whole, with paragraphs that are mostly a link; a holder of links goes."""
    rnd = random.Random(3)
    t = [[body(rnd, n) for n in (4, 20, 50, 30, 6)] for _ in range(5)]
    assert html_texts(spark, [f'<div class="x"><a href="/">{t[0][0]}</a></div><p>{t[0][1]}</p>']) == [t[0][1]]
    pages = [f'<div class="title"><h1>{a}</h1></div><div class="lead"><p>{b}</p></div><div class="content"><p>{c}</p><ul><li>{d}</li><li>{d} {e}</li></ul><p><a href="/">{e}</a>.</p></div><div class="more"><p><a href="/x">{e} {a}</a></p></div>' for a, b, c, d, e in t]
    assert html_texts(spark, pages) == ["\n".join([a, b, c, d, f"{d} {e}", f"{e}."]) for a, b, c, d, e in t]


def backoff_score(w, c, total):
    s = 0.0
    for at in range(len(w)):
        f = 1.0
        for k in range(min(at, 2), -1, -1):
            g = tuple(w[at - k : at + 1])
            if c[g]:
                s += np.log(f * c[g] / (c[g[:-1]] if k else total))
                break
            f *= 0.4
    return s


def ngram_counts(low):
    return collections.Counter(tuple(w[i : i + k]) for w in low for k in (1, 2, 3) for i in range(len(w) - k + 1)), sum(map(len, low))


def lower_words(texts):
    return [[w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for t in texts]


def test_lm(docs, texts, monkeypatch):
    monkeypatch.setattr(lm, "RANGE", 20_000)
    got, low = by_id(lm.scores(docs)), lower_words(texts)
    c, total = ngram_counts(low)
    for i, w in enumerate(low):
        assert got[i]["n_words"] == len(w) and abs(got[i]["log_score"] - backoff_score(w, c, total)) < 1e-3
        assert (got[i]["mean_log_score"] is None) == (not w)
    table = collections.Counter(r["c"] for r in lm.counts(docs).collect())
    assert table == collections.Counter(c.values()) + collections.Counter([total])


def test_lm_of_another_corpus(spark, docs, texts):
    """Texts that the corpus lacks n-grams and words of back off; null ids, repeated rows and clashing columns stay what they are."""
    low = lower_words(texts)
    c, total = ngram_counts(low)
    new = [" ".join(w[:40][::-1]) + " unseen word " + " ".join(w[5:9]) for w in low if len(w) > 20] + [None, "", "unseen"]
    rows = [(None if i % 5 == 0 else i, t, "h", 1, 2) for i, t in enumerate(new)] * 2
    got = lm.scores(spark.createDataFrame(rows, "doc_id long, text string, h string, block int, n int"), corpus=docs).collect()
    order = lambda x: (str(x[0]), x[1], x[2])
    want = sorted(((i, len(w), float(backoff_score(w, c, total))) for (i, *_), w in zip(rows, lower_words([t for _, t, *_ in rows]))), key=order)
    got = sorted(((r["doc_id"], r["n_words"], r["log_score"]) for r in got), key=order)
    assert len(got) == len(want) and all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-3 for x, y in zip(got, want))


def test_embeddings(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(20, 16))
    v = [base[k % 20] + rnd.normal(size=16) * rnd.choice([0, 0.05, 0.3]) for k in range(300)]
    rows = [(i, x.tolist(), None if i % 11 == 0 else i % 3) for i, x in enumerate(v)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, [], 1), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [1e300] * 16, 2), (308, [1.0] * 16, 2)]
    got = by_id(embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id")
    ok = {i: np.array(x) / np.abs(x).max() for i, x, l in rows if l is not None and x and None not in x and np.isfinite(x).all() and np.any(x)}
    label = {i: l for i, _, l in rows}
    unit = {i: x / np.sqrt(x @ x) for i, x in ok.items()}
    links = [(i, j) for i in unit for j in unit if i < j and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    n, comp = collections.Counter(x for l in links for x in l), components_of(309, links)
    assert links and all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], comp[i], comp[i] == i) for i in range(309))


def test_embeddings_across_leaves(spark):
    """Chains of 400 vectors of one label, links across leaves and intervals included."""
    rnd = np.random.default_rng(6)
    ids = rnd.permutation(1600).tolist()
    angle = np.arange(400) * 0.11  # a link spans 0.2 radians
    rows = []
    for c in range(4):
        for k, a in enumerate(angle % 6.0):
            v = np.zeros(8)
            v[2 * c : 2 * c + 2] = np.cos(a), np.sin(a)
            rows.append((ids[400 * c + k], v.tolist(), 1))
    unit = np.array([v for _, v, _ in sorted(rows)])
    links = np.argwhere(np.triu(unit @ unit.T >= 0.98, 1)).tolist()
    got = by_id(embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id")
    n, comp = collections.Counter(x for l in links for x in l), components_of(1600, links)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], comp[i], comp[i] == i) for i in range(1600))


def test_embedding_leaves_keep_links(monkeypatch):
    """Roots of an interval pair connect what its links connect, though a later leaf lowers a root that an earlier one gave."""
    monkeypatch.setattr(embeddings, "LEAF", 1)
    unit = np.array([[np.cos(a), np.sin(a)] for a in (0.0, 0.15, -0.15)])
    for ids in ([10, 5, 3], [10, 3, 5], [3, 10, 5], [5, 3, 10], [5, 10, 3], [3, 5, 10]):
        x = (np.array(ids), np.ones(3, np.int64), unit, unit)
        _, _, root, _ = embeddings.join_intervals(x, x, 0.2 * (1 + 1e-9), 0.98, True)
        assert root.tolist() == [3, 3, 3]


@pytest.mark.parametrize("group", [2000, 3])
def test_suffixes(docs, texts, group, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", group)
    L, raw = suffixes.LENGTH, [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + L] for t in raw for i in range(len(t) - L + 1))
    got, removed = by_id(suffixes.without_repeats(docs)), 0
    for i, t in enumerate(raw):
        gone = bytearray(len(t))
        for s in range(len(t) - L + 1):
            if seen[t[s : s + L]] > 1:
                gone[s : s + L] = b"\1" * L
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        removed += sum(gone)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    assert removed


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(packing.pieces(docs, with_ids=True)).toPandas()
    for i, g in got.sort_values("start").groupby("doc_id"):
        ids = tok.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        assert [x for p in g["ids"] for x in p] == ids and (g["doc_tokens"] == len(ids)).all()
        assert g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(g["ids"], g["ids_crc32"]))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 1024
    assert set(got["doc_id"]) == set(range(len(texts)))
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 1024) + 2


def test_packing_cuts_at_boundaries(spark):
    """Documents of some 660 tokens fill sequences in threes of which one is cut; both parts bear their own checksums."""
    text = "a b c d e f g h i j " * 66
    docs = spark.createDataFrame([(k, text[: len(text) - 2 * (k % 4)]) for k in range(60)], "doc_id long, text string")
    got = packing.pack(packing.pieces(docs, with_ids=True)).toPandas()
    pieces = got.groupby("doc_id").size()
    assert pieces.max() == 2 and 10 <= (pieces == 2).sum() <= 25
    assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c and len(p) == n for p, c, n in zip(got["ids"], got["ids_crc32"], got["length"]))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= 1.05 * got["length"].sum() / 1024 + 1


def test_cutting_stock():
    """Patterns meet the demand, fit their sequences and cost little more than the least that the lengths allow."""
    rnd = np.random.default_rng(5)
    for demand in (rnd.integers(0, 40, 63), np.zeros(63, int), np.r_[np.zeros(40, int), 300, np.zeros(22, int)], np.r_[1, np.zeros(61, int), 1]):
        out = packing.cutting_stock(demand)
        assert (sum((t * c for t, _, c in out), np.zeros(63, int)) == demand).all()
        weight = np.arange(1, 64)
        assert all(c @ weight <= 64 * k for _, k, c in out)
        if 500 < demand.sum() and demand.max() < 100:
            assert sum(t * k for t, k, _ in out) <= 1.02 * (demand @ weight) / 64 + 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op7(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    p, n = got[got["toxic"] == 1]["score"].to_numpy(), got[got["toxic"] == 0]["score"].to_numpy()
    assert got["score"].between(0, 1).all() and len(p) and len(n)
    assert ((p[:, None] > n[None]) + 0.5 * (p[:, None] == n[None])).mean() > 0.9


def fingerprint(text, k=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in ([w[i : i + k] for i in range(len(w) - k + 1)] if len(w) >= k else [w] if w else [])]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def test_simhash(docs, texts):
    got, f = by_id(simhash.near_duplicates(docs)), [fingerprint(t) for t in texts]
    comp = components_of(len(f), [(i, j) for j in range(len(f)) for i in range(j) if (f[i] ^ f[j]).bit_count() <= 4])
    assert all((got[i]["fp"] % 2**64, got[i]["component_id"]) == (f[i], comp[i]) for i in range(len(f)))
    assert simhash.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("block", [40, 2048])
def test_simhash_long_runs(spark, block, monkeypatch):
    """Many fingerprints of one key, near and not: runs that are compared bit-sliced, and those dealt out as pairs of blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(2)
    f = list({sum(1 << b for b in rnd.sample(range(20), rnd.randint(0, 9))) | (rnd.getrandbits(6) << 20) for _ in range(500)})
    df = spark.createDataFrame([(x, i) for i, x in enumerate(f)], "fp long, id long")
    got = {r["id"]: r["component"] for r in components.connected_components(simhash.near_links(df)).collect()}
    comp = components_of(len(f), [(i, j) for j in range(len(f)) for i in range(j) if (f[i] ^ f[j]).bit_count() <= 4])
    assert [got.get(i, i) for i in range(len(f))] == comp


def test_secrets(docs, texts):
    models = secrets.train(docs)
    assert len(models)
    got = by_id(secrets.scan(docs, models))
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, models).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(texts):
        t = t or ""
        found = [("assign", 0, m) for m in assign.finditer(t) if len(m[2]) >= 12] + [("access", 1, m) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [("hex", 2, m) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        base = [f"{k}:{m.start()}:{m.end()}" for k, o, m in sorted(found, key=lambda x: (x[2].start(), x[1]))]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(k == x[0] for x in found) for k in ("assign", "access", "hex")]
        assert not found or "DEF456xyz" not in clean[i]


@pytest.mark.parametrize("shape", ["short", "dotted", "long"])
def test_secrets_bare_copies(spark, shape):
    """Bare copies of labelled credentials are found, also short ones, dotted ones, and ones with a sign past character 64."""
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abcxyzABCXYZ0123456789") for _ in range(n - 2)) + "a7"
    new = {"short": lambda: word(13), "dotted": lambda: f"{word(7)}.{word(7)}.{word(7)}", "long": lambda: word(86) + "=="}[shape]
    known = [new() for _ in range(60)]
    rows = [(k, f"password: {w}") for k, w in enumerate(known)] + [(100 + k, f"see {w} and {w}. More text") for k, w in enumerate(known[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = secrets.train(docs)
    assert len(models)
    n = len(known[0])
    got = by_id(secrets.scan(docs, models))
    assert all(got[100 + k]["spans"] == f"format:4:{4 + n},format:{9 + n}:{9 + 2 * n}" for k in range(20))
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, models).collect()}
    assert all(clean[100 + k] == "see [SECRET] and [SECRET]. More text" for k in range(20))


def test_secrets_new_credentials(spark):
    """Credentials without a name, of formats that named ones teach, are found and ordinary words with digits are not: recall and precision of what is added."""
    rnd = random.Random(8)
    r = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    an = low + low.upper() + digits
    formats = (lambda: "sk_live_" + r(an, 24), lambda: "ghp_" + r(an, 36), lambda: f"xoxb-{r(digits, 11)}-{r(an, 24)}", lambda: r(an + "+/", 38) + "==", lambda: "AIza" + r(an + "_-", 35), lambda: r(low + digits, 14))
    w = lambda: "".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 5)))
    n = lambda k: rnd.randint(1, k)
    plain = (lambda: f"{w()}{n(99)}.{w()}.com", lambda: f"2024-{n(12):02d}-{n(28):02d}T{n(23):02d}", lambda: f"{w()}-{w()}-{n(2024)}", lambda: f"/{w()}/{n(999)}/{w()}.html", lambda: f"{w().title()}{w().title()}{n(999)}{w()}", lambda: f"v{n(9)}.{n(30)}.{n(99)}-beta{n(9)}", lambda: f"user{n(9999)}_{w()}")
    rows = [(k, f"the {w()} token = {formats[k % 6]()} of {w()} {w()}") for k in range(300)]
    want = {}
    for k in range(1000, 2000):
        secret = formats[k % 6]() if k % 5 == 0 else None
        text = " ".join([w() for _ in range(9)] + [plain[k % 7]()] + [w() for _ in range(9)])
        rows.append((k, f"{text} {secret or ''}"))
        want[k] = [f"format:{len(text) + 1}:{len(text) + 1 + len(secret)}"] if secret else []
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {i: [x for x in r["spans"].split(",") if x.startswith("format")] for i, r in by_id(secrets.scan(docs, secrets.train(docs))).items()}
    right = sum(x in got[k] for k, v in want.items() for x in v)
    assert right >= 0.97 * sum(map(len, want.values())) and right >= 0.97 * sum(map(len, got.values()))


def test_mixing(docs, texts):
    got = pd.DataFrame([r.asDict() for r in mixing.curriculum(docs).collect()])
    size = np.array([len(WORD.findall(t or "")) for t in texts])
    assert (got.set_index("doc_id")["size"].sort_index().to_numpy() == size).all()
    got["taken"] = got["taken_each"].map(sum)
    assert (got["taken"] <= 3 * got["size"]).all()
    per = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert abs(per["target"].sum() - size.sum()) < 1e-6 and (per["target"] - per["taken"]).between(0, 1).all()
    again = pd.DataFrame([r.asDict() for r in mixing.curriculum(docs.repartition(3)).collect()])
    assert sorted(map(str, got.drop(columns="taken").to_dict("records"))) == sorted(map(str, again.to_dict("records")))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in mixed.collect()) == got["taken"].sum()


@pytest.mark.parametrize("op", ["quality", "lm", "suffixes", "packing", "simhash", "secrets", "mixing", "toxicity", "html", "embeddings"])
def test_empty_tables(spark, docs, op):
    none = docs.where("false")
    out = {
        "quality": lambda: quality.quality_filter(none), "lm": lambda: lm.scores(none), "suffixes": lambda: suffixes.without_repeats(none),
        "packing": lambda: packing.pack(packing.pieces(none)), "simhash": lambda: simhash.keep_one(none), "secrets": lambda: secrets.scan(none, secrets.train(none)), "mixing": lambda: mixing.mixed_documents(none),
        "toxicity": lambda: toxicity.toxicity(none, *toxicity.teach(none, spark.createDataFrame([], "doc_id long, toxic int"))),
        "html": lambda: htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")),
        "embeddings": lambda: embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    }[op]()
    assert out.count() == 0


def test_suffixes_write_little_of_what_occurs_once(spark):
    """Texts that repeat nothing leave checkpoints of less than half their bytes."""
    folder, rnd = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir"), random.Random(9)
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder.removeprefix("file:")) for f in names)
    rows = [(k, "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=20_000))) for k in range(100)]
    before = size()
    got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["n_bytes"], r["n_removed"]) for r in got} == {(20_000, 0)} and len(got) == 100
    assert 0 < size() - before < 1_000_000


def test_suffixes_keep_groups_in_one_task(spark):
    """Pairs that differ in one byte lose what is left and right of it, however Spark runs the joins before the sort."""
    rnd, rows = random.Random(10), []
    for k in range(400):
        t = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=1000))
        rows += [(k, t[:500] + "A" + t[500:]), (1000 + k, t[:500] + "B" + t[500:])]
    rnd.shuffle(rows)
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # as tables of many partitions are
    spark.conf.set(key, "false")
    try:
        got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    finally:
        spark.conf.unset(key)
    assert collections.Counter((r["n_removed"], r["n_spans"]) for r in got) == {(1000, 2): 800}
