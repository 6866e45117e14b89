"""Operators against SQL and plain versions, and on the hard cases that the other tests lack."""

import math
import random
import re
import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftspark.llm import decontaminate, embedding_dedup, html_extract, language_id, line_dedup, minhash_docs, oracles, registry, storage, toxicity
from tests.test_oracles import values

from .conftest import DATA

SMALL = DATA.replace("sf0.01", "sf0.001")


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.sql(oracles.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


# op1

LONG = "".join(f"<p>Some long paragraph of running text without any links in it at all, number {k}.</p>" for k in range(5))
PLAIN = " ".join(re.findall(r"<p>(.*?)</p>", LONG))


@pytest.mark.parametrize("names", ['class="content no-sidebar"', 'class="has-header"', 'id="post-with-comments"', 'class="main header"', 'id="comments"'])
def test_op1_names_of_what_holds_the_text(names):
    assert html_extract.main_text(f"<body><div {names}>{LONG}</div><footer>x</footer></body>") == PLAIN


def test_op1_without_article_or_main():
    links = "".join(f'<li><a href="/{k}">w{k}</a></li>' for k in range(12))
    page = f'<body><ul>{links}</ul><div><h1>Title</h1><ul><li>one item</li></ul>{LONG}<p>Tail.</p><p class="ad-hoc">An ad hoc remark.</p></div><div class="ad-banner">Buy now</div><div class="comments">{LONG}</div><ul>{links}</ul></body>'
    assert html_extract.main_text(page) == f"Title one item {PLAIN} Tail. An ad hoc remark."
    assert PLAIN in html_extract.main_text(f"<main><p>Short.</p></main><div>{LONG}</div>")


def test_op1_ratios_decide(monkeypatch):
    """Many tags around little text aren't content; with all ratios alike they would be."""
    page = f"<body><div>{LONG}</div><div>{'<span>q</span>' * 9}</div><div>{'<span>z</span>' * 9}</div><div>{'<span>y</span>' * 9}</div></body>"
    assert html_extract.main_text(page) == PLAIN
    monkeypatch.setattr(html_extract, "smoothed", lambda x, sigma=1: np.ones(len(x)))
    monkeypatch.setattr(html_extract, "_clusters", lambda lines, sigma: (np.ones(len(lines), bool), np.ones(len(lines), bool)))
    assert html_extract.main_text(page) != PLAIN


def test_op1_deep_and_long_pages():
    began = time.time()
    assert html_extract.main_text("<div>" * 20_000 + "deep text" + "</p>" * 20_000) == "deep text"
    assert len(html_extract.main_text("<div><p>x y z text" * 20_000)) > 200_000
    assert len(html_extract.main_text("<p>" + "word " * 200_000)) == 999_999
    assert time.time() - began < 20


# op2, op5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abé ", max_size=14), st.text(alphabet="abé ", max_size=14)), max_size=12), st.integers(40, 100))
def test_similar_lines(pairs, percent):
    def plain(x, y):
        a, b = ({t[i : i + line_dedup.SHINGLE] for i in range(len(t) - line_dedup.SHINGLE + 1)} for t in (x, y))
        return bool(a & b) and 100 * len(a & b) >= percent * len(a | b)

    pairs += [(x, x) for x, _ in pairs]
    assert line_dedup.similar([x for x, _ in pairs], [y for _, y in pairs], percent).tolist() == [plain(x, y) for x, y in pairs]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 9), min_size=1), min_size=2, max_size=12))
def test_linked_sets(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    n = len(sets)
    label = minhash_docs.linked(arrays, np.arange(n), np.arange(n), 80)
    want = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    want[i] = want[j] = min(want[i], want[j])
    assert label.tolist() == want


def test_shared_bands_in_long_runs(spark, monkeypatch):
    """Runs of one band that go out in parts give every line."""
    monkeypatch.setattr(line_dedup, "_LONG_RUN", 5)
    rows = [(k % 3, k) for k in range(60)] + [(9, 1), (10, 2), (10, 2), (11, 3), (11, 4)]
    got = {(r.key, r.line) for r in line_dedup._shared(spark.createDataFrame(rows, "key long, line long")).collect()}
    assert got == {(k, x) for k, x in rows if k not in (9, 10)}


def test_op2_hot_lines(spark):
    rows = [(k, f"the very same line in every document\nline of document {k} alone {k * 7919}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = line_dedup.removed_lines(docs, hot_line=3).collect()
    assert sorted(r.doc_id for r in got if 0 in r.removed) == list(range(1, 200))


# op3


def test_op3_short_texts_and_no_signal():
    rng = random.Random(1)
    words = "ab cd ef gh ij kl mn op qr st".split()
    ordinary = [" ".join(rng.choice(words) + rng.choice("xyz") for _ in range(30)) for _ in range(200)]
    model = toxicity.fit([(x, 0) for x in ordinary] + [(f"you are awful scum {k}", 1) for k in range(30)])
    assert model.score("you are awful scum 99") > 0.5 > max(model.score(x) for x in (*ordinary, "", None, "fine words here"))
    share = toxicity.fit([(x, int(k % 4 == 0)) for k, x in enumerate(ordinary)])
    assert {share.score(x) for x in (*ordinary, "", None)} == {0.25}


def test_op3_score_by_hand():
    """The score from plain compressed lengths of each window."""
    model = toxicity.fit([(f"quite ordinary words number {k} stand here", 0) for k in range(80)] + [(f"idiot moron number {k} stands here", 1) for k in range(40)])
    text = "Some idiot  wrote quite ordinary words here, and a moron read them"
    plain, toxic = (toxicity._compressor(x, model.level) for x in (model.ordinary, model.toxic + model.ordinary))
    saved = sorted(len(plain.compress(toxicity.ANCHOR + w)) - len(toxic.compress(toxicity.ANCHOR + w)) for w in toxicity.windows(" ".join(text.lower().split()).encode()))
    features = (max(saved[-1], 0), max(sum(saved[-3:]) / 3, 0), math.sqrt(sum(s >= 2 for s in saved) / len(saved)))
    z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], features, strict=True))
    assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)))


# op6


@pytest.mark.parametrize("dim", [64, 128])
def test_op6_recall(spark, dim):
    """Pairs at a cosine of 0.98 to 0.99, one label."""
    rng = np.random.default_rng(dim)
    rows, pairs = [], []
    for cosine in np.repeat([0.9801, 0.985, 0.99], 100):
        a, b = rng.normal(size=(2, dim))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), a.tolist(), 0), (len(rows) + 1, (cosine * a + math.sqrt(1 - cosine**2) * b / np.linalg.norm(b)).tolist(), 0)]
    got = {r.vec_id: r.component_id for r in embedding_dedup.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


# op8


def test_op8_spans_are_judged_once(spark):
    text = " ".join(f"w{k}" for k in range(35))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20))), (2, " ".join(f"w{k}" for k in range(25, 30))), (3, "w20 w21 w22 w23 w24 w30 w31")], "item_id long, text string")
    for block in (1 << 20, 20, 1):
        got = {r.doc_id: r.text for r in decontaminate.decontaminated(docs, bench, block_chars=block).collect()}
        assert got == {1: "w20 w21 w22 w23 w24 w30 w31 w32 w33 w34", 2: None, 3: ""}


# op9


def test_op9_by_hand(spark):
    """The posterior from plain sums: text, declaration and host."""
    docs = [(k, "the cat and the dog sat there" if k % 2 else "der hund und die katze saßen da", "en" if k % 2 else "de", f"src{k % 2}") for k in range(40)]
    docs += [(100, "der hund und the cat", "de", "src1"), (101, "12 34", "en", "src1"), (102, None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    model = language_id.fit(language_id.sample(df, language_id.declared_language(df.lang)))
    names, said = ["de", "en", "und"], {"de": 0, "en": 1}
    texts = []
    for _, t, _, _ in docs:
        raw = (t or "").encode()
        mean, n = model.likelihoods(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        e = [*(language_id.TEMPER * n[0] * mean[0]), language_id.TEMPER * n[0] * model.und]
        texts.append((e, int(np.argmax(e)) if n[0] else 2, n[0]))
    table = np.zeros((3, 3))
    for (_, _, lang, _), (_, best, _) in zip(docs, texts, strict=True):
        if lang:
            table[best, said[lang]] += 1
    total = table.sum(0) + 1e-9
    table = table + language_id.TABLE_WEIGHT * total / total.sum()
    table = np.log(table / table.sum(1, keepdims=True))
    known = [best for _, best, _ in texts if best < 2]
    everywhere = [(known.count(k) + 1) / (len(known) + 2) for k in range(2)]
    domain = [sum(b == k for (_, _, _, s), (_, b, _) in zip(docs, texts, strict=True) if s) for k in range(2)]
    domain = [(domain[k] + language_id.DOMAIN_WEIGHT * everywhere[k]) / (sum(domain) + language_id.DOMAIN_WEIGHT) for k in range(2)]
    got = {r.doc_id: r for r in language_id.identified(df).collect()}
    for (d, _, lang, source), (e, _, n) in zip(docs, texts, strict=True):
        hits = [sum(b == k for (_, _, _, s), (_, b, _) in zip(docs, texts, strict=True) if s == source) for k in range(2)]
        prior = [(hits[k] + language_id.HOST_WEIGHT * domain[k]) / (sum(hits) + language_id.HOST_WEIGHT) for k in range(2)] if source else everywhere
        e = [x + (table[k, said[lang]] if lang else 0) + math.log(language_id.UND_PRIOR if k == 2 else prior[k] * (1 - language_id.UND_PRIOR)) for k, x in enumerate(e)]
        best = int(np.argmax(e)) if n else 2
        assert got[d].lang == names[best]
        if n:
            assert got[d].posterior == pytest.approx(math.exp(max(e)) / sum(map(math.exp, e)), rel=1e-3)
    assert not got[101].accepted and not got[102].accepted


def test_op9_repeated_pages(spark):
    html = '<html lang="{}"><body><p>the cat and the dog sat there for a long time</p></body></html>'
    pages = spark.createDataFrame([(1, "http://a.example/x", html.format("en")), (1, "http://a.example/x", html.format("de")), (2, None, None)], "page_id long, url string, html string")
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    assert sorted(r.page_id for r in language_id.identified_pages(pages, docs).collect()) == [1, 1, 2]


# the pipeline


def test_pipeline_hard_cases(spark):
    """Nulls, empty texts, repeated rows, an empty table, and columns whose names clash with the operators' own."""
    import corpus_pipeline

    text = "A plain line of English words that stands in this document.\nAnd one more of them for the day."
    rows = [(1, text, "en", "src1", 95), (1, text, "en", "src1", 95), (2, None, "en", "src1", 0), (3, "", None, None, None), (None, "Nobody has an id here, but the words are English.", "en", "src2", 48), (4, text.replace("plain", "simple"), "en", "src1", 96)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["component", "kept", "spans", "removed", "line", "row", "text_key", "key", "node", "rep", "ids", "evidence", "declared"]
    for c in extra:
        docs = docs.selectExpr("*", f"'{c}' as {c}")
    for frame in (docs, docs.filter("false")):
        at, many = frame, frame.count()
        for name, stage in corpus_pipeline.STAGES:
            out = storage.stored(stage(spark, at, SMALL), name)
            assert out.count() <= at.count() and (name == "bpe_encoding" or out.columns == docs.columns)
            at = out
        assert (at.count() > 0) == (many > 0)
