"""Mixing, phrase mining and ranked search against plain Python on small corpora with the hard cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from siftspark.llm import lexical_search, mixing, phrases, textscan

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# op11


def plain_targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, open_ = {}, set(order)
    while open_:
        left = sum(sizes.values()) - sum(out.values())
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in open_)) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            return out | share
        out |= {s: Fraction(most * sizes[s]) for s in full}
        open_ -= full
    return out


def plain_mix(rows: list[tuple]) -> list[tuple]:
    """(doc_id, size, source_size, target, taken) of rows (doc_id, text, source)."""
    size = [len(WORDS.findall(t or "")) for _, t, _ in rows]
    sizes = Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        sizes[s] += n
    wanted = plain_targets(dict(sizes))
    out = []
    for s in sizes:
        rate = float(wanted[s]) / sizes[s] if sizes[s] else 0.0
        own = [(d, n) for (d, _, x), n in zip(rows, size, strict=True) if x == s]

        def draw(d, k):
            return int(hashlib.sha256(("" if d is None else str(d)).encode()).hexdigest()[8 * k : 8 * k + 8], 16) / 2**32

        def taken(k, own=own, rate=rate, draw=draw):
            return [n * (math.floor(rate) + (draw(d, k) < rate - math.floor(rate))) for d, n in own]

        best = min(range(8), key=lambda k: (abs(sum(taken(k)) - float(wanted[s])), k))
        out += [(d, n, sizes[s], float(wanted[s]), t) for (d, n), t in zip(own, taken(best), strict=True)]
    return sorted(out, key=str)


def test_op11_against_plain(spark, documents):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    rows += [(900, "one two", None), (None, "three", None), (901, "", "bare"), (902, None, "bare"), (903, "w " * 5000, "long")] + [(904 + k, "small text here", "tiny") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: mixing.F.lit(1) for c in ("size", "target", "copies", "own", "digest", "weight", "range")})
    got = sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix_report(df).collect()), key=str)
    want = plain_mix(rows)
    assert [(g[0], g[1], g[2], g[4]) for g in got] == [(w[0], w[1], w[2], w[4]) for w in want]
    assert all(math.isclose(g[3], w[3]) for g, w in zip(got, want, strict=True))
    # the documents themselves, as often as the report says, with their columns
    copies = Counter()
    for r in mixing.mix_report(df).collect():
        copies[r.doc_id] += r.copies
    out = mixing.mixed(df)
    assert out.columns == df.columns and Counter(r.doc_id for r in out.collect()) == +copies


def test_op11_limits_are_kept_and_shares_are_whole(spark):
    rows = [("a", 10, 5), ("b", 1000, 2), ("c", 7, 1), (None, 0, 5), ("d", 400, 2)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long, weight long")).collect()}
    assert got["a"] == 30 and got[None] == 0 and got["c"] == 21
    assert math.isclose(sum(got.values()), 1417) and got["b"] == got["d"] == 683
    want = plain_targets({"a": 5, "b": 10**15, "c": 3, "d": 10**14, "e": 1, "f": 10**12})
    many = spark.createDataFrame([("a", 5), ("b", 10**15), ("c", 3), ("d", 10**14), ("e", 1), ("f", 10**12)], "source string, source_size long")
    assert {r.source: r.target for r in mixing.targets(mixing.weighed(many)).collect()} == pytest.approx({k: float(v) for k, v in want.items()})


def test_op11_order_is_by_code_points(spark):
    names = ["b", "B", "é", "z", "\U0001f600", "￮", None, ""]
    got = mixing.in_order(spark.createDataFrame([(n,) for n in names], "source string").repartition(3)).collect()
    assert [r.source for r in sorted(got, key=lambda r: r.place)] == [*sorted(n for n in names if n is not None), None]


def test_op11_draws_come_near_targets(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randint(1, 60), f"s{k % 4}") for k in range(2000)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(t - target) < 0.02 * target for _, target, t in got)


def test_op11_empty(spark, none):
    assert mixing.mix_report(none).count() == 0 and mixing.mixed(none).count() == 0
    with pytest.raises(ValueError):
        mixing.weighed(none.select("source"), (1, 0))


# op12


def plain_phrases(rows: list[tuple], longest=5, least=100, top=2000) -> list[tuple]:
    """rows: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        able = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dead = {p[i:j] for p, a in able.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and able.get(p[i:j]) is not None and a >= able[p[i:j]]}
        scored = []
        for p, a in able.items():
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if p not in dead:
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrase_corpus() -> list[tuple]:
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcDEéß漢") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    rows += [("en", None), (None, ""), ("de", " \t. ,"), ("en", "a b c d e f " * 500), ("xx", "x" * 10_000), ("en", "\x00 nul\x00 \x85 nel nbsp " * 40)]
    return rows + rows[:20]


@pytest.mark.parametrize(("least", "top"), [(5, 2000), (20, 7)])
def test_op12_against_plain(spark, least, top):
    rows = phrase_corpus()
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "lang string, text string, n long, phrase string, size int").repartition(3)
    got = [tuple(r) for r in phrases.collocations(df, least=least, top=top).collect()]
    assert sorted(got) == plain_phrases(rows, least=least, top=top) and got


def test_op12_a_full_sketch_loses_nothing(spark):
    """With 64 cells nearly every run survives the first pass; the result is the same."""
    rows = phrase_corpus()
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(df, least=10, cells=64).collect()) == plain_phrases(rows, least=10)


def test_op12_sketch_prunes_and_never_underestimates(spark):
    rows = spark.createDataFrame([("en", "rare%d words%d here%d " % (k, k, k) + "often said ") for k in range(150)], "lang string, text string").repartition(5)
    bits = phrases.frequent_cells(rows, 1 << 16, least=100)
    assert 0 < np.unpackbits(bits).sum() < 40
    kept = phrases.exact_counts(rows, bits, least=100).collect()
    assert {(r.phrase, r.n) for r in kept if r["size"]} == {("often", 150), ("said", 150), ("often said", 150)}


def test_op12_equal_hashes_are_told_apart():
    raw = np.frombuffer(b"aa bb cc aa bb", np.uint8)
    s = phrases._Slice(raw, np.array([0, len(raw)]), np.zeros(1, np.int32), np.zeros(1, np.uint64))
    out = Counter()
    for _, p, c in s.counted(np.arange(4), 2, np.zeros(4, np.uint64)):
        out.update({x: int(n) for x, n in zip(p.to_pylist(), c, strict=True) if n})
    assert out == {"aa bb": 2, "bb cc": 1, "cc aa": 1}


def test_op12_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10**12
    counts = spark.createDataFrame([("en", 0, "", 10**14), ("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", 7 * 10**11)], "lang string, size int, phrase string, n long")
    assert phrases.cut_scores(counts).first().score == 1000 * 7 * 10**11 * 10**14 // (big * (big + 1))


def test_op12_empty(spark, none):
    assert phrases.collocations(none).count() == 0


# op13

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs: list[tuple], items: list[tuple], top=10) -> list[tuple]:
    terms = [TERMS.findall((t or "").translate(LOWER)) for _, t in docs]
    held = [(d, Counter(t), len(t)) for (d, _), t in zip(docs, terms, strict=True) if t]
    big_n, big_l = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(TERMS.findall((t or "").translate(LOWER)))
    out = []
    for i, q in asked.items():
        found = []
        for d, c, n in held:
            m = 25 + 75 * n * big_n // big_l
            score = sum(times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in q.items() if c[t])
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(i, k, d, -s) for k, (s, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def asked_items(docs: list[tuple]) -> list[tuple]:
    rng = random.Random(11)
    texts = [t for _, t in docs if t]
    cut = [(k, " ".join(rng.sample(texts[k % len(texts)].split() * 3, min(30, len(texts[k % len(texts)].split()))))) for k in range(25)]
    return [*cut, (100, None), (101, ""), (102, "!?"), (103, "nowhere tobefound"), (104, "a"), (105, "A a a A"), (106, "x" * 5000), (107, "one two"), (107, "three ONE")]


@pytest.mark.parametrize(("postings", "step"), [(1 << 20, 64), (50, 1), (7, 3)])
def test_op13_against_plain(spark, documents, monkeypatch, postings, step):
    monkeypatch.setattr(lexical_search.search, "__defaults__", (10, postings, step))
    docs = [(r.doc_id, r.text) for r in documents.collect()] + [(None, "one two three")]
    items = asked_items(docs)
    df = documents.select("doc_id", "text", "words", *[lexical_search.F.lit(1).alias(c) for c in ("n", "terms", "score", "item")]).unionByName(spark.createDataFrame([(None, "one two three", 1, 1, 1, 1, 1)], "doc_id long, text string, words long, n int, terms int, score int, item int"))
    got = lexical_search.ranked(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == plain_search(docs, items)


def test_op13_items_in_blocks(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    items = asked_items(docs)
    got = lexical_search.ranked(documents, spark.createDataFrame(items, "item_id long, text string"), block_bytes=1500).collect()
    assert sorted(tuple(r) for r in got) == plain_search(docs, items)


def test_op13_stops_early_and_ties_are_seen():
    """One list of falling impacts is read for a few steps only; equal scores are read to their end."""
    n = 10_000
    impact = np.arange(n, 0, -1).astype(np.int64)
    one = lexical_search.Shard(np.arange(n), np.arange(n + 1), np.zeros(n, np.int64), impact, 1)
    best = lexical_search._Best(1, 10)
    asked = (np.array([0]), np.array([1]), np.array([1]))
    assert one.search(0, *asked, best, 16) <= 32 and best.doc[0].tolist() == list(range(10))
    tied = lexical_search.Shard(np.arange(n)[::-1].copy(), np.arange(n + 1), np.zeros(n, np.int64), np.full(n, 5), 1)
    best = lexical_search._Best(1, 10)
    assert tied.search(0, *asked, best, 16) == n and best.doc[0].tolist() == list(range(10))
    assert not tied.seen.any()


def test_op13_lists_read_less_than_all(spark):
    """Round-robin reading over several lists leaves most postings of a corpus unread."""
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices([f"t{j}" for j in range(30)], k=rng.randint(5, 40)))) for k in range(5000)] + [(9000 + k, "t1 t2 t1 t2") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    own = lexical_search.Vocabulary.of([("q", "t1 t2")])
    held = spark.sparkContext.broadcast(own)
    forward = lexical_search.forward_index(df, held)
    n, words, weight = lexical_search.weights(forward, len(own.keys))
    found = lexical_search.search(forward, held, n, words, weight).collect()
    total = sum(len(r.terms) for r in forward.collect())
    assert {r.doc_id for r in found} == set(range(9000, 9010)) and 0 < sum(r.postings for r in found) < total / 3


def test_op13_terms_are_compared_by_bytes():
    own = lexical_search.Vocabulary.of([("a", "Fünf éclair 42 x_y"), ("b", "fünf")])
    raw = np.frombuffer("FüNF fünf fünft 42x 42 x y éclair".encode(), np.uint8)
    at, term = own.found(textscan.words(raw, np.array([0, len(raw)]), textscan.ALNUM, True))
    assert at.tolist() == [0, 1, 4, 5, 6, 7] and term[0] == term[1]


def test_op13_empty(spark, documents, none):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical_search.ranked(none, items).count() == 0
    assert lexical_search.ranked(documents, items.limit(0)).dtypes == lexical_search.ranked(documents, items).dtypes
    assert lexical_search.ranked(documents, items.limit(0)).count() == 0
