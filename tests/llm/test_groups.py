"""Operators that compare documents, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftspark.llm import components, embedding_dedup, line_dedup, minhash_docs, registry, substring_dedup

from .conftest import DATA

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_contract(pairs):
    pairs = [p for p in pairs if p[0] != p[1]]
    if pairs:
        sets = Sets()
        for a, b in pairs:
            sets.join(a, b)
        hi, lo = components.contract(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
        assert dict(zip(hi.tolist(), lo.tolist())) == {x: sets.find(x) for p in pairs for x in p if sets.find(x) != x}


def test_components(spark):
    pairs = [(k, k + 1) for k in range(100, 140)] + [(0, k) for k in range(1, 60)] + [(7, 500), (900, 901), (901, 900), (5, 5), (None, 3)]
    got = components.components(spark.createDataFrame(pairs, "u long, v long").repartition(7))
    sets = Sets()
    for a, b in pairs:
        if a is not None and a != b:
            sets.join(a, b)
    assert {r.node: r.component for r in got.collect()} == {x: sets.find(x) for x in sets.up}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_set(text, n):
    w = SPACED.findall((text or "").encode().lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain5(rows, n, percent=80):
    sets, full = Sets(), [(d, shingle_set(t, n)) for d, t in rows]
    for i, (a, x) in enumerate(full):
        sets.find(a)
        for b, y in full[:i]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                sets.join(a, b)
    return sorted((d, len(x), sets.find(d), sets.find(d) == d) for d, x in full)


@pytest.mark.parametrize("n, block", [(2, 4096), (5, 4096), (2, 2)])
def test_op5(spark, documents, none, n, block):
    got = minhash_docs.grouped(documents, n, block=block).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == plain5([(r.doc_id, r.text) for r in documents.collect()], n)
    if block > 2:
        assert minhash_docs.grouped(none, n).count() == 0


def test_op5_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in registry.op5_minhash_docs(spark, DATA).select("doc_id", "n_shingles", "component_id", "kept").collect()) == plain5(rows, 2)
    kept = {d for d, _, _, k in plain5(rows, 5) if k}
    assert {r.doc_id for r in minhash_docs.deduplicated(docs).collect()} == kept


def test_op5_null_id(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash_docs.grouped(df, 2).collect()} == {(None, None, True), (1, 1, True)}


def plain7(rows, window):
    words = [(d, SPACED.findall((t or "").encode())) for d, t in rows]
    n = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, edge", [(35, 10), (6, 2), (3, 3), (4, 1)])
def test_op7(spark, documents, none, window, edge):
    got = substring_dedup.scanned(documents, window, edge)
    want = plain7([(r.doc_id, r.text) for r in documents.collect()], window)
    assert sorted(map(tuple, got.collect()), key=repr) == want and sum(r[2] for r in want) > 0
    if window == 35:
        assert substring_dedup.scanned(none).count() == 0


def test_op7_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = registry.op7_substring_dedup(spark, DATA).collect()
    assert sorted(map(tuple, got), key=repr) == plain7([(r.doc_id, r.text) for r in docs.collect()], 35)
    with pytest.raises(ValueError):
        substring_dedup.scanned(docs, 5, 9)


def vectors():
    rng = np.random.default_rng(2)
    out = []
    for k in range(30):
        v = rng.normal(size=8)
        for c in range(rng.integers(1, 7)):
            out.append((len(out), (v + rng.normal(size=8) * 0.02 * c).tolist(), k % 3))
    out += [(1000, [0.0] * 8, 0), (1001, None, 0), (1002, [1.0, None] + [0.0] * 6, 0), (1003, [float("nan")] + [1.0] * 7, 0), (1004, out[0][1], None), (1005, [], 0), (1006, [1.0, 2.0], 0), (1007, out[0][1], 0), (1008, out[0][1], 1), out[3]]
    return out


def test_op6(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    sets, links = Sets(), [0] * len(rows)
    good = [v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    for i, (a, v, la) in enumerate(rows):
        sets.find(a)
        for j, (b, w, lb) in enumerate(rows[:i]):
            if good[i] and good[j] and la == lb and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                sets.join(a, b)
                links[i] += 1
                links[j] += 1
    want = sorted((r[0], n, sets.find(r[0]), sets.find(r[0]) == r[0]) for r, n in zip(rows, links))
    for block in (1024, 3):
        assert sorted(map(tuple, embedding_dedup.linked(df, block=block).collect())) == want
    assert embedding_dedup.linked(df.filter("false")).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(embedding_dedup.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(embedding_dedup.hadamard(embedding_dedup.hadamard(x)), x)


def plain2(rows, percent=80, n=line_dedup.SHINGLE):
    where = defaultdict(list)
    for d, t in sorted(set(rows), key=repr):
        for k, line in enumerate((t or "").encode().split(b"\n")):
            own = b" ".join(line.lower().split()).decode()
            if len(own) >= line_dedup.LEAST_CHARS:
                where[own].append((d, t, k))
    names = list(where)
    full = [{x[i : i + n] for i in range(len(x) - n + 1)} for x in names]
    sets = Sets()
    for i in range(len(names)):
        sets.find(i)
        for j in range(i):
            both = len(full[i] & full[j])
            if both and 100 * both >= percent * (len(full[i]) + len(full[j]) - both):
                sets.join(i, j)
    groups = defaultdict(list)
    for i, x in enumerate(names):
        groups[sets.find(i)] += where[x]
    return groups


def test_op2(spark, documents, none):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    groups = plain2(rows)
    removed = {(d, t, k) for g in groups.values() for d, t, k in g}
    got = line_dedup.line_report(documents).collect()
    assert len(got) == len(rows)
    clean = line_dedup.deduplicated(documents)
    assert clean.columns == documents.columns and clean.count() == len(rows)
    assert line_dedup.line_report(none).count() == 0 and line_dedup.deduplicated(none).count() == 0
    # one line of each group stays, that of the smallest id
    texts = Counter((d, t) for d, t in rows)
    total = sum(len(g) * 1 for g in groups.values()) - len(groups)
    assert sum(r.n_removed for r in got) >= total and sum(r.n_removed for r in got) <= total + sum(n - 1 for n in texts.values()) * 20
    left = plain2([(r.doc_id, r.text) for r in clean.collect()])
    assert all(len(g) == 1 for g in left.values()) and removed


def test_op2_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.filter("doc_id < 250").collect()]
    want = defaultdict(set)
    for g in plain2(rows).values():
        for d, _, k in sorted(g, key=lambda x: (x[0], x[2]))[1:]:
            want[d].add(k)
    got = line_dedup.line_report(docs.filter("doc_id < 250")).collect()
    assert {r.doc_id: set(r.removed) for r in got if r.removed} == dict(want)


def test_op2_one_character(spark):
    """A line with one character substituted is a near copy of it from 49 characters on; bands lose no more than 6 of 2 minima would."""
    rng = random.Random(11)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)).replace("  ", "xy").strip().ljust(n, "z") for n in range(50, 90)]
    other = [x[: len(x) // 2] + "#" + x[len(x) // 2 + 1 :] for x in lines]
    docs = spark.createDataFrame([(0, "\n".join(lines)), (1, "\n".join(other))], "doc_id long, text string")
    groups = plain2([(r.doc_id, r.text) for r in docs.collect()], n=5)
    assert len(groups) == len(lines) and all(len(g) == 2 for g in groups.values())
    assert {r.doc_id: r.removed for r in line_dedup.line_report(docs).collect()} == {0: [], 1: list(range(len(lines)))}
    assert (1 - 0.8**line_dedup.BAND_ROWS) ** line_dedup.BANDS <= (1 - 0.8**2) ** 6


def test_op2_short_lines(spark):
    """Short lines take part, exact copies and near ones; one of under five characters is like its exact copies only."""
    rows = [(0, "Ietzte.\nab\n\né\nab c\nStteen Erachtz."), (1, " ietzte. \nAB\n \nÉ\nabxc\nstteen erachtz,"), (2, "é\nIetzte.\nab  C\nab\x0b\nabcde"), (3, "\n\n"), (4, "ab")]
    got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in got} == {0: [], 1: [0, 1, 5], 2: [0, 1, 2, 3], 3: [], 4: [0]}


def test_pipeline(spark):
    """Every stage on what the one before kept, against the operators' own plain versions."""
    import corpus_pipeline
    from tests.llm.test_texts import plain8

    from siftspark.llm import storage

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = storage.stored(stage(spark, at, "/root/testdata/sf0.001"), name)
        before = {r.doc_id: r.text for r in at.collect()}
        if name != "bpe_encoding":
            assert out.columns == docs.columns
            now = {r.doc_id: r.text for r in out.collect()}
        if name == "language_id":
            assert len(now) >= 0.98 * len(before) and all(before[d] == t for d, t in now.items())
        elif name == "line_dedup":
            want = defaultdict(set)
            for g in plain2(list(before.items())).values():
                for d, _, k in sorted(g, key=lambda x: (x[0], x[2]))[1:]:
                    want[d].add(k)
            assert now == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d]) for d, t in before.items()}
        elif name == "minhash_near_dedup":
            assert set(now) == {d for d, _, _, k in plain5(list(before.items()), 5) if k}
        elif name == "decontamination":
            assert set(now) == {r[0] for r in plain8(list(before.items()), bench) if not r[5]}
        else:
            assert {r.doc_id: r.decoded_sha256 for r in out.collect()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in before.items()}
        at = out
    assert at.exceptAll(corpus_pipeline.run(spark, "/root/testdata/sf0.001")).count() == 0
