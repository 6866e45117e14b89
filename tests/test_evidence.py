"""Candidates, interval joins and neighbours with bounds against their plain forms."""

import random

import numpy as np
from pyspark.sql import functions as F

from siftspark.operators import evidence, intervals, retrieval
from siftspark.operators.balls import Balls


def test_overlapping_is_every_pair_once(spark):
    rng = random.Random(3)

    def ranges(n):
        out = [(rng.choice("ab"), k, s, s + rng.choice([0, 0, 1, 3, 10, 100, 5000])) for k, s in enumerate(rng.randint(-200, 3000) for _ in range(n))]
        return [*out, ("a", -1, None, 5), ("b", -2, 9, None), ("a", -3, 7, 2), ("a", -4, -(2**40), 2**40)]

    left, right = ranges(150), ranges(120)
    a = spark.createDataFrame(left, "key string, i long, a0 long, a1 long")
    b = spark.createDataFrame(right, "key string, j long, b0 long, b1 long").repartition(3)
    got = sorted((r.i, r.j) for r in intervals.overlapping(a, b, ["key"], ("a0", "a1"), ("b0", "b1")).collect())
    good = lambda s, e: s is not None and e is not None and s <= e
    want = sorted((i, j) for k, i, s, e in left for m, j, t, f in right if k == m and good(s, e) and good(t, f) and s <= f and t <= e)
    assert got == want
    assert intervals.overlapping(a.limit(0), b, ["key"], ("a0", "a1"), ("b0", "b1")).count() == 0


def test_candidates_lose_nothing(spark, monkeypatch):
    """Statuses are those of meeting every chunk of the document."""
    rng = random.Random(6)
    words = ["alpha", "beta-two", "3.5", "gamma", "x_y", "delta", "Fünf", "σ", "e", "kappa", "mu", "nu", "pi"]
    said = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", ". ", " - ", " | ", "  "]) for _ in range(n))
    chunks, anchors = [], []
    for d in range(12):
        texts = [said(rng.randint(1, 9)) for _ in range(12)]
        for i, t in enumerate(texts):
            page = None if rng.random() < 0.1 else i // 4
            chunks.append((f"d{d}", f"c{i}", i, page, page, [f"S{i % 3}"], rng.choice(["text", "table_row", "table_raw_text", None]), rng.random() < 0.9, t, rng.choice([t, "head " + t, said(4)])))
        whole = " ".join(texts)
        for k in range(12):
            at = rng.randrange(len(whole))
            quote = rng.choice([whole[at : at + rng.randint(1, 60)], said(rng.randint(1, 6)), "zz", "", whole[at : at + 25] + " zz"])
            anchors.append((f"d{d}/{k}", f"d{d}", rng.randint(0, 3), rng.choice([[], ["s1"]]), quote, None))
    c = spark.createDataFrame(chunks, "document_key string, chunk_id string, chunk_index int, page_start int, page_end int, section_path array<string>, subtype string, indexed boolean, raw_content string, retrieval_content string")
    a = spark.createDataFrame(anchors, "anchor_id string, document_key string, page int, section_path array<string>, quote string, quote_hash string")
    show = lambda: {r.anchor_id: (r.status, r.method, tuple(r.chunk_ids), r.reason) for r in evidence.resolve_evidence(a, c).collect()}
    got = show()
    monkeypatch.setattr(evidence, "candidates", lambda anchors, chunks, fuzzy, widest: anchors.select("anchor_id", "document_key").join(chunks.select("document_key", "chunk_id"), "document_key"))
    assert got == show() and len({s for s, *_ in got.values()}) == 4


def test_nearest_by_bounds_is_exact(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = centres[rng.integers(0, 12, 1500)] + 0.05 * rng.normal(size=(1500, 16))
    rows[40] = rows[41]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "id long, vector array<double>").repartition(4)
    queries = vectors.filter("id % 25 = 0").withColumnRenamed("id", "qid")
    balls = Balls.build(vectors, 12, 50)
    for k in (1, 8):
        found, share = balls.nearest(queries, k)
        want = {(r.qid, r.id): (r["rank"], round(r.score, 9)) for r in retrieval.dense(queries, vectors, k).collect()}
        assert {(r.qid, r.id): (r["rank"], round(r.score, 9)) for r in found.collect()} == want
        computed = share.agg(F.sum("computed").alias("c"), F.sum("n").alias("n")).first()
        assert computed.c < computed.n / 4
    found, _ = balls.nearest(queries, 2000)  # more than there are
    assert found.count() == 60 * 1500
    assert Balls.build(vectors.limit(0)).nearest(queries, 3)[0].count() == 0
