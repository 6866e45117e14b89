"""Retrieval, context and evaluation on literals."""

import math
import random

from pyspark.sql import functions as F

from siftspark.operators import context, evaluation, indexing, retrieval
from siftspark.plans import search

TOY = ["machine learning deep learning model", "natural language processing text", "deep learning neural network architecture", "computer vision image classification"]


def index(spark):
    return indexing.build_sparse(spark.createDataFrame(list(enumerate(TOY)), "id long, text string"))


def ask(spark, text):
    return spark.createDataFrame([(0, text)], "qid long, text string")


def found(df):
    return [(r.id, round(r.score, 6)) for r in df.orderBy("rank").collect()]


def test_bm25(spark):
    ix = index(spark)
    assert ix.corpus.first().asDict() == {"n_docs": 4, "avgdl": 4.5}
    assert round(ix.terms.filter("term = 'learning'").first().idf, 6) == 0.693147
    assert found(retrieval.bm25(ask(spark, "deep learning"), ix)) == [(0, 1.616205), (2, 1.32028)]
    assert found(retrieval.bm25(ask(spark, "learning"), ix, minimum=5)) == [(0, 0.956065), (2, 0.66014)]
    assert found(retrieval.bm25(ask(spark, "deep learning quantum"), ix, minimum=3)) == []
    assert len(found(retrieval.bm25(ask(spark, "deep learning quantum"), ix, minimum=2))) == 2
    scope = spark.createDataFrame([(2,), (3,)], "id long")
    assert found(retrieval.bm25(ask(spark, "deep learning"), ix, scope=scope)) == [(2, 1.32028)]
    assert found(retrieval.bm25(ask(spark, ""), ix)) == []


def hits(spark, ids, qid=0):
    return spark.createDataFrame([(qid, i, 1.0 / k, k) for k, i in enumerate(ids, 1)], "qid long, id long, score double, rank int")


def test_rrf(spark):
    got = retrieval.rrf(hits(spark, [10, 20, 30]), hits(spark, [20, 40, 10]))
    assert [(r.id, round(r.score, 9)) for r in got.orderBy("rank").collect()] == [(20, 0.032522475), (10, 0.032266458), (40, 0.016129032), (30, 0.015873016)]
    assert {r.id: r.source for r in got.collect()} == {10: "dense", 20: "bm25", 30: "dense", 40: "bm25"}


def test_rerank(spark):
    passages = spark.createDataFrame(list(enumerate(TOY)), "id long, text string")
    got = retrieval.reranked(hits(spark, [0, 1, 2, 3]), ask(spark, "deep learning"), passages)
    assert {r.id: r.score for r in got.collect()} == {0: 1.0, 1: 0.0, 2: 1.0, 3: 0.0}
    bad = got.withColumn("score", F.when(F.col("id") == 1, F.lit(float("nan"))).otherwise(F.col("score")))
    assert retrieval.bad_scores(bad).count() == 1
    kept = retrieval.reranked_or_fused(hits(spark, [0, 1, 2, 3]), bad).orderBy("rank").collect()
    assert [r.id for r in kept] == [0, 1, 2, 3] and kept[0].degraded_reasons == ["RERANK_UNAVAILABLE"]


def rows(spark, items, schema):
    return spark.createDataFrame(items, schema)


def test_selection(spark):
    schema = "qid long, id long, rank int, content_hash string, document_id string, version_id string, table_id string"
    r = rows(spark, [(0, 1, 1, "h1", "d1", "", ""), (0, 2, 2, "h1", "d1", "", ""), (0, 3, 3, "h2", "d2", "", "")], schema)
    assert [x.id for x in retrieval.select_evidence(r, 5).orderBy("position").collect()] == [1, 3]
    why = retrieval.without_repeats(r).filter("reason is not null").first()
    assert (why.id, why.reason, why.owner) == (2, "duplicate_hash", 1)
    r = rows(spark, [(0, 1, 1, "a", "d1", "", ""), (0, 2, 2, "b", "d1", "", ""), (0, 3, 3, "c", "d2", "", "")], schema)
    assert [x.id for x in retrieval.select_evidence(r, 2, ask(spark, "")).orderBy("position").collect()] == [1, 3]


def test_cell_coverage(spark):
    schema = "qid long, id long, rank int, content_hash string, document_id string, table_id string, cell_ids array<string>"
    r = rows(spark, [(0, 1, 1, "x", "d", "t", ["a", "b"]), (0, 2, 2, "y", "d", "t", ["a", "c"]), (0, 3, 3, "z", "d", "t", ["a", "b", "c"]), (0, 4, 4, "w", "d", "u", ["a"])], schema)
    assert [x.id for x in retrieval.select_covering(r, 9).orderBy("position").collect()] == [1, 2, 4]


def test_dense_is_exact(spark):
    rng = random.Random(42)
    vectors = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(50)]
    df = indexing.l2_normalised(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, v array<double>"), "id", "v").repartition(5)
    unit = {r.id: r.vector for r in df.collect()}
    got = retrieval.dense(df.filter("id < 3").withColumnRenamed("id", "qid"), df, 5, block=2).collect()
    for q in range(3):
        want = sorted(unit, key=lambda i: (-round(sum(a * b for a, b in zip(unit[q], unit[i])), 9), i))[:5]
        assert [r.id for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == want
    assert indexing.zero_vectors(spark.createDataFrame([(1, [0.0]), (2, [1.0])], "i long, v array<double>"), "i", "v", 1).count() == 1


def test_allocated_ids(spark):
    df = spark.createDataFrame([("a", 0), ("b", None), ("c", None)], "name string, index_id long")
    assert {r.name: r.index_id for r in indexing.allocate_ids(df, ["name"]).collect()} == {"a": 0, "b": 1, "c": 2}


def test_metrics(spark):
    rel = spark.createDataFrame([(0, 2), (0, 4), (0, 9)], "qid long, id long")
    m = evaluation.per_query(hits(spark, [1, 2, 3, 4]), rel, ndcg_at=(4,)).first()
    assert round(m.recall_3, 6) == 0.333333 and m.mrr == 0.5 and round(m.ndcg_4, 6) == 0.498189
    none = spark.createDataFrame([], "qid long, id long")
    assert tuple(evaluation.citation_scores(none, none).first()) == (1.0, 1.0)
    groups = spark.createDataFrame([(0, 0, 1), (0, 0, 2)], "qid long, grp int, id long")
    g = evaluation.group_scores(hits(spark, [1, 3, 2]), groups, recall_at=(2, 3)).first()
    assert (g.group_recall_2, g.group_recall_3, round(g.group_mrr, 6)) == (0.0, 1.0, round(1 / 3, 6))


def test_leakage_and_gates(spark):
    e = spark.createDataFrame([("x", "dev"), ("x", "test"), ("y", "dev")], "chunk string, split string")
    assert [(r.key, r.splits) for r in evaluation.leakage(e, "chunk").collect()] == [("x", "dev,test")]
    got = {r.metric: r.passed for r in evaluation.gates(spark.createDataFrame([("recall@10", 0.9)], "metric string, value double")).collect()}
    assert got["recall@10"] and not got["rejection"]


def test_resolve_evidence(spark):
    chunks = [("d", "c0", 0, 1, 1, ["S"], "text", True, "alpha beta gamma. one", "x"), ("d", "c1", 1, 1, 1, ["S"], "text", True, "two delta epsilon", "x"), ("d", "c2", 2, 1, 1, ["S"], "text", True, "unrelated words", "x")]
    anchors = [("a0", "d", 1, [], "alpha beta", None), ("a1", "d", 1, [], "gamma. one two delta", None), ("a2", "d", 1, [], "nothing like this", None), ("a3", "d", 1, [], "ALPHA  Beta", None), ("a4", "d", 2, [], "alpha beta", None), ("a5", "d", 1, [], "alpha beta", "00")]
    c = spark.createDataFrame(chunks, "document_key string, chunk_id string, chunk_index int, page_start int, page_end int, section_path array<string>, subtype string, indexed boolean, raw_content string, retrieval_content string")
    a = spark.createDataFrame(anchors, "anchor_id string, document_key string, page int, section_path array<string>, quote string, quote_hash string")
    got = {r.anchor_id: (r.status, r.method, r.chunk_ids) for r in evaluation.resolve_evidence(a, c).collect()}
    assert got == {"a0": ("resolved", "exact", ["c0"]), "a1": ("multi_chunk", "adjacent_chunks", ["c0", "c1"]), "a2": ("unresolved", "none", []), "a3": ("resolved", "normalized_exact", ["c0"]), "a4": ("unresolved", "none", []), "a5": ("manual_review", "none", [])}


def test_context(spark):
    chunks = spark.createDataFrame([(f"c{k}", "d", ["s"], k, f"Text {k}. More") for k in range(4)], "chunk_id string, document_id string, section_path array<string>, chunk_index int, raw_content string")
    res = chunks.filter("chunk_id = 'c1'").withColumn("qid", F.lit(0)).withColumn("rank", F.lit(1))
    near = context.with_neighbours(res, chunks)
    assert [r.chunk_id for r in near.orderBy("position").collect()] == ["c1", "c0", "c2"]
    blocks = context.packed(near, 5).collect()
    assert len(blocks) == 1 and blocks[0].truncated and blocks[0].content == "Text 1. More\nText 0."
    whole = context.packed(near, 1000).first()
    assert whole.content == "Text 1. More\nText 0. More\nText 2. More" and not whole.truncated
    assert context.citation_maps(context.packed(near)).first().citations == {1: "c1"}


def test_merged(spark):
    schema = "qid long, search int, chunk_id string, rank int, document_id string, element_id string, raw_content string, cell_ids array<string>"
    r = spark.createDataFrame([(0, 0, "a", 1, "d1", None, "A", []), (0, 0, "b", 2, "d1", None, "B", []), (0, 1, "b", 1, "d1", None, "B", []), (0, 1, "c", 2, "d2", None, "A", []), (0, 1, "e", 3, "d2", None, "E", [])], schema)
    assert [x.chunk_id for x in context.merged(r, 9).orderBy("rank").collect()] == ["b", "a", "e"]
    keep = spark.createDataFrame([(0, "d1"), (0, "d2")], "qid long, document_id string")
    assert [x.chunk_id for x in context.merged(r, 2, preserve=keep).orderBy("rank").collect()] == ["b", "e"]
    cells = spark.createDataFrame([(0, 0, "a", 1, "d", "t", "A", ["1", "2"]), (0, 0, "b", 2, "d", "t", "B", ["1"])], schema)
    assert [x.chunk_id for x in context.merged(cells, 9, "cell_coverage").collect()] == ["a"]


def test_bm25_is_the_same_under_repartitioning(spark):
    docs = spark.createDataFrame(list(enumerate(TOY * 5)), "id long, text string")
    got = [found(retrieval.bm25(ask(spark, "deep learning model"), indexing.build_sparse(docs.repartition(n)), 7)) for n in (1, 4, 17)]
    assert got[0] == got[1] == got[2] and math.isclose(got[0][0][1], got[0][1][1])


def test_gold_of_short_questions(spark):
    docs = [(0, "one two three four five six seven eight"), (1, "zero one two"), (2, "nothing"), (3, None)]
    asked = [(0, "one two"), (1, "two three four five six seven"), (2, "one two three four five six seven"), (3, "noth"), (4, "absent"), (5, None)]
    got = search.gold(spark.createDataFrame(asked, "qid long, text string"), spark.createDataFrame(docs, "id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(0, 0), (0, 1), (1, 0), (2, 0), (3, 2)]
