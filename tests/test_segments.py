"""The segmented index against a rebuilt one, its log of commits, and export graphs of any depth."""

import random

import pytest
from pyspark.sql import functions as F

from siftspark.operators import indexing, retrieval
from siftspark.operators.commits import Conflict, Log, State
from siftspark.operators.segments import Index
from siftspark.sources.export_graph import export_order, vertices


def corpus(n, seed=2):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    return [(k, " ".join(rng.choices(words, weights, k=rng.randint(0, 80)))) for k in range(n)]


QUERIES = [(0, "w0 w1 w2 w250 w280"), (1, "w5 w40 w77 w200"), (2, "nowhere"), (3, ""), (4, "w0"), (5, " ".join(f"w{k}" for k in range(0, 300, 7)))]


def same(got, want):
    g, w = ({(r.qid, r.id): (round(r.score, 6), r["rank"]) for r in x.collect()} for x in (got, want))
    assert g == w


def check(spark, index, rows, **more):
    docs = spark.createDataFrame(rows, "id long, text string")
    queries = spark.createDataFrame(QUERIES, "qid long, text string")
    plain = indexing.build_sparse(docs)
    for k in (5, None):
        same(index.search(queries, k, **more), retrieval.bm25(queries, plain, k, **more))


def test_search_is_that_of_a_rebuilt_index(spark, tmp_path):
    rows = corpus(400)
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    index = Index(spark, f"file://{tmp_path}/i", buckets=8).add(docs, "one")
    check(spark, index, rows)
    check(spark, index, rows, minimum=3)
    check(spark, index, rows, k1=0.9, b=0.2)
    queries = spark.createDataFrame(QUERIES, "qid long, text string")
    scope = docs.filter("id % 3 = 0").select("id")
    same(index.search(queries, 7, scope=scope), retrieval.bm25(queries, indexing.build_sparse(docs), 7, scope=scope))


def test_batches_deletes_and_merges(spark, tmp_path):
    rows = dict(corpus(300))
    df = lambda some: spark.createDataFrame(some, "id long, text string")
    index = Index(spark, f"file://{tmp_path}/i", buckets=8).add(df(list(rows.items())), "a")
    version = index.state.version
    assert index.add(df(list(rows.items())), "a").state.version == version  # a repeated batch
    new = dict(corpus(120, seed=9))
    moved = {k + 250: t for k, t in new.items()}  # 50 of them take the place of others
    index.add(df(list(moved.items())), "b")
    rows |= moved
    assert index.statistics()[0] == len(rows)
    check(spark, index, list(rows.items()))
    index.delete(df([(k, "") for k in range(0, 400, 9)] + [(10**6, "")]).select("id"), "gone")
    rows = {k: t for k, t in rows.items() if k % 9}
    check(spark, index, list(rows.items()))
    index.add(df([(5000, "w0 w280 w280"), (5001, None)]), "c")
    rows |= {5000: "w0 w280 w280", 5001: ""}
    assert len(index.state.tables["blocks"]) == 3
    index.merge(most_docs=150)  # the two small ones
    assert len(index.state.tables["blocks"]) == 2 and index.statistics()[0] == len(rows)
    check(spark, index, list(rows.items()))
    index.merge()
    assert len(index.state.tables["blocks"]) == 1 and not index.state.tables["dead"] and index.statistics() == (len(rows), sum(len((t or "").split()) for t in rows.values()))
    check(spark, index, list(rows.items()))
    reopened = Index(spark, index.root, buckets=8)
    check(spark, reopened, list(rows.items()))
    assert index.log.vacuum(["blocks", "shards", "dead"])
    check(spark, reopened.refresh(), list(rows.items()))


def test_only_asked_buckets_are_read(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i", buckets=16).add(spark.createDataFrame(corpus(200), "id long, text string"), "a")
    files = [r[0] for r in index.blocks([3]).select("_metadata.file_path").distinct().collect()]
    assert files and all("/bucket=3/" in f for f in files)
    assert "PartitionFilters: [isnotnull(bucket" in index.blocks([3])._jdf.queryExecution().toString()


def test_bounds_leave_postings_unread(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, " ".join(["common"] * rng.randint(1, 3) + [f"x{rng.randint(0, 3000)}" for _ in range(30)])) for k in range(4000)] + [(9000 + k, f"rare{k % 2} rare2 common") for k in range(12)]
    index = Index(spark, f"file://{tmp_path}/i", buckets=4).add(spark.createDataFrame(rows, "id long, text string").repartition(3), "a")
    queries = spark.createDataFrame([(0, "rare0 rare2 common")], "qid long, text string")
    read = index.postings_read(queries, 5).first()
    assert read.postings >= 4000 and read.read < read.postings / 20
    same(index.search(queries, 5), retrieval.bm25(queries, indexing.build_sparse(spark.createDataFrame(rows, "id long, text string")), 5))


def test_empty_index(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i")
    queries = spark.createDataFrame(QUERIES, "qid long, text string")
    assert index.search(queries).count() == 0
    index.add(spark.createDataFrame([], "id long, text string"), "none")
    assert index.search(queries).count() == 0 and index.documents().count() == 0
    index.add(spark.createDataFrame([(1, ""), (2, None)], "id long, text string"), "blank")
    assert index.search(queries).count() == 0 and index.statistics() == (2, 0)


def test_a_batch_that_fails_shows_nothing(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    rows = spark.range(3).selectExpr("id as x")

    def write(fail):
        def go(state):
            parts = {t: log.part(t) for t in ("first", "second", "third")}
            for n, p in enumerate(parts.values()):
                if fail and n == 2:
                    raise OSError("between the second and the third write")
                rows.write.parquet(f"{log.root}/{p}")
            return parts

        return go

    assert log.commit("1", write(False)).version == 1
    with pytest.raises(OSError):
        log.commit("2", write(True))
    assert log.state().version == 1 and log.read("second", "x long").count() == 3
    log.commit("2", write(False))
    log.commit("2", write(True))  # it is in already, so nothing is written
    assert log.state().version == 2 and all(log.read(t, "x long").count() == 6 for t in ("first", "second", "third"))
    assert len(log.vacuum(["first", "second", "third"])) == 2
    assert log.read("third", "x long").count() == 6 and log.versions() == [2]


def test_two_writers_of_one_version(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    log.publish(State(1, {"t": ["t/a"]}, ["a"]))
    with pytest.raises(Conflict):
        log.publish(State(1, {"t": ["t/b"]}, ["b"]))
    assert log.state().tables == {"t": ["t/a"]}
    other = []

    def write(state):
        if not other:  # another writer is faster once
            other.append(log.publish(State(2, {"t": ["t/a", "t/c"]}, ["a", "c"])))
        return {"t": "t/d"}

    assert log.commit("d", write).tables == {"t": ["t/a", "t/c", "t/d"]}
    assert log.state(1).tables == {"t": ["t/a"]}


def walk(nodes, refs):
    """Plain walk of one document."""
    children, out, lost = {}, [], 0
    for p, c, place in refs:
        children.setdefault(p, []).append((place, c))
    stack = [(c, ()) for root in ("#body", "#furniture") for _, c in sorted(children.get(root, []), reverse=True)]
    while stack:
        ref, path = stack.pop()
        if ref not in nodes or ref in path:
            lost += 1
            continue
        out.append(ref)
        stack += [(c, (*path, ref)) for _, c in sorted(children.get(ref, []), reverse=True)]
    return out, max(0.0, 1 - 0.02 * lost)


def graphs():
    rng = random.Random(8)
    yield [f"e{k}" for k in range(40)], [("#body" if k == 0 else f"e{k - 1}", f"e{k}", 0) for k in range(40)]
    yield ["a", "b", "c"], [("#furniture", "a", 0), ("a", "b", 0), ("b", "a", 1), ("a", "gone", 3), ("#body", "c", 0), ("c", "c", 0)]
    # a shared part is walked at each of its places, and one in it is a cycle
    yield list("abcdefg"), [("#body", "a", 1), ("#body", "b", 0), ("a", "c", 0), ("b", "c", 0), ("c", "d", 1), ("c", "e", 0), ("e", "c", 0), ("f", "g", 0), ("g", "f", 0), ("b", "d", 5)]
    yield ["x"], []
    for _ in range(6):
        n = rng.randint(2, 30)
        refs = [("#body" if k == 0 else "#furniture" if rng.random() < 0.1 else f"n{rng.randrange(k)}", f"n{k}", rng.randint(0, 2)) for k in range(n)]
        yield [f"n{k}" for k in range(n)], refs + [(f"n{rng.randrange(n)}", f"n{rng.randrange(n + 2)}", 9) for _ in range(2)]


def test_export_order_against_a_walk(spark):
    made = list(graphs())
    nodes = spark.createDataFrame([(d, r) for d, (ns, _) in enumerate(made) for r in ns], "document_id long, ref string")
    refs = spark.createDataFrame([(d, *r) for d, (_, rs) in enumerate(made) for r in rs], "document_id long, parent string, child string, place int")
    order, sure = export_order(nodes, refs)
    got = {}
    for r in order.orderBy("document_id", "reading_order").collect():
        got.setdefault(r.document_id, []).append(r.ref)
    confidence = {r.document_id: r.confidence for r in sure.collect()}
    for d, (ns, rs) in enumerate(made):
        want, c = walk(set(ns), rs)
        assert got.get(d, []) == want and abs(confidence[d] - c) < 1e-9, d


def test_export_order_of_a_chain_of_5000(spark):
    n = 5000
    k = F.col("id")
    ref = lambda x: F.concat(F.lit("e"), x.cast("string"))
    nodes = spark.range(n).select(F.lit(1).alias("document_id"), ref(k).alias("ref"))
    refs = spark.range(n).select(F.lit(1).alias("document_id"), F.when(k == 0, F.lit("#body")).otherwise(ref(k - 1)).alias("parent"), ref(k).alias("child"), F.lit(0).alias("place"))
    order, sure = export_order(nodes, refs)
    assert order.filter(ref(F.col("reading_order")) == F.col("ref")).count() == n and sure.first().confidence == 1.0


def test_export_order_of_large_documents_is_the_same(spark):
    """Ranked lists and walks in a task, and both beside one another, give what a plain walk gives."""
    made = list(graphs())
    nodes = spark.createDataFrame([(d, r) for d, (ns, _) in enumerate(made) for r in ns], "document_id long, ref string")
    refs = spark.createDataFrame([(d, *r) for d, (_, rs) in enumerate(made) for r in rs], "document_id long, parent string, child string, place int")
    for small in (0, 25):
        order, sure = export_order(nodes, refs, small)
        got = {}
        for r in order.orderBy("document_id", "reading_order").collect():
            got.setdefault(r.document_id, []).append(r.ref)
        confidence = {r.document_id: r.confidence for r in sure.collect()}
        for d, (ns, rs) in enumerate(made):
            want, c = walk(set(ns), rs)
            assert got.get(d, []) == want and abs(confidence[d] - c) < 1e-9, (small, d)


def test_ranking_sends_no_table_through_the_driver(spark):
    """Joins of large documents' rounds are shuffles, whatever their size; small documents need no rounds at all (there was a broadcast a join)."""
    sent = lambda df: df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")
    events = spark.range(10).select(F.lit(1).alias("document_id"), F.col("id").cast("string").alias("event"), F.when(F.col("id") < 9, (F.col("id") + 1).cast("string")).alias("next"), F.lit(1).alias("weight"))
    tree = vertices(events.select("document_id", F.col("event").alias("ref")), events.select("document_id", F.lit("#body").alias("parent"), F.col("event").alias("child"), F.lit(0).alias("place")))
    tree.collect()
    assert sent(tree) == 0
    order, sure = export_order(events.select("document_id", F.col("event").alias("ref")), events.select("document_id", F.lit("#body").alias("parent"), F.col("event").alias("child"), F.col("weight").alias("place")))
    assert [x.rsplit("/", 1)[1].split("-")[0] for x in order.inputFiles()[:1]] == ["part"] and "/orders-" in order.inputFiles()[0] and sure.count() == 1
