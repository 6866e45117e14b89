"""Retrieval for a batch of queries: every stage takes and returns tables keyed by qid.

Ranked tables are (qid, id, score, rank). Ranks are on scores rounded to nine places, then on
the id, so the order of floating-point sums can't flip ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark import shared
from siftspark.functions import text as T
from siftspark.operators import indexing
from siftspark.operators.indexing import SparseIndex

#: Queries whose vectors one pass may broadcast.
QUERY_BLOCK = 4096


def ranked(scored: DataFrame, k: int | None = None, tie: str = "id") -> DataFrame:
    """Adds rank by descending score, and keeps the first k. Catalyst limits groups before the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col(tie))
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)


# scopes


def ready_scope(documents: DataFrame, requested: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """Ids of ready documents: all, the requested ones, or the members of a collection."""
    ready = documents.filter(F.col("status") == "READY").select("document_id")
    for chosen in (requested, members):
        if chosen is not None:
            ready = ready.join(chosen.select("document_id"), "document_id", "left_semi")
    return ready


def missing_from_scope(documents: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested documents that aren't ready: a request with any is refused."""
    return requested.select("document_id").distinct().join(ready_scope(documents), "document_id", "left_anti")


def scope_problem(kind: str, document_ids: list[str] | None, collection_id: str | None) -> str | None:
    """Why a scope payload isn't valid: each type allows only its own fields."""
    if kind == "all" and (document_ids or collection_id):
        return "scope all takes no ids"
    if kind == "documents" and (not document_ids or collection_id):
        return "scope documents needs document_ids only"
    if kind == "collection" and (not collection_id or document_ids):
        return "scope collection needs collection_id only"
    return None if kind in ("all", "documents", "collection") else "unknown scope type"


def active_chunks(chunks: DataFrame, documents: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Indexed chunks of the active versions of ready documents."""
    docs = documents.filter(F.col("status") == "READY").select("document_id", F.col("active_version_id").alias("version_id"))
    if scope is not None:
        docs = docs.join(scope.select("document_id"), "document_id", "left_semi")
    return chunks.filter(F.col("index_id").isNotNull()).join(docs, ["document_id", "version_id"], "left_semi")


# sparse search


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, n_terms): the distinct tokens of each query."""
    found = queries.select("qid", F.array_distinct(T.tokens(F.coalesce("text", F.lit("")))).alias("terms"))
    return found.select("qid", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def sparse_query(original: Column, rewritten: Column) -> Column:
    """Both texts on lines of their own where they differ."""
    return F.when(rewritten.isNull() | (rewritten == original), original).otherwise(F.concat_ws("\n", original, rewritten))


def bm25(queries: DataFrame, index: SparseIndex, k: int | None = 30, k1: float = 1.5, b: float = 0.75, minimum: int = 1, scope: DataFrame | None = None) -> DataFrame:
    """Documents by BM25; a candidate holds at least min(minimum, distinct query terms) of the terms.

    A scope (id) filters postings before scoring; N, df and average length stay those of the corpus.
    """
    asked = shared.stored(query_terms(queries), "asked")
    words = shared.few(asked.select("term").distinct())
    # only the postings of asked terms go on; they don't move where the questions' terms can be broadcast
    posted = index.postings.join(words, "term")
    weights = posted.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(index.corpus)).select("term", indexing.idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl")
    if scope is not None:
        posted = posted.join(scope.select("id"), "id", "left_semi")
    terms = shared.few(shared.stored(asked.join(weights, "term"), "weights"))
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
    found = posted.join(terms, "term").groupBy("qid", "id").agg(F.sum(part).alias("score"), F.count("*").alias("hits"), F.max("n_terms").alias("n_terms"))
    return ranked(found.filter(F.col("hits") >= F.least(F.lit(minimum), F.col("n_terms"))).select("qid", "id", "score"), k)


# dense search


def dense(queries: DataFrame, vectors: DataFrame, k: int = 30, scope: DataFrame | None = None, block: int = QUERY_BLOCK, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Exact inner-product neighbours of unit vectors: queries (qid, vector) against vectors (id, vector).

    Queries go in blocks of bounded size to every task; a task multiplies its rows with a block
    and keeps its own k best per query, so k rows per query and task are shuffled. With ``made``,
    vectors are what it makes of batches of rows, in the task that multiplies them.
    """
    spark = vectors.sparkSession
    shared.bounded_batches(spark)
    rows = vectors if made else vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    if scope is not None:
        rows = rows.join(scope.select("id"), "id", "left_semi")
    out = None
    for ids, matrix in _query_blocks(queries, block):
        held = spark.sparkContext.broadcast((ids, matrix))
        part = rows.mapInArrow(lambda batches, held=held: _best(made(batches) if made else batches, *held.value, k), "qid long, id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "qid long, id long, score double, rank int")
    return ranked(out, k)


def _query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for r in queries.select(F.col("qid").cast("long"), F.col("vector").cast("array<double>")).toLocalIterator():
        ids.append(r.qid)
        rows.append(r.vector)
        if len(ids) == block:
            yield np.array(ids), np.array(rows)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows)


def _best(batches: Iterator[pa.RecordBatch], qids: np.ndarray, matrix: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query in a task. Only scores that reach a query's k-th so far are put in order."""
    places, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bar = np.full((len(qids), 1), -np.inf)
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            x = part.column("vector").flatten().to_numpy().reshape(part.num_rows, -1)
            own = matrix @ x.T
            # what is no number is ordered last, as it was
            place, row = np.nonzero(~(np.round(own, 9) < bar))
            if not len(place):
                continue
            places = np.concatenate((places, place))
            ids = np.concatenate((ids, part.column("id").to_numpy()[row]))
            scores = np.concatenate((scores, own[place, row]))
            order = np.lexsort((ids, -np.round(scores, 9), places))
            starts = np.searchsorted(places[order], np.arange(len(qids)))
            rank = np.arange(len(order)) - starts[places[order]]
            kept = order[rank < k]
            places, ids, scores = places[kept], ids[kept], scores[kept]
            full = np.bincount(places, minlength=len(qids)) >= k
            bar[full, 0] = np.round(scores[np.searchsorted(places, np.flatnonzero(full), "right") - 1], 9)
    if len(places):
        yield pa.RecordBatch.from_arrays([pa.array(qids[places]), pa.array(ids), pa.array(scores)], names=["qid", "id", "score"])


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


# fusion and reranking


def rrf(dense_hits: DataFrame, sparse_hits: DataFrame, k: int = 60, top_k: int | None = 30) -> DataFrame:
    """Reciprocal-rank fusion: (qid, id, score, rank, best_rank, source). Ties go by best rank, then id."""
    parts = [hits.select("qid", "id", "rank", F.lit(name).alias("source"), F.lit(n).alias("n")) for n, (name, hits) in enumerate((("dense", dense_hits), ("bm25", sparse_hits)))]
    both = parts[0].unionByName(parts[1])
    fused = both.groupBy("qid", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"), F.min_by("source", F.struct("rank", "n")).alias("source"))
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "best_rank", "id")
    out = fused.withColumn("rank", F.row_number().over(w))
    return out if top_k is None else out.filter(F.col("rank") <= top_k)


def overlap_score(query: Column, passage: Column) -> Column:
    """Share of the query's distinct white-space words that the passage holds; 0 if either has none."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""))
    q, p = words(query), words(passage)
    return F.when((F.size(q) > 0) & (F.size(p) > 0), F.size(F.array_intersect(q, p)) / F.size(q)).otherwise(F.lit(0.0))


def reranked(candidates: DataFrame, queries: DataFrame, passages: DataFrame, scorer=overlap_score) -> DataFrame:
    """Candidates (qid, id) scored by (query text, passage text); scorer is any Column function, a pandas UDF too.

    Passages stay where they are read while the candidates are few enough to go to them.
    """
    asked = shared.few(candidates.select("qid", "id").join(shared.few(queries.select("qid", F.col("text").alias("query"))), "qid"))
    both = passages.select("id", F.col("text").alias("passage")).join(asked, "id")
    return ranked(both.select("qid", "id", scorer(F.col("query"), F.col("passage")).alias("score")))


def bad_scores(scored: DataFrame) -> DataFrame:
    """Scores that are null or not finite: they make a reranking fail."""
    s = F.col("score")
    return scored.filter(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")))


def reranked_or_fused(fused: DataFrame, scored: DataFrame) -> DataFrame:
    """Per query the reranked order, or the fused one with RERANK_UNAVAILABLE where scores are missing or not finite."""
    joined = fused.select("qid", "id", F.col("score").alias("fused_score"), F.col("rank").alias("fused_rank")).join(scored.select("qid", "id", "score"), ["qid", "id"], "left")
    s = F.col("score")
    failed = joined.groupBy("qid").agg(F.max((s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).cast("int")).alias("failed"))
    both = joined.join(failed, "qid").withColumn("score", F.when(F.col("failed") == 1, -F.col("fused_rank").cast("double")).otherwise(s))
    out = ranked(both)
    score = F.when(F.col("failed") == 1, F.col("fused_score")).otherwise(F.col("score"))
    reasons = F.when(F.col("failed") == 1, F.array(F.lit("RERANK_UNAVAILABLE"))).otherwise(F.array().cast("array<string>"))
    return out.select("qid", "id", score.alias("score"), "rank", reasons.alias("degraded_reasons"))


# selection


def balanced(n_documents: int, top_k: int) -> bool:
    """Only an explicit scope of 2 to top_k documents is balanced."""
    return 1 < n_documents <= top_k


def with_document_firsts(hits: DataFrame, k: int, balance: DataFrame) -> DataFrame:
    """The first k hits, and the first hit of each document of the balance (qid, document_id) that they lack."""
    w = Window.partitionBy("qid", "document_id").orderBy("rank")
    placed = hits.withColumn("document_rank", F.row_number().over(w))
    wanted = balance.select("qid", "document_id").distinct().withColumn("balanced", F.lit(True))
    out = placed.join(wanted, ["qid", "document_id"], "left")
    return out.filter((F.col("rank") <= k) | ((F.col("document_rank") == 1) & F.col("balanced"))).drop("document_rank", "balanced")


def without_repeats(hits: DataFrame, by_document: bool = False) -> DataFrame:
    """Adds reason and owner: a repeated chunk, or repeated content, names the chunk that stays before it.

    Content repeats over everything, or, when balanced, within a document, version and table.
    """
    w = Window.partitionBy("qid", "id").orderBy("rank")
    own = ["qid", "content_hash", *(["document_id", "version_id", "table_id"] if by_document else [])]
    first = hits.withColumn("n", F.row_number().over(w))
    content = Window.partitionBy(*own, (F.col("n") == 1)).orderBy("rank")
    out = first.withColumn("m", F.row_number().over(content)).withColumn("owner", F.first("id").over(content))
    reason = F.when(F.col("n") > 1, F.lit("duplicate_chunk")).when(F.col("m") > 1, F.lit("duplicate_hash"))
    owner = F.when(F.col("n") > 1, F.col("id")).when(F.col("m") > 1, F.col("owner"))
    return out.withColumn("reason", reason).withColumn("owner", owner).drop("n", "m")


def select_evidence(hits: DataFrame, top_k: int, balance: DataFrame | None = None) -> DataFrame:
    """The legacy policy: hits without repeats, cut at top_k; when balanced, each document's best hit is kept first.

    hits: (qid, id, rank, content_hash, document_id, version_id, table_id). Returns the kept rows
    with position, in rank order.
    """
    kept = without_repeats(hits, balance is not None).filter("reason is null").drop("reason", "owner")
    if balance is not None:
        doc = Window.partitionBy("qid", "document_id").orderBy("rank")
        kept = kept.withColumn("late", (F.row_number().over(doc) > 1).cast("int"))
    else:
        kept = kept.withColumn("late", F.lit(0))
    fill = Window.partitionBy("qid").orderBy("late", "rank")
    out = kept.withColumn("fill", F.row_number().over(fill)).filter(F.col("fill") <= top_k).drop("late", "fill")
    return out.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))


def select_covering(hits: DataFrame, top_k: int) -> DataFrame:
    """The coverage policy: also drops a hit whose table cells are all among those of kept hits of its table.

    What is kept depends on what was kept before, so a fold runs over each query's ranked list,
    which the candidate pool bounds. hits has cell_ids array<string> (empty: no cells).
    """
    row = F.struct("rank", "id", "content_hash", "document_id", "table_id", "cell_ids")
    lists = hits.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = "array<struct<rank:int,id:bigint,content_hash:string,document_id:string,table_id:string,cell_ids:array<string>>>"
    text = "array<string>"
    start = F.struct(F.array().cast(kind).alias("kept"), F.array().cast(text).alias("hashes"), F.array().cast(text).alias("cells"))

    def step(s: Column, r: Column) -> Column:
        own = F.transform(r["cell_ids"], lambda c: F.concat_ws("/", r["table_id"], c))
        seen = F.exists(s["kept"], lambda x: x["id"] == r["id"]) | F.array_contains(s["hashes"], r["content_hash"])
        covered = (F.size(own) > 0) & (F.size(F.array_except(own, s["cells"])) == 0)
        put = F.struct(F.concat(s["kept"], F.array(r.cast(kind[6:-1]))).alias("kept"), F.concat(s["hashes"], F.array(r["content_hash"])).alias("hashes"), F.concat(s["cells"], own).alias("cells"))
        return F.when(seen | covered | (F.size(s["kept"]) >= top_k), s).otherwise(put)

    chosen = lists.select("qid", F.posexplode(F.aggregate(F.col("rows").cast(kind), start, step, lambda s: s["kept"])).alias("p", "r"))
    return chosen.select("qid", "r.id", "r.rank", (F.col("p") + 1).alias("position"))


def evidence_candidates(chunks: DataFrame) -> DataFrame:
    """Table id (parent chunk, else element) and cell ids (row and group chunks only) of chunks."""
    cells = F.when(F.col("chunk_subtype").isin("table_row", "table_group"), F.coalesce("cell_ids", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return chunks.withColumn("table_id", F.coalesce("parent_chunk_id", "element_id")).withColumn("cell_ids", cells)


def citation_kind(kind: Column, subtype: Column, cell_ids: Column) -> Column:
    """A raw table text without cells is cited as such."""
    return F.when((subtype == "table_raw_text") & (F.size(cell_ids) == 0), F.lit("table_raw_text")).otherwise(kind)


def incomplete_table_sources(sources: DataFrame) -> DataFrame:
    """Cited table sources that lack an element, cells, boxes or pages."""
    need = F.col("element_id").isNotNull() & (F.size("cell_ids") > 0) & (F.size("bboxes") > 0) & F.col("page_start").isNotNull() & F.col("page_end").isNotNull()
    return sources.filter((F.col("element_kind") == "table") & ~F.coalesce(need, F.lit(False)))


def trace(**stages: DataFrame) -> DataFrame:
    """All stages in long form: (qid, stage, rank, id, score)."""
    out = None
    for name, hits in stages.items():
        part = hits.select("qid", F.lit(name).alias("stage"), F.col("rank").cast("int").alias("rank"), "id", "score")
        out = part if out is None else out.unionByName(part)
    return out
