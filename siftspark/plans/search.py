"""Hybrid search of a batch of queries, from texts to selected evidence, with every stage kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark import shared
from siftspark.config import RetrievalConfig
from siftspark.operators import indexing, retrieval
from siftspark.operators.segments import Index


def files_digest(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files: another digest is another table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def corpus_index(spark: SparkSession, d: str, name: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of a table's texts, in the shared folder. The first search over the table writes it; later ones open it."""
    index = Index(spark, f"{shared.shared_dir(spark)}/index-{name}-{files_digest(spark, f'{d}/{name}.parquet')}")
    if not index.state.version:
        index.add(shared.spread(spark.read.parquet(f"{d}/{name}.parquet")), "all", id_col, text_col)
    return index


def hashed_dense(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """The best k inner products of hashed bag-of-words vectors, of those above zero: (qid, id, score, rank)."""
    asked = indexing.hashed_vectors(queries, "qid", "text").withColumnRenamed("id", "qid")
    return retrieval.dense(asked, indexing.spaced_words(documents, "id", "text"), k, made=indexing.unit_counts).filter("score > 0")


def stages(queries: DataFrame, documents: DataFrame, index: Index, cfg: RetrievalConfig | None = None, scope: DataFrame | None = None) -> dict[str, DataFrame]:
    """dense, bm25, fused, reranked and selected results of queries (qid, text) over documents (id, text), which the index holds.

    Each stage has some rows per query; it is stored, so that what reads several stages computes each once.
    """
    cfg = cfg or RetrievalConfig()
    own = documents if scope is None else documents.join(scope.select("id"), "id", "left_semi")
    dense = shared.stored(hashed_dense(queries, own, cfg.dense_top_k), "dense")
    sparse = shared.stored(index.search(queries, cfg.sparse_top_k, cfg.k1, cfg.b, cfg.minimum_should_match, scope), "sparse")
    fused = shared.stored(retrieval.rrf(dense, sparse, cfg.rrf_k, cfg.fused_top_k), "fused")
    again = shared.stored(retrieval.reranked(fused, queries, documents), "reranked")
    texts = documents.join(shared.few(again.select("id").distinct()), "id").select("id", F.sha2("text", 256).alias("content_hash"))
    hits = again.join(texts, "id").select("qid", "id", "rank", "score", "content_hash", F.col("id").cast("string").alias("document_id"), F.lit("").alias("version_id"), F.lit("").alias("table_id"))
    return {"dense": dense, "bm25": sparse, "fused": fused, "reranked": again, "selected": retrieval.select_evidence(hits, cfg.top_k)}


def search(queries: DataFrame, documents: DataFrame, index: Index, cfg: RetrievalConfig | None = None) -> DataFrame:
    """(qid, position, id, score): the evidence of each query."""
    return stages(queries, documents, index, cfg)["selected"].select("qid", "position", "id", "score")


def gold(queries: DataFrame, documents: DataFrame, id_col: str = "id") -> DataFrame:
    """(qid, id): documents that hold a query's whole text.

    Texts are compared only where a run of words is shared: up to five words of a query, its
    first and last apart, which may be parts of words in a document, against all runs of so many
    words of the documents, an equi-join. Queries of one or two words, which have no such run
    (a bounded number of them a block), are looked for in every document.
    """
    words = F.filter(F.split("text", "[ \n]"), lambda w: w != "")
    head = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    q = queries.select("qid", F.col("text").alias("quote"), words.alias("w")).withColumn("n", F.least(F.lit(5), F.size("w") - 2))
    keyed = shared.stored(q.filter("n > 0").select("qid", "quote", "n", F.xxhash64(head(F.lit(2), F.col("n"))).alias("key")), "quotes")
    near = None
    for (n,) in keyed.select("n").distinct().collect():  # five numbers at most
        d = documents.select("id", words.alias("w"), F.lit(n).alias("n")).filter("size(w) >= n")
        runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.xxhash64(head(i, F.col("n"))))
        d = d.select("id", F.explode(F.array_distinct(runs)).alias("key"))
        part = d.join(shared.few(keyed.filter(F.col("n") == n).drop("n")), "key").select("qid", "id", "quote").distinct()
        near = part if near is None else near.unionByName(part)
    texts = documents.select("id", "text")
    bare = q.filter("n <= 0").select("qid", "quote").distinct()
    out = None if near is None else texts.join(shared.few(shared.stored(near, "near")), "id").filter(F.contains("text", "quote")).select("qid", "id")
    for block in _blocks(bare):
        held = F.array(*[F.struct(F.lit(qid).alias("qid"), F.lit(quote).alias("quote")) for qid, quote in block])
        part = texts.select("id", F.explode(F.filter(held, lambda x: F.contains(F.col("text"), x["quote"]))).alias("x")).select("x.qid", "id")
        out = part if out is None else out.unionByName(part)
    return texts.select(F.lit(0).cast("long").alias("qid"), "id").limit(0) if out is None else out


def _blocks(bare: DataFrame, most: int = 256) -> Iterator[list[tuple]]:
    """Very short queries, some at a time."""
    held: list[tuple] = []
    for r in bare.toLocalIterator():
        held.append((r.qid, r.quote))
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


def best_of_documents(hits: DataFrame) -> DataFrame:
    w = Window.partitionBy("qid", "document_id").orderBy("rank")
    return hits.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
