"""Indexes as tables: postings and statistics for BM25, normalised vectors, snapshots.

Postings and statistics are aggregations by term and by document with partial sums on the map
side; nothing is collected but the one row of corpus statistics, which is joined as a row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark import shared
from siftspark.functions import text as T


@dataclass
class SparseIndex:
    """postings(id, term, tf, dl), documents(id, dl), terms(term, df, idf), corpus(n_docs, avgdl): one row."""

    postings: DataFrame
    documents: DataFrame
    terms: DataFrame
    corpus: DataFrame

    def write(self, path: str) -> None:
        for name in ("postings", "documents", "terms", "corpus"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SparseIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "documents", "terms", "corpus")))


def tokenised(documents: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, terms): the tokens of each document, in order."""
    return documents.select(F.col(id_col).alias("id"), T.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))


def postings(documents: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, dl); a document without tokens has no posting."""
    return counted(tokenised(documents, id_col, text_col))


def counted(tokens: DataFrame) -> DataFrame:
    found = tokens.select("id", F.size("terms").cast("long").alias("dl"), F.explode("terms").alias("term"))
    return found.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")).select("id", "term", "tf", "dl")


def document_stats(documents: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, dl): the number of tokens, 0 included. No shuffle."""
    return lengths(tokenised(documents, id_col, text_col))


def lengths(tokens: DataFrame) -> DataFrame:
    return tokens.select("id", F.size("terms").cast("long").alias("dl"))


def term_stats(posted: DataFrame) -> DataFrame:
    """(term, df); postings are distinct by id and term, so a count is enough."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def build_sparse(documents: DataFrame, id_col: str = "id", text_col: str = "text") -> SparseIndex:
    """The index of documents. Texts are tokenised once: tokens and postings go to the shared folder, what follows from them is read off there."""
    tokens = shared.stored(tokenised(documents, id_col, text_col), "tokens")
    return from_parts(shared.stored(counted(tokens), "postings"), lengths(tokens))


def from_parts(posted: DataFrame, docs: DataFrame) -> SparseIndex:
    """An index of stored postings and document lengths."""
    corpus = corpus_stats(docs)
    # one row on the right: a broadcast of bounded size
    terms = term_stats(posted).join(F.broadcast(corpus)).select("term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    return SparseIndex(posted, docs, terms, corpus)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def l2_normalised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) with unit length; zero vectors and null ones are left out (see zero_vectors)."""
    length = norm(F.col(vector_col))
    return vectors.filter(length > 0).select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double") / length).alias("vector"))


def zero_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int | None = None) -> DataFrame:
    """Violations: ZERO_VECTOR, and DIMENSION_MISMATCH where a dimension is given."""
    code = F.when(F.coalesce(norm(F.col(vector_col)), F.lit(0.0)) == 0, F.lit("ZERO_VECTOR"))
    if dim is not None:
        code = F.when(F.coalesce(F.size(vector_col), F.lit(0)) != dim, F.lit("DIMENSION_MISMATCH")).otherwise(code)
    return vectors.select(F.col(id_col).alias("id"), code.alias("code")).filter("code is not null")


def spaced_words(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, words): the lower-case white-space tokens of texts, an empty one too where a text starts or ends with space."""
    shared.bounded_batches(texts.sparkSession)
    return texts.select(F.col(id_col).alias("id"), F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+").alias("words"))


def unit_counts(batches: Iterator[pa.RecordBatch], dim: int = 64) -> Iterator[pa.RecordBatch]:
    """(id, vector) of batches of spaced_words. A token's bucket is md5(token) mod dim, which the last byte tells, found once a batch for each token."""
    for b in batches:
        found = b.column("words")
        coded = found.flatten().dictionary_encode()
        tokens = coded.dictionary.cast(pa.binary()).to_pylist()
        bucket = np.array([hashlib.md5(w, usedforsecurity=False).digest()[-1] & (dim - 1) if w else -1 for w in tokens], np.int64)[coded.indices.to_numpy()]
        rows = np.repeat(np.arange(b.num_rows), np.diff(found.offsets.to_numpy()))
        counts = np.bincount((rows * dim + bucket)[bucket >= 0], minlength=b.num_rows * dim).reshape(b.num_rows, dim).astype(float)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = counts / np.where(length > 0, length, 1)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dim, pa.int32()), pa.array(unit.ravel()))], names=["id", "vector"])


def hashed_vectors(texts: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = 64) -> DataFrame:
    """(id, vector array<double>): a deterministic bag-of-words vector of unit length, zero for a text without words. No shuffle.

    dim is a power of two up to 256.
    """
    if dim & (dim - 1) or not 0 < dim <= 256:
        raise ValueError("dim is a power of two up to 256")
    rows = spaced_words(texts, id_col, text_col)
    return rows.mapInArrow(lambda batches: unit_counts(batches, dim), f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>")


def hashed_embeddings(texts: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = 64) -> DataFrame:
    """(id, bucket, weight): hashed_vectors in long form, without the zeros."""
    spread = hashed_vectors(texts, id_col, text_col, dim).select("id", F.posexplode("vector").alias("bucket", "weight"))
    return spread.filter("weight > 0")


def allocate_ids(chunks: DataFrame, order: list[str], id_col: str = "index_id") -> DataFrame:
    """Gives rows without an id the numbers after the largest one, in order.

    Numbers within a range partition follow from the sizes of those before it, so no task sees
    all rows. A largest id of 0 counts as one.
    """
    new = chunks.filter(F.col(id_col).isNull())
    top = chunks.agg(F.coalesce(F.max(id_col), F.lit(-1)).alias("top"))
    # stored, as two branches read it and partitions must be the same in both
    placed = shared.stored(new.drop(id_col).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "placed")
    ranked = placed.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    done = ranked.join(F.broadcast(before), "part").join(F.broadcast(top)).withColumn(id_col, (F.col("top") + F.col("before") + F.col("n")).cast("long"))
    return chunks.filter(F.col(id_col).isNotNull()).unionByName(done.drop("part", "n", "before", "top").select(chunks.columns))


def snapshot_corpus(documents: DataFrame, versions: DataFrame, chunks: DataFrame, signature: str, pending: str | None = None) -> DataFrame:
    """Indexable chunks of ready documents' ready active versions with one embedding signature, and of the pending version."""
    own = F.col("v.version_id")
    active = (F.col("d.status") == "READY") & (F.col("v.status") == "READY") & (F.col("d.active_version_id") == own)
    wanted = active | (own == F.lit(pending)) if pending else active
    chosen = documents.alias("d").join(versions.alias("v"), F.col("d.document_id") == F.col("v.document_id")).filter(wanted & (F.col("v.embedding_signature") == signature)).select(own.alias("version_id"))
    return chunks.join(chosen, "version_id", "left_semi").filter(indexable())


def indexable() -> Column:
    """Not a table's parent chunk, nor code that is kept out of the index."""
    return (F.coalesce("chunk_subtype", F.lit("")) != "table_parent") & ~F.coalesce("code_not_add_index", F.lit(False))


def embedding_signature(model: str, revision: str, dim: int, normalise: bool, query_prefix: str, passage_prefix: str, pooling: str) -> str:
    parts = [model, revision, str(dim), str(normalise).lower(), query_prefix, passage_prefix, pooling]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parser_signature(parser_id: str, version: str, models: dict | None = None, revisions: dict | None = None, options: dict | None = None) -> str:
    body = {"parser_id": parser_id, "parser_version": version, "model_ids": models or {}, "model_revisions": revisions or {}, "options": options or {}, "ir_schema_version": 2, "normalizer": "unicode-v2"}
    return hashlib.sha256(canonical_json(body).encode()).hexdigest()


def version_map(chunks: DataFrame) -> DataFrame:
    """(document_id, version_id) of a snapshot's chunks: a table that goes with its manifest."""
    return chunks.select("document_id", "version_id").distinct()


def _digest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows, and a digest of them as a set: sums of parts of each row's SHA-256, which no order changes."""
    whole = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in rows.columns])), 256)
    sums = [F.sum(F.conv(F.substr(whole, F.lit(15 * k + 1), F.lit(15)), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    found = rows.agg(F.count("*").alias("n"), *sums).first()
    return found.n, hashlib.sha256(" ".join(str(found[f"s{k}"] or 0) for k in range(4)).encode()).hexdigest()


def manifest(chunks: DataFrame, signature: str, dim: int) -> dict:
    """Counts of a snapshot, a digest of its version map (a table of its own) and a hash of them all."""
    versions, digest = _digest(version_map(chunks))
    body = {"chunk_count": chunks.count(), "signature": signature, "dimension": dim, "versions": versions, "versions_digest": digest}
    return body | {"hash": hashlib.sha256(canonical_json(body).encode()).hexdigest()}


def manifest_problems(made: dict, chunks: DataFrame, vectors: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Codes of what a snapshot's manifest and its tables, the version map among them if given, disagree on."""
    spark = chunks.sparkSession
    body = {k: v for k, v in made.items() if k not in ("hash", "created_at")}
    found = [] if hashlib.sha256(canonical_json(body).encode()).hexdigest() == made.get("hash") else [("HASH_MISMATCH", 1)]
    count = chunks.count()
    if count != made.get("chunk_count"):
        found.append(("COUNT_MISMATCH", abs(count - made.get("chunk_count", 0))))
    if versions is not None and _digest(versions.select("document_id", "version_id")) != (made.get("versions"), made.get("versions_digest")):
        found.append(("VERSIONS_MISMATCH", 1))
    missing = chunks.join(vectors.select(F.col("id").alias("index_id")), "index_id", "left_anti").count()
    if missing:
        found.append(("VECTOR_MISSING", missing))
    return spark.createDataFrame(found, "code string, n long")


def activate(spark: SparkSession, root: str, snapshot: str) -> None:
    """Moves a finished build to the versions and points to it; readers see the old pointer until the last rename."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(conf)
    fs.mkdirs(path(f"{root}/versions"))
    if not fs.rename(path(f"{root}/_building/{snapshot}"), path(f"{root}/versions/{snapshot}")):
        raise FileNotFoundError(f"no finished build of {snapshot}")
    new, now = path(f"{root}/_pointer"), path(f"{root}/pointer")
    out = fs.create(new, True)
    out.write(bytearray(snapshot.encode()))
    out.close()
    fs.delete(now, False)
    fs.rename(new, now)


def active_snapshot(spark: SparkSession, root: str) -> str | None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    now = jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    if not now.getFileSystem(conf).exists(now):
        return None
    return spark.read.text(f"{root}/pointer").first()[0]


def contains_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(vectors.select("id"), "id", "left_semi")
