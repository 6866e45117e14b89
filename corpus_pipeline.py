"""The corpus pipeline over documents: each stage is written as Parquet and read again by the next.

Language identification drops what it rejects, line dedup cuts repeated lines from the texts,
MinHash near-dedup keeps one document of each group (five-word shingles, similarity 0.8),
benchmark decontamination drops documents with a benchmark passage, and the last stage encodes
and decodes what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import bpe_chunks, decontaminate, language_id, line_dedup, minhash_docs, registry, storage


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A text that lost lines gets a new n_chars; a document that lost all of them stays, empty."""
    out = line_dedup.deduplicated(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_docs.deduplicated(docs, shingle_words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.bounded_batches(spark)
    return decontaminate.decontaminated(docs, registry.table(spark, sf_dir, "benchmark"), remove="documents")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.bounded_batches(spark)
    return bpe_chunks.round_trip(docs, registry.tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_language),
    ("line_dedup", cut_lines),
    ("minhash_near_dedup", keep_one_of_group),
    ("decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = storage.stored(stage(spark, docs, sf_dir), name)
    return docs
