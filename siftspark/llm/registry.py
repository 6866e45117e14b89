"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftspark import shared
from siftspark.llm import bpe_chunks, decontaminate, embedding_dedup, html_extract, language_id, lexical_search, line_dedup, minhash_docs, mixing, oracles, phrases, storage, substring_dedup, token_files, toxicity

#: What a query returns, where its operator returns more.
HIT_COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is read; texts in fewer pieces than there are cores are dealt out to all."""
    storage.bounded_batches(spark)
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return shared.spread(found) if name in ("documents", "pages") else found


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.sample(documents, table(spark, sf_dir, "labels")))
    return toxicity.scored(documents, model)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_minhash_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_docs.grouped(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.scanned(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(HIT_COLUMNS)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 with all its evidence: markup, address and host of web pages."""
    return language_id.identified_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extract, op2_line_dedup, op3_toxicity, op4_token_files, op5_minhash_docs, op6_embedding_dedup, op7_substring_dedup, op8_decontaminate, op9_language_id, pages_language_id, op10_bpe_chunks, op11_mixing, op12_phrases, op13_lexical_search)}


oracle_sql = oracles.oracle_sql
