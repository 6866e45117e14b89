"""Sinks: parsed documents as JSON artefacts, staged, verified and activated by renaming."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators.indexing import canonical_json


def write_documents(parsed: DataFrame, path: str) -> None:
    """One JSON row per document with its hash; keys in the columns' order."""
    body = F.to_json(F.struct(*sorted(parsed.columns)))
    parsed.select("document_id", body.alias("body"), F.sha2(body, 256).alias("sha256")).write.parquet(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.parquet(path).select("document_id", F.from_json("body", schema).alias("d")).select("document_id", *[f"d.{c.split()[0]}" for c in schema.split(", ") if c.split()[0] != "document_id"])


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """Artefacts whose text no longer has its hash."""
    return spark.read.parquet(path).filter(F.sha2("body", 256) != F.col("sha256")).select("document_id")


class Artifacts:
    """Versions of parsed documents under a root: _building, versions, failed, quarantine."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _move(self, version: str, a: str, b: str) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/{b}"))
        if not self._fs.rename(self._path(f"{self.root}/{a}/{version}"), self._path(f"{self.root}/{b}/{version}")):
            raise FileNotFoundError(f"{a}/{version}")

    def versions(self) -> list[str]:
        """Names of the active versions, in order."""
        there = self._path(f"{self.root}/versions")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(there)) if self._fs.exists(there) else []

    def stage(self, parsed: DataFrame, version: str) -> None:
        """Writes and verifies; a damaged write goes to failed."""
        path = f"{self.root}/_building/{version}"
        write_documents(parsed, path)
        if damaged(self.spark, path).head(1):
            self._move(version, "_building", "failed")
            raise OSError(f"{version} was damaged in writing")

    def activate(self, version: str) -> str:
        self._move(version, "_building", "versions")
        return f"{self.root}/versions/{version}"

    def fail(self, version: str) -> None:
        self._move(version, "_building", "failed")

    def quarantine_orphans(self, known: set[str]) -> list[str]:
        """Moves versions that no row names; returns them, in order."""
        gone = [v for v in self.versions() if v not in known]
        for v in gone:
            self._move(v, "versions", "quarantine")
        return gone


def json_hash(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def document_markdown(elements: DataFrame, headings: bool = False) -> DataFrame:
    """(document_id, markdown): elements in reading order, a blank line between them; headings as # of level 2 to 6 if asked for."""
    level = F.least(F.greatest(F.size("section_path"), F.lit(2)), F.lit(6))
    text = F.when(F.col("kind").isin("heading", "title"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "text")).otherwise(F.col("text")) if headings else F.col("text")
    rows = elements.select("document_id", "reading_order", text.alias("t"))
    return rows.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "t"))), lambda x: x["t"]), "\n\n").alias("markdown"))
