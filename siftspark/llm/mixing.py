"""Mixing of sources to target weights.

One aggregation counts the words of each source. Sources share all words by weight; no target
exceeds ``most`` times its source's size, and what that leaves over is shared again by weight
among the others, which is a level that rises until no further source is above its limit. The
repetition rate of a source is target / size: each document is taken floor(rate) times, and
once more with a probability of the rate's fraction, by a draw seeded by its id. A draw is one
of eight independent 32-bit numbers in the SHA-256 of the id; each source uses the one whose
taken words come nearest its target, which one aggregation over the sizes tells.

Defined results: null and empty texts have size 0 and rates as their source's other texts; a
null source is a source of its own, last in order; a source without words has the target 0 and
rate 0; rows that repeat, and rows that share an id (null included), share a draw; an empty
table gives an empty result; other columns are kept by ``mixed``, whatever their names.
Texts are never shuffled: sizes are, and rates go to the texts by a broadcast after a check of
their number, else by a join whose hot sources Spark may split.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark import shared
from siftspark.llm import storage

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No target is more than so many times its source's size.
MOST = 3
#: Independent draws in a SHA-256 of 64 hexadecimal digits, 8 digits each.
DRAWS, DIGITS = 8, 8

_WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Number of runs of anything but space and \\x09-\\x0D; 0 for null. Each run becomes one letter, so no array of words is built."""
    runs = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(runs, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def in_order(sources: DataFrame) -> DataFrame:
    """Adds ``place``: the source's rank by code points from 0, null last. Ranges are sorted apart and shifted by the sizes of those before."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col("source").asc_nulls_last()
    ranged = storage.stored(sources.repartitionByRange(n, by).withColumn("range", F.spark_partition_id()), "sources")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("held"))  # one row a range
    before = sizes.withColumn("before", F.coalesce(F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("held")
    own = F.row_number().over(Window.partitionBy("range").orderBy(by))
    return ranged.join(F.broadcast(before), "range").withColumn("place", F.col("before") + own - 1).drop("range", "before")


def weighed(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight``: the given ones in order of the sources' names, repeating."""
    if not weights or min(weights) < 1 or any(w != int(w) for w in weights):
        raise ValueError("weights must be positive whole numbers")
    dealt = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    return in_order(sources).withColumn("weight", F.element_at(dealt, (F.col("place") % len(weights) + 1).cast("int"))).drop("place")


def source_sizes(sizes: DataFrame) -> DataFrame:
    """source and source_size of (source, size)."""
    return sizes.groupBy("source").agg(F.sum("size").alias("source_size"))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): a share of all words by weight, ``most`` times the size at the most.

    All sums are whole numbers, so the result doesn't depend on their order. A round is one
    aggregation over the sources; a source that is above its limit stays so as the level rises.
    """
    if most < 1:
        raise ValueError("a source must be allowed its own size at least")
    held = storage.stored(sources, "targets")
    limit = F.lit(most).cast("long") * F.col("source_size")

    def above(words: int, weight: int) -> Column:
        wide = lambda n: F.lit(Decimal(n)).cast(_WIDE)
        return F.col("weight").cast("decimal(19,0)") * wide(words) > limit.cast("decimal(19,0)") * wide(weight)

    found = held.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    total = words = int(found.words or 0)
    weight, known = int(found.weight or 0), -1
    while True:
        full = above(words, weight)
        now = held.agg(F.count_if(full).alias("full"), F.sum(F.when(full, limit)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if now.full == known or not now.weight:
            break
        known, words, weight = now.full, total - int(now.held or 0), int(now.weight)
    share = (F.col("weight").cast("decimal(19,0)") * F.lit(Decimal(words)).cast(_WIDE)).cast("double") / F.lit(float(weight or 1))
    return held.withColumn("target", F.when(above(words, weight), limit.cast("double")).otherwise(share))


def _digest(id_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 256)


def _draw(digest: Column, k: Column | int) -> Column:
    """The k-th number from 0 below 1 in a SHA-256."""
    start = k * DIGITS + 1
    digits = F.substr(digest, start if isinstance(start, Column) else F.lit(start), F.lit(DIGITS))
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 4 * DIGITS))


def rates(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source (source, source_size, target): ``whole`` copies of each document, the ``part`` of one more, and which ``draw`` decides.

    sizes: doc_id, source and size of each document.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = wanted.select("source", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part"))
    joined = _with_rates(sizes, rated.select(F.col("source").alias("own"), "part"))
    taken = joined.withColumn("digest", _digest("doc_id")).groupBy("source").agg(*[F.sum(F.when(_draw(F.col("digest"), k) < F.col("part"), F.col("size")).otherwise(0)).alias(f"taken{k}") for k in range(DRAWS)])
    open_words = F.col("target") - F.col("whole") * F.col("source_size")
    off = F.array(*[F.abs(F.col(f"taken{k}") - open_words) for k in range(DRAWS)])
    chosen = rated.join(taken.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).withColumn("draw", F.array_position(off, F.array_min(off)).cast("int") - 1)
    return storage.stored(chosen.select("source", "source_size", "target", "whole", "part", "draw"), "rates")


def _with_rates(rows: DataFrame, rated: DataFrame) -> DataFrame:
    return rows.join(shared.few(rated), F.col("source").eqNullSafe(F.col("own")))


def _copies(digest: Column) -> Column:
    return F.col("whole") + F.when(_draw(digest, F.col("draw")) < F.col("part"), 1).otherwise(0)


def _sized(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))


def planned(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Sizes of all documents and rates of all sources; both are stored."""
    sizes = storage.stored(_sized(documents, id_col, text_col, source_col), "sizes")
    return sizes, rates(sizes, targets(weighed(source_sizes(sizes), weights), most))


def mix_report(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, **columns: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source, copies and taken (words times copies)."""
    sizes, rated = planned(documents, weights, most, **columns)
    joined = _with_rates(sizes, rated.withColumnRenamed("source", "own"))
    return joined.select("doc_id", "size", "source_size", "target", _copies(_digest("doc_id")).alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves with all their columns, each as often as the mix takes it."""
    _, rated = planned(documents, weights, most, id_col, text_col, source_col)
    # a document's columns travel in one struct, so they can't clash with those of the rates
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document"), F.col(source_col).alias("source"), _digest(id_col).alias("digest"))
    joined = _with_rates(rows, rated.withColumnRenamed("source", "own"))
    return joined.select("document", F.explode(F.array_repeat(F.lit(0), _copies(F.col("digest")).cast("int")))).select("document.*")
