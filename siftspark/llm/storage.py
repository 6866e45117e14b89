"""Where intermediate tables go: the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

from pyspark.sql import DataFrame

from siftspark import shared

shared_dir, bounded_batches, drop, BATCH_BYTES = shared.shared_dir, shared.bounded_batches, shared.drop, shared.BATCH_BYTES


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here and lost executors lose nothing."""
    bounded_batches(df.sparkSession)
    return shared.stored(df, name)


def small(ids: DataFrame, most: int = 200_000) -> DataFrame:
    """A table of a few numbers a row, written; if it has at most ``most`` rows (some MB) it is marked for a broadcast, else it is joined by a shuffle."""
    from pyspark.sql import functions as F

    kept = stored(ids, "small")
    return F.broadcast(kept) if kept.count() <= most else kept
