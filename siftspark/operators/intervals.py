"""Joins of intervals of whole numbers by bins, whatever their lengths and however many share a key.

An interval of a length up to 2**n lies in two bins of width 2**n at most. Two intervals meet in the
bins of the longer one's width, so each is placed in bins of its own width and of the wider ones that the
other side has: two rows a width, some dozen widths. A pair is kept in the first bin that both share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(start: Column, end: Column) -> Column:
    """The least n with end - start < 2**n."""
    return F.when(end == start, 0).otherwise(F.length(F.bin(end - start)))


def _bin(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x.cast("long"), level)


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal keys whose closed ranges [start, end] share a number; other columns must differ in name.

    A null end, or an end before its start, meets nothing.
    """
    a0, a1, b0, b1 = (F.col(c) for c in (*left_range, *right_range))
    sides = []
    for df, s, e in ((left, a0, a1), (right, b0, b1)):
        sides.append(df.filter(s <= e).withColumn("_level", _level(s, e)))
    levels = [sorted(r[0] for r in df.select("_level").distinct().collect()) for df in sides]  # 64 numbers at most
    placed = []
    for k, (df, s, e) in enumerate(((sides[0], a0, a1), (sides[1], b0, b1))):
        wider = F.filter(F.array(*[F.lit(n) for n in levels[1 - k]]).cast("array<int>"), lambda n: n > F.col("_level"))
        at = df.withColumn("_at", F.explode(F.concat(F.array(F.col("_level")), wider)))
        spots = F.sequence(_bin(s, F.col("_at")), _bin(e, F.col("_at")))
        at = at.withColumn("_bin", F.explode(spots)).withColumnRenamed("_level", f"_level{k}")
        placed.append(at)
    both = placed[0].join(placed[1], [*on, "_at", "_bin"])
    first = F.greatest(_bin(a0, F.col("_at")), _bin(b0, F.col("_at")))
    meet = (F.greatest("_level0", "_level1") == F.col("_at")) & (F.col("_bin") == first) & (a0 <= b1) & (b0 <= a1)
    return both.filter(meet).drop("_at", "_bin", "_level0", "_level1")
