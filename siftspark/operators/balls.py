"""Exact nearest neighbours among unit vectors with bounds from balls around pivots.

Each vector belongs to its nearest pivot; the vectors of a ball are cut, by their distance from the
pivot, into rings of a bounded number of rows. By the triangle inequality no vector of a ring
is nearer to a query than the query's distance from the pivot leaves it. A search visits the
rings that bound each query best first, and then only those whose bound is below the distance
of the k-th neighbour found so far. How much that saves depends on the vectors: those that lie in
clusters leave most rings unvisited, those spread evenly over many dimensions next to none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark import shared
from siftspark.operators import retrieval

PIVOTS, RING_ROWS = 64, 1024
#: Vectors among which pivots are chosen; any choice gives right results.
SAMPLE = 4096
#: Rings that a query visits first, and queries that one pass may broadcast.
FIRST, QUERY_BLOCK = 4, 1024
SLACK = 1e-9

_PLACED = "id long, vector array<double>, ball int, far double"
_RINGED = _PLACED + ", ring string"
_BOUNDS = "ring string, n long, q int, bound double"


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def pivots_of(vectors: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Vectors of a bounded sample, each next one the farthest from those before."""
    rows = np.array([r.vector for r in vectors.select("vector").orderBy(F.xxhash64("id")).limit(sample).collect()])
    if not len(rows):
        return np.zeros((0, 0))
    chosen, near = [0], _distances(rows, rows[:1])[:, 0]
    while len(chosen) < min(count, len(rows)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


@dataclass
class Balls:
    """vectors (id, vector, ball, far, ring) and rings (ring, ball, lo, hi, n) under some pivots."""

    pivots: np.ndarray
    vectors: DataFrame
    rings: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, count: int = PIVOTS, ring_rows: int = RING_ROWS) -> Balls:
        """vectors: (id, vector) of unit length and equal size."""
        spark = vectors.sparkSession
        rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        pivots = pivots_of(rows, count)
        held = spark.sparkContext.broadcast(pivots)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    d = _distances(_matrix(part.column("vector"), part.num_rows), held.value)
                    ball = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ball, pa.int32()), pa.array(d[np.arange(len(ball)), ball])], names=["id", "vector", "ball", "far"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task, ball, number, count = TaskContext.get().partitionId(), None, 0, 0
            for b in batches:
                names = []
                for x in b.column("ball").to_pylist():
                    if x != ball or count == ring_rows:
                        ball, number, count = x, number + 1, 0
                    count += 1
                    names.append(f"{task}-{number}")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string())], names=[*b.schema.names, "ring"])

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = shared.stored(rows.mapInArrow(place, _PLACED), "placed")
        # a ball of any size is several ranges
        ringed = shared.stored(placed.repartitionByRange(n, "ball", "far").sortWithinPartitions("ball", "far").mapInArrow(cut, _RINGED), "ringed")
        rings = ringed.groupBy("ring", "ball").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.count("*").alias("n"))
        return cls(pivots, ringed, shared.stored(rings, "rings"))

    def nearest(self, queries: DataFrame, k: int = 30) -> tuple[DataFrame, DataFrame]:
        """(qid, id, score, rank) as ``retrieval.dense`` gives them, and (qid, computed, n): distances computed, of how many."""
        spark = queries.sparkSession
        hits, visits = spark.createDataFrame([], "qid long, id long, score double"), spark.createDataFrame([], "qid long, computed long")
        total = self.rings.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        if total:
            for qids, matrix in retrieval._query_blocks(queries, QUERY_BLOCK):
                found, seen = self._block(qids, matrix, k)
                hits, visits = hits.unionByName(found), visits.unionByName(seen)
        return retrieval.ranked(hits, k), visits.groupBy("qid").agg(F.sum("computed").alias("computed"), F.lit(total).alias("n"))

    def _block(self, qids: np.ndarray, matrix: np.ndarray, k: int) -> tuple[DataFrame, DataFrame]:
        spark = self.vectors.sparkSession
        held = spark.sparkContext.broadcast((qids, matrix, _distances(matrix, self.pivots)))

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = held.value[2]
            for b in batches:
                ball, lo, hi = (b.column(c).to_numpy() for c in ("ball", "lo", "hi"))
                low = np.maximum(0.0, np.maximum(d[:, ball] - hi, lo - d[:, ball]))
                q, r = np.indices(low.shape)
                at = pa.array(r.ravel())
                yield pa.RecordBatch.from_arrays([b.column("ring").take(at), b.column("n").take(at), pa.array(q.ravel(), pa.int32()), pa.array(low.ravel())], names=["ring", "n", "q", "bound"])

        pairs = shared.stored(self.rings.mapInArrow(bounds, _BOUNDS).withColumn("order", F.row_number().over(retrieval.Window.partitionBy("q").orderBy("bound", "ring"))), "bounds")
        first = pairs.filter(F.col("order") <= FIRST)
        found = shared.stored(self._visited(first, held, k), "first")
        # the k-th neighbour so far; without k of them every ring is open
        last = retrieval.ranked(found, k).filter(F.col("rank") == k).select("qid", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("reach"))
        names = spark.createDataFrame([(i, int(q)) for i, q in enumerate(qids)], "q int, qid long")
        reach = F.broadcast(names.join(last, "qid", "left").select("q", "reach"))
        open_ = pairs.filter(F.col("order") > FIRST).join(reach, "q").filter(F.col("reach").isNull() | (F.col("bound") <= F.col("reach") + SLACK)).drop("reach")
        rest = shared.stored(open_, "open")
        seen = first.select("q", "n").unionByName(rest.select("q", "n")).groupBy("q").agg(F.sum("n").alias("computed")).join(F.broadcast(names), "q").select("qid", "computed")
        return found.unionByName(self._visited(rest, held, k)), seen

    def _visited(self, pairs: DataFrame, held, k: int) -> DataFrame:
        """The best k of each task for the queries that visit its rings."""
        asked = shared.few(pairs.groupBy("ring").agg(F.collect_list("q").alias("qs")))
        rows = self.vectors.select("ring", "id", "vector").join(asked, "ring")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, matrix, _ = held.value
            best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in qids]
            for b in batches:
                names = np.array(b.column("ring").to_pylist(), object)
                for at in np.split(np.arange(b.num_rows), np.flatnonzero(names[1:] != names[:-1]) + 1) if b.num_rows else []:
                    part = b.slice(int(at[0]), len(at))
                    qs, ids = part.column("qs")[0].values.to_numpy(), part.column("id").to_numpy()
                    scores = matrix[qs] @ _matrix(part.column("vector"), part.num_rows).T
                    for q, own in zip(qs.tolist(), scores, strict=True):
                        s, i = np.concatenate((best[q][0], own)), np.concatenate((best[q][1], ids))
                        order = np.lexsort((i, -np.round(s, 9)))[:k]
                        best[q] = s[order], i[order]
            sizes = [len(s) for s, _ in best]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, sizes)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["qid", "id", "score"])

        return rows.mapInArrow(run, "qid long, id long, score double")
