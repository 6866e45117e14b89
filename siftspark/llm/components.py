"""Connected components of a table of links: distributed union-find by alternating stars.

Each partition first contracts its own links (a local union-find, which leaves at most one link
per node), then large and small stars alternate until nothing changes: every node of a
component ends up linked to its smallest node, in a number of rounds that grows with the
logarithm of the component's diameter. Every round is written to the shared folder, so lost
executors repeat one round at most; no link ever goes to the driver. The smallest neighbours
are sums by key with partial aggregation, and what joins them to the links is a join whose
large partitions Spark may split, so a node with very many links is no bottleneck.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import storage

#: Links that a task contracts at a time.
LOCAL_LINKS = 1 << 18


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that isn't its set's smallest, and that smallest node."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)  # nodes are in order, so the smaller place is the smaller node
    root = np.fromiter((find(x) for x in range(len(nodes))), np.int64, len(nodes))
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _contracted(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def out() -> pa.RecordBatch:
            pairs = np.concatenate(held, axis=1)
            hi, lo = contract(pairs[0], pairs[1])
            return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], names=["hi", "lo"])

        for b in batches:
            held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
            count += b.num_rows
            if count >= LOCAL_LINKS:
                yield out()
                held, count = [], 0
        if held:
            yield out()

    return links.mapInArrow(run, "hi long, lo long")


def _stars(links: DataFrame) -> DataFrame:
    """One large star and one small star over links (hi, lo), hi > lo."""
    both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("u"), F.least("hi", "m").alias("m"))
    large = both.join(least, both.hi == least.u).filter("lo > hi and lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    large = large.distinct()
    least = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "u")
    small = large.join(least, large.hi == least.u).filter("lo <> m").select(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo"))
    return small.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node and component (its smallest node) for every node that has a link to another one. Links with a null side are none."""
    pairs = links.select(F.greatest(u, v).cast("long").alias("hi"), F.least(u, v).cast("long").alias("lo")).filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("hi") > F.col("lo")))
    now = storage.stored(_contracted(pairs), "links")
    before = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("s")).first()
        if not found.n or found == before:
            break
        before = found
        after = storage.stored(_stars(now), "links")
        storage.drop(now)
        now = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
