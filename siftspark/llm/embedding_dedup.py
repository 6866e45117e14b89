"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; the nearest
signed axis is its hash. A table's bucket joins ROTATIONS such hashes. Besides its home bucket
a vector is posted to the PROBES next likely ones (multiprobe); two vectors are compared where
one is at home and the other one home or posted. Every candidate pair is verified by its cosine
in double precision. A pair that meets in several buckets counts in the first only, which both
vectors' codes tell, so no pair is ever written out: a bucket gives each vector's number of
links there and a spanning forest of its links.

Equal vectors of one label are one class from the start. A bucket of more than BLOCK classes is
cut into blocks, and each pair of blocks is work of its own.

Defined results: null labels, null or empty vectors, vectors with null or non-finite components
and zero vectors link with nothing; vectors of different lengths don't link; repeated rows link
with each other; each row gives one result row. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import storage
from siftspark.llm.components import components, contract
from siftspark.llm.minhash_docs import _runs

TABLES, ROTATIONS, PROBES = 4, 2, 3
BLOCK = 1024
_NEAREST = 4
_SEED = 977


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, scaled to keep lengths. Rows have a power of two values."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), -1, 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def codes(x: np.ndarray, tables: int = TABLES, rotations: int = ROTATIONS, probes: int = PROBES) -> np.ndarray:
    """Codes (rows, tables, 1 + probes), int64: the home bucket, then the likeliest others."""
    width = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, width - x.shape[1])))
    signs = np.random.Generator(np.random.PCG64(_SEED)).choice([-1.0, 1.0], (tables, rotations, 3, width))
    nearest = min(_NEAREST, width)
    choices = list(product(range(nearest), repeat=rotations))
    out = np.zeros((len(x), tables, 1 + probes), np.int64)
    for t in range(tables):
        code, loss = np.zeros((len(x), len(choices)), np.int64), np.zeros((len(x), len(choices)))
        for r in range(rotations):
            y = x
            for s in signs[t, r]:
                y = hadamard(y * s)
            order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :nearest]
            value = np.take_along_axis(y, order, 1)
            axis, size = 2 * order + (value < 0), np.abs(value)
            pick = [c[r] for c in choices]
            code = code * (2 * width) + axis[:, pick]
            loss += size[:, :1] - size[:, pick]
        best = np.argsort(loss, axis=1, kind="stable")[:, : 1 + probes]
        out[:, t] = np.take_along_axis(code, best, 1)
    return out


def _coded(classes: DataFrame, tables: int, probes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = [b""] * b.num_rows
            vectors = b.column("vector")
            sizes = vectors.value_lengths().to_numpy()
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                x = vectors.take(pa.array(at)).flatten().to_numpy().reshape(-1, n)
                for i, c in zip(at.tolist(), codes(x, tables, ROTATIONS, probes), strict=True):
                    out[i] = c.tobytes()
            raw = [v.values.to_numpy().tobytes() for v in vectors]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("rep", "cid", "label", "many")], pa.array(sizes, pa.int32()), pa.array(raw, pa.binary()), pa.array(out, pa.binary())], names=["rep", "cid", "label", "many", "dim", "raw", "codes"])

    return classes.mapInArrow(run, "rep long, cid long, label string, many long, dim int, raw binary, codes binary")


def _posts(coded: DataFrame, tables: int, probes: int) -> DataFrame:
    """(rep, cid, label, dim, t, code, home) for each bucket of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = tables * (1 + probes)
        for b in batches:
            code = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.int64)
            at = pa.array(np.repeat(np.arange(b.num_rows), each))
            t = np.tile(np.repeat(np.arange(tables), 1 + probes), b.num_rows)
            home = np.tile(np.arange(1 + probes) == 0, b.num_rows * tables)
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("rep", "cid", "label", "dim")], pa.array(t, pa.int32()), pa.array(code), pa.array(home)], names=["rep", "cid", "label", "dim", "t", "code", "home"])

    return coded.select("rep", "cid", "label", "dim", "codes").mapInArrow(run, "rep long, cid long, label string, dim int, t int, code long, home boolean")


def _meetings(a: np.ndarray, b: np.ndarray, t: int, code: int) -> np.ndarray:
    """For pairs with codes a and b (a is the smaller class): this bucket is the first in which they meet."""
    ab = (b == a[:, :, :1]).any(2)  # the home of a is a bucket of b
    ba = (a == b[:, :, :1]).any(2)
    first = (ab | ba).argmax(1)
    own = np.where(ab[:, t], a[:, t, 0], b[:, t, 0])
    return (ab | ba).any(1) & (first == t) & (own == code)


def _cells(rows: DataFrame, cosine: float, tables: int, probes: int) -> DataFrame:
    """For each cell: (rep, cid, links) of its classes and, with links null, forest links (rep, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches, "cell"):
            n = cell.num_rows
            x = np.frombuffer(b"".join(cell.column("raw").to_pylist()), np.float64).reshape(n, -1)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            c = np.frombuffer(b"".join(cell.column("codes").to_pylist()), np.int64).reshape(n, tables, 1 + probes)
            rep, cid, many = (cell.column(k).to_numpy() for k in ("rep", "cid", "many"))
            home, left, right = (cell.column(k).to_numpy(zero_copy_only=False) for k in ("home", "left", "right"))
            t, code = cell.column("t")[0].as_py(), cell.column("code")[0].as_py()
            links, us, vs = np.zeros(n, np.int64), [], []
            rights = np.flatnonzero(right)
            lefts = np.flatnonzero(left)
            for k in range(0, len(lefts), 128):
                i = lefts[k : k + 128]
                a, b = np.nonzero(x[i] @ x[rights].T >= cosine)
                a, b = i[a], rights[b]
                # where both sides are one block each pair is seen twice
                ok = (home[a] | home[b]) & ((cid[a] != cid[b]) | (rep[a] != rep[b])) & ~(right[a] & left[b] & (a > b))
                a, b = a[ok], b[ok]
                swap = (cid[a] > cid[b]) | ((cid[a] == cid[b]) & (rep[a] > rep[b]))
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                first = _meetings(c[a], c[b], t, code)
                a, b = a[first], b[first]
                np.add.at(links, a, many[b])
                np.add.at(links, b, many[a])
                us.append(rep[a])
                vs.append(rep[b])
            some = np.flatnonzero(links)
            hi, lo = contract(np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((rep[some], hi))), pa.array(np.concatenate((cid[some], lo))), pa.array(np.concatenate((links[some], np.zeros(len(hi), np.int64))), mask=np.arange(len(some) + len(hi)) >= len(some))],
                names=["rep", "cid", "links"],
            )

    return rows.mapInArrow(run, "rep long, cid long, links long")


def linked(embeddings: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id (smallest id reachable) and kept, one row per row."""
    vector = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    valid = rows.filter(good)
    classes = valid.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")).withColumn("cid", F.xxhash64("label", "vector"))
    coded = storage.stored(_coded(classes.select("rep", "cid", "label", "many", "vector"), tables, probes), "coded")
    posts = _posts(coded, tables, probes)
    bucket = ["label", "dim", "t", "code"]
    sizes = posts.groupBy(*bucket).agg(F.count("*").alias("size"), F.max("home").alias("any")).filter("size > 1 and any").drop("any")
    members = posts.join(sizes, bucket).join(coded.select("rep", "cid", "many", "raw", "codes"), ["rep", "cid"])
    blocks = F.ceil(F.col("size") / block).cast("int")
    cells = members.withColumn("own", F.pmod(F.xxhash64("cid", "rep", "t"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = cells.select("rep", "cid", "many", "raw", "codes", "t", "code", "home", F.xxhash64(*bucket, F.least("own", "other"), F.greatest("own", "other")).alias("cell"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))
    found = storage.stored(_cells(cells.repartition("cell").sortWithinPartitions("cell"), cosine, tables, probes), "cells")
    counts = found.filter("links is not null").groupBy("rep", "cid").agg(F.sum("links").alias("links"))
    # rows with one id are one node, whatever their vectors
    groups = components(found.filter("links is null").select(F.col("rep").alias("u"), F.col("cid").alias("v")).unionByName(_copies(valid, classes)))
    whole = classes.join(counts, ["rep", "cid"], "left").select(F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"))
    out = valid.join(whole, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))).select("vec_id", "links")
    out = out.unionByName(rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("links")))
    out = out.join(groups, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.col("links").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _copies(valid: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of equal vectors: each to its class's smallest id."""
    many = classes.filter("many > 1").select(F.col("label").alias("l"), F.col("vector").alias("v"), "rep")
    return valid.join(many, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))).filter("vec_id <> rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
