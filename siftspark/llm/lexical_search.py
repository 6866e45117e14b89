"""Ranked lexical search by Fagin's threshold algorithm over shards of an index.

The items' terms are the vocabulary; they come in blocks bounded by bytes. One pass over the
texts of a block makes the forward index: per document its length and, for each term that is
asked, its number. Grouped aggregation over it gives the statistics (documents, words,
documents per term), hence weights. Then each task reads forward rows into shards of a bounded
number of postings; a shard sorts each term's postings by impact, and each item reads its
terms' lists round-robin, some postings of every list a round, looks each new document up in
the forward index for its whole score, and stops as soon as the threshold - the sum of the
impacts that the lists have come down to - is strictly below its tenth best score. What a task
has found bounds its later shards from the start. The tasks' best go to one window per item.

Scores are whole numbers, so results don't depend on the order of sums. Equal scores rank by
ascending id; because the stop is strict, no equal one is missed.

Defined results: null and empty texts hold no term, and are no documents of the statistics; an
item without terms, or none of whose terms occurs, has no rows; rows without id count in the
statistics and are not returned; rows that repeat, or share an id, are documents of their own;
items of the same id are ranked as one item whose terms are those of all its rows; an empty
table on either side gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.llm import storage, textscan

TOP = 10
#: Bytes of items that are searched together; more items take more passes.
BLOCK_BYTES = 4 << 20
#: Postings of a shard, and postings of each list that a round reads.
SHARD_POSTINGS, STEP = 1 << 20, 64

_FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"
_FOUND = "item int, doc_id long, score long, postings long"


@dataclass
class Vocabulary:
    """The terms of a block of items, and each item's terms with their numbers."""

    names: list[str]
    keys: np.ndarray  # hashes in order
    start: np.ndarray
    size: np.ndarray
    data: np.ndarray
    asked: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> Vocabulary:
        by_item: dict[str, Counter[bytes]] = {}
        for item, text in rows:
            raw = np.frombuffer(text.encode(), np.uint8)
            w = textscan.words(raw, np.array([0, len(raw)]), textscan.ALNUM, True)
            by_item.setdefault(item, Counter()).update(w.text(k, k + 1) for k in range(len(w.hash)))
        terms = sorted(set().union(*by_item.values()))
        data = np.frombuffer(b"".join(terms), np.uint8)
        end = np.cumsum([len(t) for t in terms], dtype=np.int64)
        start = end - np.array([len(t) for t in terms], np.int64)
        hashes = textscan.hashes(data, start, end)
        order = np.argsort(hashes, kind="stable")
        place = {terms[k]: i for i, k in enumerate(order.tolist())}
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two terms share a hash")  # one pair in 2**64; the block may be cut elsewhere
        asked = [(np.array([place[t] for t in c], np.int64), np.fromiter(c.values(), np.int64, len(c))) for c in by_item.values()]
        return cls(list(by_item), hashes[order], start[order], (end - start)[order], data, asked)

    def found(self, w: textscan.Words) -> tuple[np.ndarray, np.ndarray]:
        """Words that are terms, compared byte by byte, and which."""
        if not len(self.keys) or not len(w.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.minimum(np.searchsorted(self.keys, w.hash), len(self.keys) - 1)
        at = np.flatnonzero((self.keys[near] == w.hash) & (self.size[near] == w.end - w.start))
        term = near[at]
        if len(at):
            size = self.size[term]
            wrong = w.data[textscan.ranges(w.start[at], size)] != self.data[textscan.ranges(self.start[term], size)]
            right = np.add.reduceat(wrong, np.cumsum(size) - size) == 0
            at, term = at[right], term[right]
        return at, term


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of about ``most`` bytes, dealt by hash; the rows of one id are in one block."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // most)
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.toLocalIterator()]


def forward_index(documents: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (all terms of the text), and the asked terms with their numbers; one row per text that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.value
        width = max(1, len(own.keys))
        for b in batches:
            ids = b.column("doc_id")
            for i, j, w in textscan.scan(b.column("text"), textscan.ALNUM, True):
                n = np.diff(w.offsets)
                at, term = own.found(w)
                doc = np.searchsorted(w.offsets, at, "right") - 1
                keys, tfs = np.unique(doc * width + term, return_counts=True)
                held = np.flatnonzero(n)
                offsets = np.searchsorted(keys, np.append(held, j - i) * width)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).take(pa.array(held)), pa.array(n[held], pa.int64()), textscan.list_column((keys % width).astype(np.int32), offsets, pa.int32()), textscan.list_column(tfs.astype(np.int32), offsets, pa.int32())],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return documents.mapInArrow(run, _FORWARD)


def weights(forward: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Number of documents, of all their terms, and the weight of each asked term."""
    total = forward.agg(F.count("*").alias("documents"), F.sum("n").alias("words")).first()
    n, words = total.documents, total.words or 0
    df = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)))
    out = np.zeros(max(1, terms), np.int64)
    for r in df.select("term", weight.alias("w")).toLocalIterator():  # one short row a term of the block
        out[r.term] = r.w
    return n, words, out


class _Best:
    """The best documents so far of each item of a task."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.score = [np.zeros(0, np.int64)] * items
        self.doc = [np.zeros(0, np.int64)] * items

    def least(self, item: int) -> int:
        """The score that the last of a full list has; 0 if it isn't full, as no score of 0 counts."""
        s = self.score[item]
        return int(s[-1]) if len(s) == self.top else 0

    def add(self, item: int, score: np.ndarray, doc: np.ndarray) -> None:
        keep = (score > 0) & (score >= self.least(item))
        if keep.any():
            score, doc = np.concatenate((self.score[item], score[keep])), np.concatenate((self.doc[item], doc[keep]))
            order = np.lexsort((doc, -score))[: self.top]
            self.score[item], self.doc[item] = score[order], doc[order]


class Shard:
    """Impact-sorted lists and a forward index of some documents."""

    def __init__(self, doc: np.ndarray, offsets: np.ndarray, terms: np.ndarray, impact: np.ndarray, width: int):
        self.doc, self.offsets, self.terms, self.impact = doc, offsets, terms, impact
        row = np.repeat(np.arange(len(doc)), np.diff(offsets))
        order = np.lexsort((-impact, terms))
        self.list_row, self.list_impact = row[order], impact[order]
        self.list_start = np.searchsorted(terms[order], np.arange(width + 1))
        self.seen = np.zeros(len(doc), bool)

    def lookup(self, rows: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whole scores of documents by the forward index; times: how often each term is asked."""
        size = self.offsets[rows + 1] - self.offsets[rows]
        at = textscan.ranges(self.offsets[rows], size)
        parts = times[self.terms[at]] * self.impact[at]
        return np.add.reduceat(parts, np.cumsum(size) - size) if len(rows) else np.zeros(0, np.int64)

    def search(self, item: int, terms: np.ndarray, count: np.ndarray, times: np.ndarray, best: _Best, step: int) -> int:
        """Adds the item's best documents; returns the number of postings read."""
        at, end = self.list_start[terms], self.list_start[terms + 1]
        met, read = [], 0
        while True:
            open_ = at < end
            at, end, count = at[open_], end[open_], count[open_]
            # no document that isn't seen yet can score more than the heads of all lists together
            if not len(at) or int((count * self.list_impact[at]).sum()) < max(1, best.least(item)):
                break
            upto = np.minimum(at + step, end)
            rows = self.list_row[textscan.ranges(at, upto - at)]
            read += len(rows)
            rows = np.unique(rows[~self.seen[rows]])
            if len(rows):
                self.seen[rows] = True
                met.append(rows)
                best.add(item, self.lookup(rows, times), self.doc[rows])
            at = upto
        for rows in met:
            self.seen[rows] = False
        return read


def search(forward: DataFrame, vocabulary, documents: int, words: int, weight: np.ndarray, top: int = TOP, shard_postings: int = SHARD_POSTINGS, step: int = STEP) -> DataFrame:
    """item (its place in the block), doc_id, score: each task's best; postings: what the task read for the item, in its first row."""
    weighed = forward.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = vocabulary.value, weighed.value
        best, read = _Best(len(own.asked), top), np.zeros(len(own.asked), np.int64)
        times = np.zeros(len(w), np.int64)

        def searched(held: list[tuple[np.ndarray, ...]]) -> None:
            doc, n, sizes, terms, tfs = map(np.concatenate, zip(*held, strict=True))
            m = np.repeat(25 + (75 * n * documents) // words, sizes)
            impact = w[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))
            shard = Shard(doc, np.concatenate(([0], np.cumsum(sizes))), terms, impact, len(w))
            for k, (asked, count) in enumerate(own.asked):
                times[asked] = count
                read[k] += shard.search(k, asked, count, times, best, step)
                times[asked] = 0

        held, size = [], 0
        for b in batches:
            arrays = _flat(b)
            for i, j in textscan.slices(np.concatenate(([0], np.cumsum(arrays[2]))), shard_postings):
                part = _rows(arrays, i, j)
                held.append(part)
                size += len(part[3])
                if size >= shard_postings:
                    searched(held)
                    held, size = [], 0
        if size:
            searched(held)
        sizes = [len(s) for s in best.score]
        if sum(sizes):
            first = np.cumsum(sizes) - sizes
            postings = np.zeros(sum(sizes), np.int64)
            some = np.flatnonzero(sizes)
            postings[first[some]] = read[some]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()), pa.array(np.concatenate(best.doc), pa.int64()), pa.array(np.concatenate(best.score), pa.int64()), pa.array(postings)], names=["item", "doc_id", "score", "postings"])

    return forward.filter(F.col("doc_id").isNotNull() & (F.size("terms") > 0)).mapInArrow(run, _FOUND)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """doc_id, n, number of terms, terms, tfs of a batch of forward rows."""
    lists, tfs = b.column("terms"), b.column("tfs")
    return b.column("doc_id").to_numpy(), b.column("n").to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)


def _rows(arrays: tuple[np.ndarray, ...], i: int, j: int) -> tuple[np.ndarray, ...]:
    doc, n, sizes, terms, tfs = arrays
    a, z = int(sizes[:i].sum()), int(sizes[:j].sum())
    return doc[i:j], n[i:j], sizes[i:j], terms[a:z], tfs[a:z]


def ranked(documents: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` documents with a score above 0."""
    spark = documents.sparkSession
    storage.bounded_batches(spark)
    kind = items.schema[item_col].dataType
    asked = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("item is not null and text is not null")
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = None
    for block in _blocks(asked, block_bytes):
        own = Vocabulary.of(block)
        vocabulary = spark.sparkContext.broadcast(own)
        forward = storage.stored(forward_index(texts, vocabulary), "forward")
        n, words, weight = weights(forward, len(own.keys))
        if not n:
            break
        found = search(forward, vocabulary, n, words, weight, top)
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(k, x) for k, x in enumerate(own.names)], "item int, name string")
        part = best.join(F.broadcast(names), "item").select(F.col("name").cast(kind).alias("item_id"), "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "rank int, doc_id long, score long").select(F.lit(None).cast(kind).alias("item_id"), "rank", "doc_id", "score")
    return out
