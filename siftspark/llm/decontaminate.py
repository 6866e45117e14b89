"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. An
item gives its windows of ``n`` words, or itself as one window if it has fewer. Document
windows are looked up by a 64-bit hash and every hit is compared word by word.

Defined results: null and empty texts have no words; null item ids are skipped; repeated
items and repeated windows count once per item id; an empty benchmark hits nothing; each
document row gives one result row, repeated rows too. Columns other than the id and the
text are neither read nor returned by ``scan_documents``; ``decontaminated`` keeps them all.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import textscan

NGRAM = 10
#: Characters of benchmark text in one pass; a larger benchmark goes in several. A window takes 24 bytes of
#: arrays, so what is broadcast has 13 bytes a character at most, where every word is one letter (some 5 as a rule).
BLOCK_CHARS = 4 << 20

HITS = "doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


class Grams:
    """The windows of a block of items, by length: sorted hashes, the item of each and where its words stand."""

    def __init__(self, rows: list[tuple[str, str]], n: int):
        self.items = sorted({item for item, _ in rows})
        place = {x: k for k, x in enumerate(self.items)}
        texts, size = [], 0
        found: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        for item, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            w = textscan.words(raw, np.array([0, len(raw)]), textscan.ALNUM, True)
            if not len(w.hash):
                continue
            length = min(n, len(w.hash))
            hashes, at = textscan.windows(w, length)
            ends = np.cumsum(w.end - w.start + 1)  # each word is followed by a space
            starts = ends - (w.end - w.start + 1)
            found[length].append((hashes, np.full(len(at), place[item], np.int32), size + starts[at], (ends[at + length - 1] - 1 - starts[at]).astype(np.int32)))
            texts.append(w.text(0, len(w.hash)) + b" ")
            size += len(texts[-1])
        self.text = b"".join(texts)
        self.by_length = {k: self._distinct(*map(np.concatenate, zip(*v, strict=True))) for k, v in found.items()}

    def _distinct(self, hashes: np.ndarray, item: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """In order of hash and item, without the windows that an item repeats."""
        order = np.lexsort((item, hashes))
        hashes, item, start, size = hashes[order], item[order], start[order], size[order]
        keep = np.ones(len(hashes), bool)
        first = 0
        for k in range(1, len(hashes)):
            if hashes[k] != hashes[first] or item[k] != item[first]:
                first = k
            else:  # another one under the same hash stays if its words differ
                keep[k] = self._words(start[k], size[k]) != self._words(start[first], size[first])
        return hashes[keep], item[keep], start[keep], size[keep]

    def _words(self, start: int, size: int) -> bytes:
        return self.text[start : start + size]

    def hits(self, w: textscan.Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, length, items) of each verified occurrence."""
        for length, (keys, item, start, size) in self.by_length.items():
            hashes, at = textscan.windows(w, length)
            if not len(hashes):
                continue
            near = np.searchsorted(keys, hashes)
            for k in np.flatnonzero(keys[np.minimum(near, len(keys) - 1)] == hashes).tolist():
                i, g, own = int(at[k]), int(near[k]), []
                words = w.text(i, i + length)
                while g < len(keys) and keys[g] == hashes[k]:
                    if self._words(start[g], size[g]) == words:
                        own.append(self.items[item[g]])
                    g += 1
                if own:
                    yield i, length, own


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about block_chars characters; an item's rows are in one block."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("item is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.toLocalIterator()]


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def scan_documents(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the hit word ranges.

    One pass without a shuffle if the benchmark fits one block; else a pass per block and a
    join of the hits by row, so that what is broadcast never exceeds ``block_chars``.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_chars)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        return _summary(_pass(rows, spark.sparkContext.broadcast(Grams(first, n))))
    # repeated ids have texts of their own, so rows are told apart by id and text
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    keyed = rows.groupBy("doc_id", F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    found = None
    for block in (b for part in ([first], [second], blocks) for b in part):
        hits = _pass(keyed.select("doc_id", "text", "key"), spark.sparkContext.broadcast(Grams(block, n)), keyed=True)
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    copies = keyed.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "copies")
    full = merged.join(copies, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    return _summary(full.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_words", "starts", "ends", "items"))


def _pass(rows: DataFrame, grams, keyed: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = grams.value
        for b in batches:
            n_words, starts, ends, items = [], [], [], []
            for i, j, w in textscan.scan(b.column("text"), textscan.ALNUM, True):
                by_doc: dict[int, list[tuple[int, int, list[str]]]] = defaultdict(list)
                for at, length, found in own.hits(w):
                    by_doc[int(np.searchsorted(w.offsets, at, "right")) - 1].append((at, length, found))
                for d in range(j - i):
                    base, hits = int(w.offsets[d]), by_doc.get(d, ())
                    n_words.append(int(w.offsets[d + 1]) - base)
                    starts.append([at - base for at, _, _ in hits])
                    ends.append([at - base + length for at, length, _ in hits])
                    items.append(sorted({x for _, _, found in hits for x in found}))
            ids = [b.column("doc_id")] + ([b.column("key")] if keyed else [])
            yield pa.RecordBatch.from_arrays([*ids, pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["doc_id", *["key"] * keyed, "n_words", "starts", "ends", "items"])

    return rows.mapInArrow(run, HITS.replace("n_words", "key string, n_words") if keyed else HITS)


def _summary(hits: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.to_pydict()
            n_hit = []
            for starts, ends in zip(x["starts"], x["ends"], strict=True):
                covered, upto = 0, 0
                for s, e in sorted(zip(starts, ends, strict=True)):
                    covered += max(0, e - max(s, upto))
                    upto = max(upto, e)
                n_hit.append(covered)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(v) for v in x["items"]], pa.int64()), pa.array([_digest(set(v)) for v in x["items"]]), pa.array([v > 0 for v in n_hit]), b.column("starts"), b.column("ends")],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "starts", "ends"],
            )

    return hits.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, starts array<int>, ends array<int>")


def decontaminated(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM, remove: str = "spans", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all columns kept, without the words that a benchmark window covers.

    remove: "spans" cuts the covered words with the separators that follow them, "documents"
    drops every document with a hit. Rows without a hit come back unchanged. Windows are judged
    on the texts as given, whatever the number of blocks: spans are gathered first, then cut.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove}")
    spark = documents.sparkSession
    spans = "spans"
    while spans in documents.columns:
        spans += "_"
    out = documents.withColumn(spans, F.array().cast("array<int>"))
    schema = out.schema
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        grams = spark.sparkContext.broadcast(Grams(block, n))

        def find(batches: Iterator[pa.RecordBatch], grams=grams) -> Iterator[pa.RecordBatch]:
            """Adds first and last word of each hit."""
            own = grams.value
            for b in batches:
                at, k = b.schema.get_field_index(text_col), b.schema.get_field_index(spans)
                found: dict[int, list[int]] = defaultdict(list)
                for i, _, w in textscan.scan(b.column(at), textscan.ALNUM, True):
                    for first, length, _ in own.hits(w):
                        d = int(np.searchsorted(w.offsets, first, "right")) - 1
                        found[i + d] += [first - int(w.offsets[d]), first - int(w.offsets[d]) + length]
                if found:
                    lists = b.column(k).to_pylist()
                    for row, more in found.items():
                        lists[row] = lists[row] + more
                    b = b.set_column(k, b.schema.field(k), pa.array(lists, b.schema.field(k).type))
                yield b

        out = out.mapInArrow(find, schema)
    if remove == "documents":
        return out.filter(F.size(f"`{spans}`") == 0).drop(spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, k = b.schema.get_field_index(text_col), b.schema.get_field_index(spans)
            hits = {row: x for row, x in enumerate(b.column(k).to_pylist()) if x}
            b = b.remove_column(k)
            if hits:
                texts = b.column(at).to_pylist()
                for row, x in hits.items():
                    texts[row] = _without(texts[row], x)
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b

    return out.mapInArrow(cut, documents.schema)


def _without(text: str, spans: list[int]) -> str:
    """A text without the words of the spans (first word, last + 1, and so on) and what follows each up to the next word."""
    raw = text.encode()
    w = textscan.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), textscan.ALNUM, False)
    hit = np.zeros(len(w.start), bool)
    for a, e in zip(spans[::2], spans[1::2], strict=True):
        hit[a:e] = True
    starts = np.append(w.start, len(raw))
    begin = np.flatnonzero(hit & ~np.insert(hit[:-1], 0, False))
    end = np.flatnonzero(hit & ~np.append(hit[1:], False)) + 1
    kept, at = [], 0
    for a, e in zip(starts[begin].tolist(), starts[end].tolist(), strict=True):
        kept.append(raw[at:a])
        at = e
    return b"".join([*kept, raw[at:]]).decode()
