"""Repeated passages by a compacted De Bruijn graph over words.

The graph's edges are k-mers of words. A window of ``window`` words is a path of
``window - k + 1`` edges; its anchor is the edge of the smallest hash (the first of equals), so
windows with the same words have the same anchor at the same place. The neighbouring windows
of one anchor form one path of the source. Sources are joined on anchors: where all sources of
a repeated anchor go through one and the same path, that path doesn't branch and is compacted,
all its windows being repeated at once; where paths of an anchor differ, the graph branches,
and the windows of these paths are compared one by one by hashes of 128 bits. The coordinates
of repeated windows then go back to their documents.

A word is repeated if a window that covers it starts anywhere else too, in the same document
or another; windows are judged on the input.

Defined results: null and empty texts have no words; documents shorter than a window lose
nothing; rows that repeat (also with the same id) are sources of their own, so both lose all;
each row gives one result row. Only anchors, coordinates and, once, compressed texts are moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import storage, textscan

WINDOW, EDGE = 35, 10

#: Words are compared as they are.
_KEY = ["doc_id", "text_key"]


def _first_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each start the place of the smallest of ``width`` values from there on, the first of equals."""
    at, reach = np.arange(len(h)), 1
    while 2 * reach <= width:
        a, b = at[:-reach], at[reach:]
        at, reach = np.where(h[a] <= h[b], a, b), 2 * reach
    if reach < width:
        a, b = at[: -(width - reach)], at[width - reach :]
        at = np.where(h[a] <= h[b], a, b)
    return at


def paths(w: textscan.Words, window: int = WINDOW, edge: int = EDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, hash of the whole path, document, first and last window start (words from the document's start)."""
    none = np.zeros(0, np.int64)
    m = len(w.hash)
    if m < window:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    up, down = textscan._WORD_POWERS.upto(m + 1)
    total = np.zeros(m + 1, np.uint64)
    np.cumsum(w.hash * up[:m], out=total[1:])
    edges = textscan.mix((total[edge:] - total[:-edge]) * down[: m - edge + 1])
    anchor = _first_least(edges, window - edge + 1)
    doc = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
    starts = np.arange(m - window + 1)
    inside = doc[starts] == doc[starts + window - 1]
    starts = starts[inside]
    if not len(starts):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    anchor = anchor[starts]
    # an anchor's edge lies in the window, so windows of two documents never share one
    begin = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    lo, hi = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
    place = anchor[begin]
    whole = textscan.mix((total[hi + window] - total[lo]) * down[lo] + ((hi - lo) * 64 + place - lo).astype(np.uint64))
    base = w.offsets[doc[lo]]
    return edges[place], whole, doc[lo], lo - base, hi - base


def _rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _anchors(rows: DataFrame, window: int, edge: int, coordinates: bool) -> DataFrame:
    """A row for each path: its anchor with the path's hash, or with its coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, w in textscan.scan(b.column("text"), textscan.SPACED, False):
                anchor, whole, doc, lo, hi = paths(w, window, edge)
                if not coordinates:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))], names=["anchor", "path"])
                    continue
                at = pa.array(doc + i)
                span = (lo << 8) | (hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), b.column("doc_id").take(at), b.column("text_key").take(at), pa.array(span)], names=["anchor", "doc_id", "text_key", "span"])

    return rows.mapInArrow(run, "anchor long, doc_id long, text_key long, span long" if coordinates else "anchor long, path long")


def _joined(rows: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """Texts meet the spans of their repeated paths. Documents whose paths don't branch are done;
    the others keep their text, the words already found, and the starts of windows to compare."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array([pack.compress(x.as_buffer()) for x in b.column("text")], pa.binary())], names=["doc_id", "text_key", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[tuple] = []
            for packed, spans in zip(b.column("packed").to_pylist(), b.column("spans"), strict=True):
                words = unpack.decompress(packed).split()
                sure, open_ = _windows_of(spans, len(words), window)
                if len(open_):
                    out.append((len(words), None, None, packed, np.flatnonzero(sure).astype(np.int32).tobytes(), open_.astype(np.int32).tobytes()))
                else:
                    out.append((len(words), *_kept(words, sure), None, None, None))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "text_key", "n_words", "n_removed", "kept_sha256", "packed", "sure", "open"])

    found = spans.groupBy(*_KEY).agg(F.collect_set(F.col("span")).alias("spans"))
    texts = rows.mapInArrow(packed, "doc_id long, text_key long, packed binary")
    by_id = texts.doc_id.eqNullSafe(found.doc_id) & (texts.text_key == found.text_key)
    both = texts.join(found, by_id, "left").select(texts.doc_id, texts.text_key, "packed", "spans")
    return both.mapInArrow(run, "doc_id long, text_key long, n_words long, n_removed long, kept_sha256 string, packed binary, sure binary, open binary")


def _windows_of(spans: pa.Scalar, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of words covered for sure, and the starts of the windows to compare. span: start, branching flag, length."""
    covered = np.zeros(n + 1, np.int64)
    if not spans.is_valid:
        return covered[:n] > 0, np.zeros(0, np.int64)
    x = spans.values.to_numpy()
    branching, lo = x & 128 > 0, x >> 8
    hi = lo + (x & 127)
    np.add.at(covered, lo[~branching], 1)
    np.add.at(covered, hi[~branching] + window, -1)
    return np.cumsum(covered)[:n] > 0, np.unique(textscan.ranges(lo[branching], (hi - lo)[branching] + 1))


def _kept(words: list[bytes], removed: np.ndarray) -> tuple[int, str]:
    count = int(removed.sum())
    kept = [w for w, gone in zip(words, removed.tolist(), strict=True) if not gone] if count else words
    return count, hashlib.sha256(b" ".join(kept)).hexdigest()


def _open_windows(done: DataFrame, window: int) -> DataFrame:
    """A row for each window of a branching path: its hashes and coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for k in range(b.num_rows):
                raw = np.frombuffer(unpack.decompress(b.column("packed")[k].as_py()), np.uint8)
                at = np.frombuffer(b.column("open")[k].as_py(), np.int32)
                keys = [textscan.windows(textscan.words(raw, np.array([0, len(raw)]), textscan.SPACED, False, second), window)[0][at].view(np.int64) for second in (False, True)]
                same = [b.column(c).slice(k, 1).take(pa.array(np.zeros(len(at), np.int64))) for c in _KEY]
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), *same, pa.array(at)], names=["h1", "h2", *_KEY, "start"])

    return done.filter("packed is not null").select(*_KEY, "packed", "open").mapInArrow(run, "h1 long, h2 long, doc_id long, text_key long, start int")


def scanned(documents: DataFrame, window: int = WINDOW, edge: int = EDGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by a space, one row per row."""
    if not 0 < edge <= window < 128:
        raise ValueError("0 < edge <= window < 128 is needed")
    rows = _rows(documents, id_col, text_col)
    anchors = _anchors(rows, window, edge, False).groupBy("anchor").agg(F.count("*").alias("n"), F.min("path").alias("a"), F.max("path").alias("b"))
    repeated = storage.stored(anchors.filter("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("branching")), "anchors")
    # the span's bit 7 tells that the path branches
    spans = _anchors(rows, window, edge, True).join(repeated, "anchor").select(*_KEY, (F.col("span") + F.when(F.col("branching"), 128).otherwise(0)).alias("span"))
    done = storage.stored(_joined(rows, spans, window), "spans")
    storage.drop(repeated)
    again = storage.stored(_open_windows(done, window).groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), "windows")
    starts = _open_windows(done, window).join(again, ["h1", "h2"]).groupBy(*_KEY).agg(F.collect_set("start").alias("starts"))
    left = done.filter("packed is not null")
    by_id = left.doc_id.eqNullSafe(starts.doc_id) & (left.text_key == starts.text_key)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for packed, sure, starts in zip(b.column("packed").to_pylist(), b.column("sure").to_pylist(), b.column("starts"), strict=True):
                words = unpack.decompress(packed).split()
                removed = np.zeros(len(words), bool)
                removed[np.frombuffer(sure, np.int32)] = True
                if starts.is_valid:
                    removed[np.unique(textscan.ranges(starts.values.to_numpy().astype(np.int64), np.full(len(starts.values), window)))] = True
                out.append(_kept(words, removed))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rest = left.join(starts, by_id, "left").select(left.doc_id, "n_words", "packed", "sure", "starts").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return done.filter("packed is null").select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(rest)
