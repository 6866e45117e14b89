"""Phrase collocations by merged count-min sketches and an exact second pass.

First pass: each task counts the runs of 1 to ``longest`` words of its texts in a count-min
sketch of its own, whose cells stop at the threshold; the sketches are cut into blocks, blocks
of the same cells are added up, and a bit per cell tells whether the sum reaches the threshold.
A sum is never below the true count of any run in its cell, so a run whose cells aren't all
set is rarer than the threshold. Second pass: runs that survive, and whose own parts survive,
are counted exactly, words compared byte by byte. Only those bits (two a cell) are broadcast.
Then each candidate is scored by its weakest cut and dropped if a longer one holds all its
occurrences.

A sketch has so many cells that a task's counts leave most of them empty and its compressed
size follows what the task reads, not their number; above a gigabyte of text they follow the
bytes, so that 50 counts at most fall into a cell at the threshold of 100. MOST_CELLS bounds the
memory of a task (two bytes a cell and row). Beyond that more runs survive the first pass,
which costs a larger exact aggregation and no result.

Defined results: null and empty texts have no words; a null language is ``und``, one with a
text that says so; rows that repeat count each; a language without candidates gives no rows, an
empty table none at all; ties go by count, then by the phrase's UTF-8 bytes; other columns
don't matter. A piece or a text may be of any length: runs are arrays over slices of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark import shared
from siftspark.llm import storage, textscan

LONGEST, LEAST, TOP = 5, 100, 2000
#: Rows of a sketch, and the bounds of its cells a row.
ROWS, LEAST_CELLS, MOST_CELLS = 2, 1 << 24, 1 << 26
#: Cells that are merged together.
BLOCK = 1 << 18
UNKNOWN = "und"

#: Words are runs of anything but space, tab and what ends a piece.
_WORD = np.ones(256, bool)
_WORD[[ord(c) for c in " \t.,;:!?\n\x0b\x0c\r"]] = False
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True

_COUNTS = "lang string, size int, phrase string, n long"


class _Slice:
    """The words of some documents, joined by one byte each, with the piece that each stands in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, salts: np.ndarray):
        data = textscan.lowered(data)
        self.start, self.end = textscan.word_spans(data, offsets, _WORD)
        doc = np.searchsorted(offsets, self.start, "right") - 1
        ends = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_ENDS[data], out=ends[1:])
        # pieces are numbered on over documents, as a document starts a piece of its own
        self.piece = ends[self.start] + doc
        self.lang = langs[doc]
        self.word = textscan.hashes(data, self.start, self.end) ^ salts[self.lang]
        size = self.end - self.start
        self.joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
        self.at = np.cumsum(size + 1) - size - 1
        self.joined[textscan.ranges(self.at, size)] = data[textscan.ranges(self.start, size)]
        self.size = size

    def runs(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length: hashes of all runs of so many words from each word on, and which lie in one piece."""
        up, down = textscan._WORD_POWERS.upto(len(self.word) + 1)
        total = np.zeros(len(self.word) + 1, np.uint64)
        np.cumsum(self.word * up[: len(self.word)], out=total[1:])
        for n in range(1, longest + 1):
            m = max(0, len(self.word) - n + 1)
            # a piece holds words of one document, so of one language
            yield textscan.mix((total[n : n + m] - total[:m]) * down[:m] + np.uint64(n)), self.piece[:m] == self.piece[n - 1 : n - 1 + m]

    def counted(self, at: np.ndarray, n: int, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """(language, phrase, count) of the distinct runs of n words at the given words; equal hashes are confirmed on their bytes."""
        while len(at):
            _, first, own, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            start, length = self.at[at], self.at[at + n - 1] + self.size[at + n - 1] - self.at[at]
            same = (length == length[first][own]) & (self.lang[at] == self.lang[at[first]][own])
            there = np.flatnonzero(same)
            mine, other = self.joined[textscan.ranges(start[there], length[there])], self.joined[textscan.ranges(start[first][own[there]], length[there])]
            wrong = np.add.reduceat(mine != other, np.cumsum(length[there]) - length[there]) if len(there) else np.zeros(0, int)
            same[there[wrong > 0]] = False
            counts = np.bincount(own[same], minlength=len(first))
            yield self.lang[at[first]], _strings(self.joined, start[first], length[first]), counts
            at, hashes = at[~same], hashes[~same]


def _strings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[textscan.ranges(start, length)])).cast(pa.string())


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Slice, list[str]]]:
    """Slices of the batches' texts, and the names of their languages."""
    textscan.forget()
    for b in batches:
        coded = pc.dictionary_encode(b.column("lang"))
        names = coded.dictionary.to_pylist()
        langs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        raw, offsets = textscan.spans(coded.dictionary)
        salts = textscan.mix(textscan.hashes(raw, offsets[:-1], offsets[1:])) if len(names) else np.zeros(0, np.uint64)
        data, offsets = textscan.spans(b.column("text"))
        for i, j in textscan.slices(offsets):
            yield _Slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], langs[i:j], salts), names
    textscan.release()


def _cell(hashes: np.ndarray, k: int, cells: int) -> np.ndarray:
    """The cell of each hash in row k of a sketch."""
    return ((hashes >> np.uint64(32 * k)) & np.uint64(cells - 1)).astype(np.int64)


def sketches(rows: DataFrame, cells: int, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """block and counts of each task's sketch: cells that stop at ``least``, compressed."""
    kind = np.uint16 if least < 1 << 15 else np.uint32
    room = np.iinfo(kind).max - least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(cells, kind) for _ in range(ROWS)]
        for s, _ in _sliced(batches):
            for hashes, ok in s.runs(longest):
                hashes = hashes[ok]
                for k in range(ROWS):
                    at = _cell(hashes, k, cells)
                    for i in range(0, len(at), room):  # a cell can't overflow before it is cut off again
                        some = at[i : i + room]
                        np.add.at(held[k], some, kind(1))
                        held[k][some] = np.minimum(held[k][some], kind(least))
        pack = zstandard.ZstdCompressor(level=1)
        step = min(BLOCK, cells)
        for k, h in enumerate(held):
            for i in range(0, cells, step):
                part = h[i : i + step]
                if part.any():
                    small = part.astype(np.uint8) if least < 256 else part
                    yield pa.RecordBatch.from_arrays([pa.array([k * (cells // step) + i // step], pa.int32()), pa.array([pack.compress(small.tobytes())], pa.binary())], names=["block", "counts"])

    return rows.mapInArrow(run, "block int, counts binary")


def merged(parts: DataFrame, cells: int, least: int = LEAST) -> DataFrame:
    """block and bits: which cells reach ``least`` over all sketches. A task adds up one block after the other, whatever their number."""
    kind = np.dtype(np.uint8 if least < 256 else np.uint16 if least < 1 << 15 else np.uint32)
    step = min(BLOCK, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        now, total = None, np.zeros(0, np.uint32)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["block", "bits"])

        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield out()
                    now, total = block, np.zeros(step, np.uint32)
                total = np.minimum(total + np.frombuffer(unpack.decompress(counts), kind), np.uint32(least))
        if now is not None:
            yield out()

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, bits binary")


def frequent_cells(rows: DataFrame, cells: int, longest: int = LONGEST, least: int = LEAST) -> np.ndarray:
    """Bits of all rows of the merged sketch; 2 * MOST_CELLS bits at most."""
    step = min(BLOCK, cells)
    bits = np.zeros((ROWS * cells // step, step // 8), np.uint8)
    for r in merged(sketches(rows, cells, longest, least), cells, least).toLocalIterator():
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(ROWS, cells // 8)


def cells_for(rows: DataFrame, longest: int = LONGEST, least: int = LEAST) -> int:
    """A power of two: a run of words takes some 1.6 bytes of text for five lengths, and twice as many cells as runs at the threshold are wanted."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = 2 * size * longest // (8 * least)
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << max(1, int(wanted)).bit_length()))


def exact_counts(rows: DataFrame, bits: np.ndarray, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, size, phrase and n of all runs that occur ``least`` times; size 0 has the number of all words."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        cells = own.shape[1] * 8
        for s, names in _sliced(batches):
            langs, words = np.unique(s.lang, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in langs.tolist()], pa.string()), pa.array([0] * len(langs), pa.int32()), pa.array([""] * len(langs)), pa.array(words, pa.int64())], names=["lang", "size", "phrase", "n"])
            alive = np.ones(len(s.word) + 1, bool)
            for n, (hashes, ok) in enumerate(s.runs(longest), 1):
                # both runs of one word less survive too
                maybe = np.flatnonzero(ok & alive[: len(ok)] & alive[1 : len(ok) + 1]) if n > 1 else np.arange(len(ok))
                for k in range(ROWS):
                    at = _cell(hashes[maybe], k, cells)
                    maybe = maybe[(own[k][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
                alive = np.zeros(len(s.word) + 1, bool)
                alive[maybe] = True
                for lang, phrase, counts in s.counted(maybe, n, hashes[maybe]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(names, object)[lang], pa.string()), pa.array(np.full(len(counts), n, np.int32)), phrase, pa.array(counts, pa.int64())], names=["lang", "size", "phrase", "n"])

    counted = rows.mapInArrow(run, _COUNTS).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return storage.stored(counted.filter((F.col("size") == 0) | (F.col("n") >= least)), "phrases")


def _words(a: Column | str, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.col(a) if isinstance(a, str) else a, first, n), " ")


def cut_scores(counts: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, n and score of each phrase of two words or more: the cut of the lowest score, the first of equals."""
    phrases = counts.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "size", "phrase", "a", "k", _words("words", F.lit(1), F.col("k")).alias("left"), _words("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    known = counts.filter("size > 0").select("lang", "phrase", "n")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.join(shared.few(counts.filter("size = 0").select("lang", "n")), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    whole = F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")
    cuts = cuts.withColumn("whole", whole).withColumn("parts", wide("l") * wide("r")).withColumn("score", F.expr("whole div parts"))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return cuts.groupBy("lang", "phrase", "size", "a", "n").agg(best.alias("cut")).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def without_subsumed(scored: DataFrame, percent: int = 100) -> DataFrame:
    """Leaves out phrases that stand in a longer one which has ``percent`` of their count at least."""
    words = F.split("phrase", " ")
    longer = scored.filter("size > 2").select("lang", F.col("a").alias("held"), words.alias("words"), "size").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)))
    inside = longer.select("lang", _words("words", F.col("i"), F.col("n")).alias("phrase"), "held").groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    return scored.join(inside, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (100 * F.col("held") < percent * F.col("a"))).drop("held")


def collocations(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, percent: int = 100, text_col: str = "text", lang_col: str = "lang", cells: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases."""
    storage.bounded_batches(documents.sparkSession)
    rows = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bits = frequent_cells(rows, cells or cells_for(rows, longest, least), longest, least)
    scored = storage.stored(cut_scores(exact_counts(rows, bits, longest, least)), "scored")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = without_subsumed(scored, percent).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
