"""Fuzzy line dedup over a corpus: MinHash bands, exact Jaccard verification, union-find.

A line is what new lines separate. Lines are compared lower-cased (A-Z) with runs of ASCII
white space as one space; lines that are empty then are never touched. Each line has a
signature of character shingles, cut into bands; lines that share a band are candidates and
are verified by the Jaccard similarity of their full shingle sets. A line under one shingle is
one shingle of its own, so it is like its exact copies only and has no bands. Verified
links are joined to components by a distributed union-find, and of each component the first
line stays, by document id and line number; the others are removed.

Lines with the same normalised characters are one node from the start (a 64-bit hash of them).
Of bands with the same lines one stays. First each line of a band is compared with the band's
smallest one; bands that then still hold several components are compared in blocks, all pairs,
and only a spanning forest of the links is written, so many near copies cost in proportion.

Defined results: null and empty texts have no lines to remove (a text without a new line is
one line); rows with the same id and the same text are one document, all alike; a null id comes
before the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import storage, textscan
from siftspark.llm.components import components, contract
from siftspark.llm.minhash_docs import _runs, linked

SHINGLE, LEAST_CHARS, PERCENT = 5, 1, 80
#: Of pairs at exactly PERCENT, 0.998 share a band. Each minimum less in a band gives some twelve times the candidates that aren't alike, whose number grows with the square of the lines.
BANDS, BAND_ROWS = 21, 6
BLOCK = 1024
#: A line that stands more often than this posts its bands once for all; others once for each slice of texts.
HOT_LINE = 64
#: Posts of a bucket of keys, on average, and those beyond which it goes out in parts.
_BUCKET, _LONG_RUN = 1 << 19, 1 << 21
#: Cells of at most so many lines are compared many at a time.
_TOGETHER = 48
#: Shingles whose minima are taken at a time; a longer line stands alone.
_AT_ONCE = 1 << 17
_ODD = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 30, 128, dtype=np.uint32) * np.uint32(4) + np.uint32(3)


def normalised(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def _rolled(code: np.ndarray, factor: np.integer) -> np.ndarray:
    """A number for each run of SHINGLE characters."""
    h = code[: max(0, len(code) - SHINGLE + 1)]
    for k in range(1, SHINGLE):
        h = h * factor + code[k : len(code) - SHINGLE + 1 + k]
    return h


def bands(lines: list[str], count: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """Band keys (lines, count), int64, of lines of at least SHINGLE characters."""
    code = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(x) for x in lines])
    h = _rolled(code, np.uint32(0x2C1B3C6D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x297A2D39)
    h ^= h >> np.uint32(14)
    sizes = np.diff(ends, prepend=0) - SHINGLE + 1
    h = h[textscan.ranges(ends - sizes - SHINGLE + 1, sizes)]
    first = np.cumsum(sizes) - sizes
    least = np.empty((count * rows, len(lines)), np.uint32)
    for i, j in textscan.slices(np.append(first, len(h)), _AT_ONCE):
        own, cut = h[first[i] : first[j] if j < len(lines) else len(h)], first[i:j] - first[i]
        product = np.empty_like(own)
        for k in range(count * rows):
            np.multiply(own, _ODD[k], out=product)
            np.minimum.reduceat(product, cut, out=least[k, i:j])
    key = least[::rows].astype(np.uint64)
    for r in range(1, rows):
        key = textscan.mix(key + np.uint64(0x9E3779B97F4A7C15)) + least[r::rows]
    return np.ascontiguousarray(textscan.mix(key * np.uint64(64) + np.arange(count, dtype=np.uint64)[:, None]).T).view(np.int64)


def shingles(line: str) -> np.ndarray:
    """Sorted distinct hashes of a line's character shingles."""
    code = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.unique(textscan.mix(_rolled(code, np.uint64(0xD1342543DE82EF95)))) if len(code) >= SHINGLE else np.zeros(0, np.uint64)


def _rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _signed(rows: DataFrame, count: int, band_rows: int) -> DataFrame:
    """(doc_id, text_key, line_no, line, bands) for each line that counts; line is its hash.

    bands are null under one shingle, and for a line that the same slice of texts has already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            textscan.forget()
            data, offsets = textscan.spans(b.column("text"))
            for i, j in textscan.slices(offsets, 1 << 17):
                doc, no, key, place = [], [], [], []
                texts: dict[int, str] = {}
                for d in range(i, j):
                    for k, line in enumerate(data[offsets[d] : offsets[d + 1]].tobytes().split(b"\n")):
                        own = normalised(line)
                        if len(own) < LEAST_CHARS:
                            continue
                        h = xxhash.xxh3_64_intdigest(own)
                        first = h not in texts and len(text := own.decode()) >= SHINGLE
                        place.append(len(texts) if first else None)
                        if first:
                            texts[h] = text
                        doc.append(d)
                        no.append(k)
                        key.append(h)
                if doc:
                    at, band = pa.array(doc), bands(list(texts.values()), count, band_rows) if texts else np.zeros((0, count), np.int64)
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * count), len(texts), [None, pa.py_buffer(np.ascontiguousarray(band))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("text_key").take(at), pa.array(no, pa.int32()), pa.array(np.array(key, np.uint64).view(np.int64)), raw.take(pa.array(place, pa.int64()))], names=["doc_id", "text_key", "line_no", "line", "bands"])
            textscan.release()

    return rows.mapInArrow(run, "doc_id long, text_key long, line_no int, line long, bands binary")


def _posts(lines: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, line) of each line with bands, whose keys stand in key as bytes. hot: lines that post once only."""
    signed = lines.filter("bands is not null").select(F.col("bands").alias("key"), "line")
    once = signed.join(hot, "line", "left_semi").groupBy("line").agg(F.min("key").alias("key"))
    return signed.join(hot, "line", "left_anti").unionByName(once)


def _shared(posts: DataFrame, most: int = 0) -> DataFrame:
    """The posts (key, line) of keys with more than one line. key is one key, or the bytes of several.

    Tasks deal their posts out to buckets of keys, so what Spark moves and sorts are pieces of buckets, not posts. ``most``
    posts make as many buckets as hold _BUCKET each; one that is much larger goes out in parts.
    """
    n = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = n * max(1, -(-most // (n * _BUCKET)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0

        def out() -> pa.RecordBatch:
            key, line = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (((textscan.mix(key.view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            pairs = np.stack((key[order], line[order]), 1)
            own, first = np.unique(bucket[order], return_index=True)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(np.append(first, len(order)) * 16), pa.py_buffer(pairs)])
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), raw.cast(pa.binary())], names=["bucket", "posts"])

        for b in batches:
            key, line = b.column("key"), b.column("line").to_numpy()
            if pa.types.is_integer(key.type):
                key = key.to_numpy()
            else:
                data, offsets = textscan.spans(key)
                key, line = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.int64), np.repeat(line, np.diff(offsets) // 8)
            held.append((key, line))
            many += len(key)
            if many >= 1 << 20:
                yield out()
                held, many = [], 0
        if many:
            yield out()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # posts of a bucket, which may still be alone with their keys
        size, room, last = 0, _LONG_RUN, None
        given = np.zeros(0, np.int64)  # keys of the bucket of which lines were given out before

        def chosen() -> pa.RecordBatch:
            """Of the posts held those of shared keys, each once; the others are held on."""
            nonlocal held, size, room, given
            key, line = np.concatenate(held).T
            ordered = np.sort(key)
            often = np.zeros(1 << 22, bool)  # by a hash, which leaves little to look at
            slot = (textscan.mix(key.view(np.uint64)) >> np.uint64(42)).astype(np.int32)
            often[(textscan.mix(np.concatenate((ordered[1:][ordered[1:] == ordered[:-1]], given)).view(np.uint64)) >> np.uint64(42)).astype(np.int32)] = True
            at = np.flatnonzero(often[slot])
            at = at[np.lexsort((line[at], key[at]))]
            k, x = key[at], line[at]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
            at, k, x = at[new], k[new], x[new]
            same = k[1:] == k[:-1]
            keep = (np.append(same, False) | np.insert(same, 0, False))[: len(k)] | np.isin(k, given)
            alone = ~often[slot]
            alone[at[~keep]] = True
            given = np.union1d(given, k[keep])
            held = [np.stack((key[alone], line[alone]), 1)]
            size = len(held[0])
            room = _LONG_RUN + 2 * size
            return pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(x[keep])], names=["key", "line"])

        for b in batches:
            for bucket, raw in zip(b.column("bucket").to_pylist(), b.column("posts"), strict=True):
                if bucket != last:
                    if size:
                        yield chosen()
                    held, size, room, last, given = [], 0, _LONG_RUN, bucket, given[:0]
                held.append(np.frombuffer(raw.as_py(), np.int64).reshape(-1, 2))
                size += len(held[-1])
                if size > room:
                    yield chosen()
        if size:
            yield chosen()
        textscan.release()

    moved = posts.mapInArrow(dealt, "bucket int, posts binary").repartitionById(n, F.col("bucket"))
    return moved.sortWithinPartitions("bucket").mapInArrow(gathered, "key long, line long")


def _line_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, its normalised text compressed). wanted: line with the document and number of one such line."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array([pack.compress(x.as_buffer()) for x in b.column("text")], pa.binary())], names=["doc_id", "text_key", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for b in batches:
            key, text = [], []
            for raw, found in zip(b.column("packed").to_pylist(), b.column("found").to_pylist(), strict=True):
                lines = unpack.decompress(raw).split(b"\n")
                for x in found:
                    key.append(x["line"])
                    text.append(pack.compress(normalised(lines[x["line_no"]])))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(text, pa.binary())], names=["line", "packed"])

    asked = wanted.groupBy("at.doc_id", "at.text_key").agg(F.collect_list(F.struct(F.col("at.line_no").alias("line_no"), "line")).alias("found"))
    texts = rows.mapInArrow(packed, "doc_id long, text_key long, packed binary")
    both = texts.join(asked, texts.doc_id.eqNullSafe(asked.doc_id) & (texts.text_key == asked.text_key)).select("packed", "found")
    return both.mapInArrow(run, "line long, packed binary")


class Sets:
    """The sets of shingles of some lines, all sorted at once: a set's number stands before the upper bits of its shingles' hashes."""

    def __init__(self, lines: list[str], pairs: int):
        """pairs: how many pairs will be compared at a time."""
        sizes = np.maximum(np.array([len(x) for x in lines], np.int64) - SHINGLE + 1, 0)
        ends = np.cumsum([len(x) for x in lines])
        h = _rolled(np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64), np.uint64(0xD1342543DE82EF95))
        bits = int(max(len(lines), pairs)).bit_length()
        self.top = np.uint64(64 - bits)
        low = textscan.mix(h[textscan.ranges(ends - sizes - (SHINGLE - 1) * (sizes > 0), sizes)]) >> np.uint64(bits)
        own = np.sort((np.repeat(np.arange(len(lines)), sizes).astype(np.uint64) << self.top) | low)
        own = own[np.insert(own[1:] != own[:-1], 0, True)] if len(own) else own
        self.offsets = np.append(np.searchsorted(own, np.arange(len(lines)).astype(np.uint64) << self.top), len(own))
        self.members = own & ((np.uint64(1) << self.top) - np.uint64(1))
        self.counts = np.diff(self.offsets)

    def _may(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Pairs that aren't ruled out: no two sets share more members than the smaller counts of their members by some bits sum to."""
        place = np.repeat(np.arange(len(self.counts)), self.counts) << 8 | (self.members >> (self.top - np.uint64(8))).astype(np.int64)
        tally = np.bincount(place, minlength=len(self.counts) << 8).astype(np.int32).reshape(-1, 256)
        most = np.concatenate([np.minimum(tally[a[k : k + 4096]], tally[b[k : k + 4096]]).sum(1) for k in range(0, len(a), 4096)])
        return 100 * most >= percent * (self.counts[a] + self.counts[b] - most)

    def similar(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of sets are at the threshold: equal members of a pair stand side by side."""
        out = np.zeros(len(a), bool)
        near = np.flatnonzero(self._may(a, b, percent)) if len(a) else np.zeros(0, np.int64)
        a, b = a[near], b[near]
        pair = np.arange(len(a), dtype=np.uint64) << self.top
        runs = [np.repeat(pair, self.counts[x]) | self.members[textscan.ranges(self.offsets[x], self.counts[x])] for x in (a, b)]
        both = np.sort(np.concatenate(runs), kind="stable")  # merges the two
        common = np.bincount((both[1:][both[1:] == both[:-1]] >> self.top).astype(np.int64), minlength=len(a))
        out[near] = (common > 0) & (100 * common >= percent * (self.counts[a] + self.counts[b] - common))
        return out


def similar(left: list[str], right: list[str], percent: int) -> np.ndarray:
    """Which pairs of lines have sets of shingles at the threshold."""
    if not left:
        return np.zeros(0, bool)
    place = {x: k for k, x in enumerate(dict.fromkeys([*left, *right]))}
    a, b = (np.array([place[x] for x in side], np.int64) for side in (left, right))
    return Sets(list(place), len(left)).similar(a, b, percent)


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (line, hub) those that are similar. A line's text goes to its hub's."""
    left = pairs.join(texts, "line").select("line", "hub", F.col("packed").alias("a"))
    both = left.join(texts.select(F.col("line").alias("hub"), F.col("packed").alias("b")), "hub").select("line", "hub", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            lines = [[unpack.decompress(x.as_py()).decode() for x in b.column(c)] for c in ("a", "b")]
            chars = np.cumsum([0, *(len(x) + len(y) for x, y in zip(*lines, strict=True))])
            for i, j in textscan.slices(chars, 1 << 19):
                ok = similar(lines[0][i:j], lines[1][i:j], percent)
                yield b.select(["line", "hub"]).slice(i, j - i).filter(pa.array(ok))
        textscan.release()

    return both.mapInArrow(run, "line long, hub long")


def _links(listed: DataFrame, texts: DataFrame, percent: int, block: int) -> DataFrame:
    """A spanning forest of the verified links in each band's lines (key, line, size, component), where several components are left."""
    mixed = listed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
    blocks = F.ceil(F.col("size") / block).cast("int")
    cells = listed.join(mixed, "key", "left_semi").withColumn("own", F.pmod(F.xxhash64("line"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = cells.select("line", "component", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))
    rows = cells.join(texts, "line").select("cell", "line", "component", "left", "right", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: list[tuple[np.ndarray, list[str], np.ndarray, np.ndarray]] = []  # small cells: lines, texts, pairs
        many = 0

        def links(line: np.ndarray, label: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
            moved = np.flatnonzero(label != known)
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(line[moved]), pa.array(line[label[moved]])], names=["u", "v"])

        def together() -> Iterator[pa.RecordBatch]:
            at = np.cumsum([0, *(len(x[0]) for x in held)])
            a, b = (np.concatenate([x[k] + o for x, o in zip(held, at[:-1], strict=True)]) for k in (2, 3))
            ok = Sets([t for x in held for t in x[1]], len(a)).similar(a, b, percent)
            line = np.concatenate([x[0] for x in held])
            hi, lo = contract(line[a[ok]], line[b[ok]])
            if len(hi):
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], names=["u", "v"])

        for cell in _runs(batches, "cell"):
            line = cell.column("line").to_numpy()
            _, one = np.unique(line, return_index=True)
            if len(one) < len(line):
                cell, line = cell.take(pa.array(one)), line[one]
            component = cell.column("component").to_numpy()
            left, right = (cell.column(k).to_numpy(zero_copy_only=False) for k in ("left", "right"))
            text = [unpack.decompress(x.as_py()).decode() for x in cell.column("packed")]
            if len(line) <= _TOGETHER:
                a, b = np.nonzero(np.triu((left[:, None] & right) | (right[:, None] & left), 1) & (component[:, None] != component))
                if len(a):
                    held.append((line, text, a, b))
                    many += sum(map(len, text)) * len(line)
                if many > 1 << 20:
                    yield from together()
                    held, many = [], 0
                continue
            _, first, which = np.unique(component, return_index=True, return_inverse=True)
            if len(first) > 1 and left.any() and right.any():
                known = first[which]
                yield from links(line, linked([shingles(x) for x in text], np.flatnonzero(left), np.flatnonzero(right), percent, known), known)
        if held:
            yield from together()

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long")


def removed_lines(documents: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", count: int = BANDS, band_rows: int = BAND_ROWS, block: int = BLOCK, hot_line: int = HOT_LINE) -> DataFrame:
    """(doc_id, text_key, removed): the numbers of the lines to remove, per document that loses any.

    text_key tells documents with the same id apart.
    """
    rows = _rows(documents, id_col, text_col)
    lines = storage.stored(_signed(rows, count, band_rows), "lines")
    at = F.struct("doc_id", "text_key", "line_no")
    own = lines.select("line", "doc_id", "text_key", "line_no")
    # each line once, with the first place at which it stands
    distinct = storage.stored(own.groupBy("line").agg(F.count("*").alias("n"), F.min(at).alias("at")), "distinct")
    hot = storage.small(distinct.filter(F.col("n") > hot_line).select("line"))
    members = storage.stored(_shared(_posts(lines, hot), count * lines.count()), "members")
    lists = members.groupBy("key").agg(F.count("*").alias("size"), F.min("line").alias("hub"), F.sum(F.xxhash64("line").cast("decimal(20,0)")).alias("a"), F.bit_xor(F.xxhash64("line", F.lit(1))).alias("b"))
    lists = lists.groupBy("size", "a", "b").agg(F.min("key").alias("key"), F.min("hub").alias("hub")).select("key", "size", "hub")
    listed = storage.stored(members.join(lists, "key"), "listed")
    texts = storage.stored(_line_texts(rows, distinct.join(listed.select("line").distinct(), "line").select("line", "at")), "line_texts")
    pairs = listed.filter("line <> hub").select("line", "hub").distinct()
    first = storage.stored(_confirmed(pairs, texts, percent).select(F.col("line").alias("u"), F.col("hub").alias("v")), "confirmed")
    # a band of two lines is done; in larger ones those not like the smallest may be like others
    joined = first.select(F.col("u").alias("line"), F.col("v").alias("hub"), F.lit(True).alias("like"))
    larger = listed.filter("size > 2").join(joined, ["line", "hub"], "left").select("key", "line", "size", F.when(F.col("like"), F.col("hub")).otherwise(F.col("line")).alias("component"))
    larger = storage.stored(larger, "larger")
    forest = storage.stored(_links(larger, texts, percent, block), "forest")
    groups = storage.stored(components(first.unionByName(forest)), "groups")
    storage.drop(members, listed, texts, first, larger, forest)
    # lines that stand alone and have no like are done
    placed = distinct.join(groups, F.col("line") == F.col("node"), "left").filter("n > 1 or component is not null").select("line", "at", F.coalesce("component", "line").alias("group"))
    placed = storage.stored(placed, "placed")
    firsts = placed.groupBy("group").agg(F.min("at").alias("first"))
    losing = storage.small(placed.join(firsts, "group").select("line", "first"))
    storage.drop(distinct, groups, placed)
    again = own.join(losing, "line").filter(~at.eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def _with_removed(rows: DataFrame, found: DataFrame) -> DataFrame:
    right = found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "removed")
    out = rows.join(right, rows.doc_id.eqNullSafe(right.d) & (rows.text_key == right.k), "left").drop("d", "k")
    return out.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))


def line_report(documents: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and removed (line numbers from 0, ascending), one row per row."""
    rows = _rows(documents, id_col, text_col)
    counted = rows.select("doc_id", "text_key", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    found = _with_removed(counted, removed_lines(documents, percent, id_col, text_col))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def deduplicated(documents: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, without the removed lines. A text that loses nothing comes back unchanged, null too."""
    names = documents.columns
    keyed = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    found = _with_removed(keyed, removed_lines(documents, percent, id_col, text_col))
    text = F.col(f"row.`{text_col}`")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(F.col("removed"), i)), "\n")
    new = F.when(F.size("removed") > 0, kept).otherwise(text)
    return found.select(*[(new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names])
