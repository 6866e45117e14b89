"""Near-duplicate documents by an inverted join over signature coordinates.

Every document is the set of its word shingles; its signature has COORDINATES values, each made
of MINIMA minima, so that common shingles alone give no match. A pair of documents at the
similarity threshold agrees in so many coordinates that at least ``least`` of them match but
for less than one in a million pairs. Documents are posted under each (coordinate,
value); to reach ``least`` matches two documents must share one of the COORDINATES - least + 1
postings that come first when each document orders its own by list length (the prefix), so the
longer lists are skipped: pairs found in a prefix are probed on the full sets at once.

Texts with the same set are one node from the start, and of lists with the same members one
stays. First every member is compared with its list's smallest one, on the full sets, and what
is linked becomes components. In lists that still hold several components all pairs of
signatures are compared, in blocks: members with a likely partner in another component are
kept, each pair in the first list both share, and only there texts come together and all pairs
are confirmed. No task writes pairs: it writes a row for a member or a spanning forest of links,
and what is returned follows from components.

A second signature (the first shingle in each of BINS ranges of hash values) makes the
comparison of signatures sharper; it is read off the sorted set.

Defined results: documents without words, empty and null texts have size 0 and no link; fewer
words than a shingle has make one shingle of them all; rows with the same id are one node, and
each row gives one result row; a null id is alone and gets a null component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import storage, textscan
from siftspark.llm.components import components

COORDINATES, MINIMA = 32, 3
#: Standard deviations below the expected matches at the threshold.
DEVIATIONS = 5.0
#: Members of a block of a list, and shingles of them; two blocks are compared in one task. Shared shingles and rows at a time.
BLOCK, BLOCK_SHINGLES, _COLUMNS, _ROWS, _FEW = 2048, 1 << 20, 2048, 512, 16
BINS = 128

_ODD = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 62, COORDINATES * MINIMA, dtype=np.uint64) * np.uint64(4) + np.uint64(3)


def least_matches(percent: int, coordinates: int = COORDINATES) -> int:
    s = (percent / 100) ** MINIMA
    return max(1, math.floor(coordinates * s - DEVIATIONS * math.sqrt(coordinates * s * (1 - s))))


def shingle_sets(w: textscan.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and offsets."""
    hashes, at = textscan.windows(w, n)
    doc = np.searchsorted(w.offsets, at, "right") - 1
    few = np.flatnonzero((np.diff(w.offsets) > 0) & (np.diff(w.offsets) < n))
    if len(few):
        # a document of fewer words is one shingle
        own = [textscan.mix(np.cumsum(w.hash[w.offsets[d] : w.offsets[d + 1]] * textscan.mix(np.arange(1, w.offsets[d + 1] - w.offsets[d] + 1).astype(np.uint64)))[-1:] + np.uint64(0xABCD)) for d in few.tolist()]
        hashes, doc = np.concatenate((hashes, *own)), np.concatenate((doc, few))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[keep], doc[keep]
    return hashes, np.searchsorted(doc, np.arange(len(w.offsets)))


def signatures(hashes: np.ndarray, offsets: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """One row of uint32 values per document; documents without shingles get zeros."""
    out = np.zeros((len(offsets) - 1, coordinates), np.uint32)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        starts = offsets[some]
        for j in range(coordinates):
            value = np.zeros(len(some), np.uint64)
            for odd in _ODD[MINIMA * j : MINIMA * j + MINIMA]:
                value = textscan.mix(value + np.minimum.reduceat(((hashes * odd) >> np.uint64(32)).astype(np.uint32), starts))
            out[some, j] = (value >> np.uint64(32)).astype(np.uint32)
    return out


def first_in_bins(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of BINS bytes: for each range of hash values a byte of the smallest shingle in it, 0 if there is none."""
    out = np.zeros((len(offsets) - 1, BINS), np.uint8)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bins = (hashes >> np.uint64(57)).astype(np.int64)
    place = doc * BINS + bins
    first = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
    out[doc[first], bins[first]] = ((hashes[first] >> np.uint64(30)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out


def _signed(documents: DataFrame, n: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, and the signature's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in textscan.scan(b.column("text"), textscan.SPACED, True):
                hashes, offsets = shingle_sets(w, n)
                total = np.concatenate((np.zeros((2, 1), np.uint64), np.cumsum(np.stack((hashes, textscan.mix(hashes ^ _ODD[0]))), axis=1)), axis=1)
                keys = (total[:, offsets[1:]] - total[:, offsets[:-1]]).view(np.int64)
                sig = np.concatenate((signatures(hashes, offsets, coordinates).view(np.uint8), first_in_bins(hashes, offsets)), axis=1)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * coordinates + BINS), j - i, [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(np.diff(offsets), pa.int64()), pa.array(keys[0]), pa.array(keys[1]), raw], names=["doc_id", "n_shingles", "k1", "k2", "sig"])

    return documents.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def _posts(classes: DataFrame, coordinates: int) -> DataFrame:
    """(key, rep) for each coordinate of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = np.arange(coordinates, dtype=np.uint64) << np.uint64(32)
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                sig = _matrix(part.column("sig"), coordinates)[0]
                yield pa.RecordBatch.from_arrays([pa.array((sig.astype(np.uint64) | which).view(np.int64).ravel()), pa.array(np.repeat(part.column("rep").to_numpy(), coordinates))], names=["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _matrix(column: pa.Array, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """Minima (rows, coordinates) and bin bytes (rows, BINS)."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 4 * coordinates + BINS)
    return np.ascontiguousarray(raw[:, : 4 * coordinates]).view(np.uint32), raw[:, 4 * coordinates :]


def _likely(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], na: np.ndarray, nb: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Pairs, row by row or one a against many b, whose sizes and signatures allow the threshold."""
    ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((a[0] == b[0]).sum(-1) >= least)
    used = ((a[1] | b[1]) > 0).sum(-1)
    same = ((a[1] == b[1]) & (a[1] > 0)).sum(-1)
    s = percent / 100
    return ok & (same >= s * used - DEVIATIONS * np.sqrt(used * s * (1 - s)))


def _lists(posts: DataFrame, coordinates: int, least: int) -> tuple[DataFrame, DataFrame]:
    """The prefixes (key, rep, mask of the coordinates in rep's prefix), and the lists (key, size) with two members or more.

    Lists of one member can't give a pair; they are not returned but count in the prefix, as
    the shortest. Of lists with the same members the one of the first coordinate stays.
    """
    prefix = coordinates - least + 1
    sizes = posts.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = posts.join(sizes, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("size", "key"))).alias("lists"))
    room = F.lit(prefix - coordinates) + F.size("lists")
    own = shared.filter(room > 0).select("rep", F.transform(F.slice("lists", F.lit(1), room), lambda x: x["key"]).alias("keys"))
    mask = F.aggregate("keys", F.lit(0).cast("long"), lambda m, k: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(k, 32).cast("int"))))
    members = storage.stored(own.select("rep", mask.alias("mask"), F.explode("keys").alias("key")), "members")
    lists = members.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("a"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("b")).filter("size > 1")
    return members, storage.stored(lists.groupBy("size", "a", "b").agg(F.min("key").alias("key")).select("key", "size"), "lists")


def _with_hubs(members: DataFrame, coordinates: int, least: int, percent: int) -> DataFrame:
    """Likely pairs (rep, hub) of each list's members with its smallest member."""
    hubs = members.groupBy("key").agg(F.min(F.struct("rep", "n", "sig")).alias("h"))
    paired = members.join(storage.stored(hubs, "hubs"), "key").filter("h.rep <> rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = _likely(_matrix(b.column("sig"), coordinates), _matrix(b.column("hsig"), coordinates), b.column("n").to_numpy(), b.column("hn").to_numpy(), least, percent)
                yield b.select(["rep", "hub"]).filter(pa.array(ok))

    return paired.select("rep", "n", "sig", F.col("h.rep").alias("hub"), F.col("h.n").alias("hn"), F.col("h.sig").alias("hsig")).mapInArrow(run, "rep long, hub long").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (rep, hub) whose full sets are similar enough. A member's text goes to its hub's."""
    left = pairs.join(texts, pairs.rep == texts.doc_id).select("rep", "hub", F.col("packed").alias("a"))
    both = left.join(texts, left.hub == texts.doc_id).select("rep", "hub", "a", F.col("packed").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def shingles(raw: bytes) -> np.ndarray:
            text = np.frombuffer(unpack.decompress(raw), np.uint8)
            return shingle_sets(textscan.words(text, np.array([0, len(text)]), textscan.SPACED, True), n)[0]

        last, held = None, None
        for b in batches:
            ok = []
            for hub, x, y in zip(b.column("hub").to_pylist(), b.column("a"), b.column("b"), strict=True):
                if hub != last:
                    last, held = hub, shingles(y.as_py())
                own = shingles(x.as_py())
                common = len(np.intersect1d(own, held, assume_unique=True))
                ok.append(100 * common >= percent * (len(own) + len(held) - common) > 0)
            yield b.select(["rep", "hub"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "rep long, hub long")


def _open(members: DataFrame, lists: DataFrame, coordinates: int, least: int, percent: int, block: int) -> DataFrame:
    """(cell, rep, k1, left, right): members with a likely partner in another component, in the first list that both share.

    A list of more than block members, or of more than BLOCK_SHINGLES shingles, is cut into
    blocks, and each pair of blocks is a cell, which is work of its own.
    """
    placed = members.join(lists, "key")
    mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.sum("n").alias("weight")).filter("a <> b").select("key", "weight")
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    cells = placed.join(storage.stored(mixed, "mixed"), "key").withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = cells.select("rep", "n", "k1", "sig", "mask", "component", F.shiftright("key", 32).cast("int").alias("coordinate"), F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = np.uint64(1) << np.arange(coordinates, dtype=np.uint64)
        for cell in _runs(batches, "cell"):
            order = np.argsort(cell.column("n").to_numpy(), kind="stable")
            cell = cell.take(pa.array(order))
            low, bins = _matrix(cell.column("sig"), coordinates)
            n, comp = cell.column("n").to_numpy(), cell.column("component").to_numpy()
            mask = (cell.column("mask").to_numpy().view(np.uint64)[:, None] & bit) > 0
            at = cell.column("coordinate")[0].as_py()
            use = np.zeros(len(n), bool)
            right = np.flatnonzero(cell.column("right").to_numpy(zero_copy_only=False))
            # sizes ascend, so possible partners are a range
            bounds = np.searchsorted(100 * n[right], percent * n, "left"), np.searchsorted(percent * n[right], 100 * n, "right")
            for i in np.flatnonzero(cell.column("left").to_numpy(zero_copy_only=False)).tolist():
                near = right[bounds[0][i] : bounds[1][i]]
                near = near[comp[near] != comp[i]]
                if not len(near):
                    continue
                near = near[_likely((low[i], bins[i]), (low[near], bins[near]), n[i], n[near], least, percent)]
                if len(near):
                    # the first list that both share is this one
                    both = (low[near] == low[i]) & mask[near] & mask[i]
                    near = near[both.argmax(1) == at]
                    if len(near):
                        use[i] = True
                        use[near] = True
            if use.any():
                out = cell.select(["cell", "rep", "k1", "left", "right"]).filter(pa.array(use))
                yield out if isinstance(out, pa.RecordBatch) else out.combine_chunks().to_batches()[0]

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "cell long, rep long, k1 long, left boolean, right boolean")


def _packed_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, the text's bytes compressed), for moving texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([pack.compress((x.as_py() or "").encode()) for x in b.column("text")], pa.binary())], names=["doc_id", "packed"])

    return documents.mapInArrow(run, "doc_id long, packed binary")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch | pa.Table]:
    """The rows of each value of a sorted column, as they come."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        values = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            if held and values[a] != last:
                yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(a, e - a))
            last = values[a]
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks()
    textscan.release()


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """For each of the sorted distinct sets the smallest place that it reaches by links of one of left and one of right.

    known: what is linked already, as such places.

    Sizes of intersections are products of 0/1 matrices over the members that more than one set
    has, some thousand columns at a time; float32 holds them exactly. The links of some hundred
    rows are joined before the next are computed, so no list of pairs grows with their number.
    """
    sizes = np.array([len(x) for x in sets])
    label = np.arange(len(sets)) if known is None else known.copy()

    def join(i: int, near: np.ndarray) -> None:
        old = np.append(label[near], label[i])
        if old.min() < old.max():
            gone = np.zeros(len(label), bool)
            gone[old] = True
            label[gone[label]] = old.min()

    if len(left) * len(right) <= _FEW:
        for i in left.tolist():
            for j in right.tolist():
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) if label[i] != label[j] else 0
                if both and 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    join(i, np.array([j]))
        return label
    members, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(sets)), sizes)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    use = shared[inverse]
    who, column = who[use], column[inverse[use]]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    del members, inverse, order
    for k in range(0, len(left), _ROWS):
        rows = left[k : k + _ROWS]
        common = np.zeros((len(rows), len(right)), np.float32)
        for c in range(0, int(shared.sum()), _COLUMNS):
            a, b = np.searchsorted(column, (c, c + _COLUMNS))
            m = np.zeros((len(sets), min(_COLUMNS, int(shared.sum()) - c)), np.float32)
            m[who[a:b], column[a:b] - c] = 1
            common += m[rows] @ m[right].T
        ok = (common > 0) & (100 * common >= percent * (sizes[rows][:, None] + sizes[right][None, :] - common))
        for r in np.flatnonzero(ok.any(axis=1)).tolist():
            join(int(rows[r]), right[ok[r]])
    return label


def _links(cells: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """A spanning forest (u, v) of the confirmed links in every cell, to which texts come along."""
    rows = cells.join(texts, F.col("rep") == F.col("doc_id")).select("cell", "rep", "k1", "left", "right", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for cell in _runs(batches, "cell"):
            text = [unpack.decompress(x.as_py()) for x in cell.column("packed")]
            offsets = np.cumsum([0, *map(len, text)])
            sets: list[np.ndarray] = []
            data = np.frombuffer(b"".join(text), np.uint8)
            for i, j in textscan.slices(offsets):
                hashes, o = shingle_sets(textscan.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], textscan.SPACED, True), n)
                sets += np.split(hashes, o[1:-1])
            # of rows with one id the one whose set is meant
            ok = np.array([len(x) > 0 and x.sum().view(np.int64) == k for x, k in zip(sets, cell.column("k1").to_numpy(), strict=True)])
            left, right = (np.flatnonzero(cell.column(k).to_numpy(zero_copy_only=False) & ok) for k in ("left", "right"))
            if len(left) and len(right):
                label = linked(sets, left, right, percent)
                moved = np.flatnonzero(label != np.arange(len(label)))
                if len(moved):
                    rep = cell.column("rep").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[label[moved]])], names=["u", "v"])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long")


def grouped(documents: DataFrame, shingle_words: int, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", coordinates: int = COORDINATES, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept, one row per row."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = storage.stored(_signed(docs, shingle_words, coordinates), "signatures")
    some = signed.filter("n_shingles > 0 and doc_id is not null")
    key = ["k1", "k2", "n_shingles"]
    classes = storage.stored(some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("many"), F.first("sig").alias("sig")), "classes")
    least = least_matches(percent, coordinates)
    prefixes, lists = _lists(_posts(classes, coordinates), coordinates, least)
    members = storage.stored(prefixes.join(lists.select("key"), "key", "left_semi").join(classes.select("rep", "n_shingles", "k1", "sig"), "rep").withColumnRenamed("n_shingles", "n"), "listed")
    likely = storage.stored(_with_hubs(members, coordinates, least, percent), "likely")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = storage.stored(_packed_texts(docs).join(wanted, "doc_id", "left_semi"), "texts")
    first = storage.stored(_confirmed(likely, texts, shingle_words, percent).select(F.col("rep").alias("u"), F.col("hub").alias("v")), "confirmed")
    placed = members.join(components(first).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_members = storage.stored(_open(placed, lists, coordinates, least, percent, block), "open")
    forest = storage.stored(_links(open_members, texts, shingle_words, percent), "forest")
    storage.drop(prefixes, lists, members, likely, texts, open_members)
    # rows with equal sets are linked to the smallest id of their class
    same = some.select("doc_id", *key).join(classes.filter("many > 1").select("rep", *key), key).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    final = components(first.unionByName(forest).unionByName(same))
    storage.drop(classes, first, forest)
    out = signed.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(documents: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, of which one row per group stays: that of the smallest id. Rows that repeat a kept id stay."""
    gone = storage.small(grouped(documents, shingle_words, percent, id_col, text_col).filter("not kept").select("doc_id").distinct())
    return documents.join(gone, documents[f"`{id_col}`"].cast("long") == gone["doc_id"], "left_anti")
