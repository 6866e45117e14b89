"""Token-ID output: Re-Pair compressed shards with random access to any document.

``write`` encodes whole texts, orders documents by id over range partitions and writes them in
shards of at most about SHARD_TOKENS ids. In a shard, frequent id pairs are replaced by
nonterminals again and again; no pair reaches over a document's end, so that a document is a
range of symbols of its own. A shard holds its rules, the expansion length of each rule and
where each document's symbols start, so ``expand`` decodes one document without the others.

Shards are rows of a Parquet table (shard, first_doc, n_docs, n_tokens, bytes), written by
Spark's own committer: a lost executor leaves no half-written shard.

Layout of the bytes, all little-endian: magic "RPS1", then uint32 base (ids from there on are
nonterminals), symbol width in bytes (2 or 4), rules, documents, symbols; uint32 pairs of the
rules; uint32 expansion lengths of the rules; int64 document ids (their null flags as uint8
after them); uint32 ids per document; uint32 symbols per document; the symbols.

Defined results: null and empty texts hold the end id alone; repeated ids stay together in the
order of their ids' bytes; null document ids come first; an empty table writes an empty table.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import storage, textscan

SHARD_TOKENS = 1 << 20
END_ID = 1
#: Words whose ids a worker keeps; a full store becomes the older of two.
WORDS = 400_000
#: Rules that a round adds at most. Rounds end when no pair stands LEAST_COUNT times (a rule takes 12 bytes and saves two at each) or symbols of two bytes run out.
RULES_PER_ROUND, LEAST_COUNT = 8192, 7
_MAGIC = b"RPS1"
_SLICE = 5 << 20
#: Lower-case letters a-z and those of Latin-1, in UTF-8: no normalizer of lower case and composed forms changes them.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_TAIL = np.isin(np.arange(256), [*range(0x9F, 0xB7), *range(0xB8, 0xC0)])
#: Words that go through the tokenizer as one text, and what stands between those that aren't plain: a piece of its own for any pre-tokenizer by white space.
_TOGETHER, _BETWEEN = 1000, "\x01"
#: Signs that are no letters to any pre-tokenizer by letters, but for those of contractions and special tokens.
_MARK = np.isin(np.arange(256), list(b'.,!?;:*#$%&"()[]{}+-=/@^_~`'))

#: How byte-level tokenizers write bytes: those that aren't printable in Latin-1 have letters from 256 on. Spaces stay, to part words.
_LETTERS = np.arange(256, dtype="<u4")
_LETTERS[[b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]] = 256 + np.arange(68)
_LETTERS[32] = 32

SHARD_SCHEMA = "shard long, first_doc long, n_docs long, n_tokens long, bytes binary"


_stores: dict[str, WordStore] = {}
textscan.kept.append(_stores)


def word_store(path: str) -> WordStore:
    """The worker's store for this tokenizer, which later tasks of the worker find filled."""
    if path not in _stores:
        textscan.forget()
        _stores[path] = WordStore(path)
    return _stores[path]


class WordStore:
    """Ids of texts from stored ids of their words.

    For tokenizers whose pre-tokenizer drops white space and lower-cases: the ids of a text are
    then those of its words, one after the other.
    """

    def __init__(self, path: str, most: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tok = Tokenizer.from_file(path)
        # a plain word passes the normalizer as it is, and the pre-tokenizer whole, its bytes written as letters
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = WhitespaceSplit()
        for tok in (self.tok, self.bare):
            tok.no_truncation()
            tok.no_padding()
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for x, i in self.tok.get_vocab().items() if x.endswith(suffix)]] = True
        self.between = self.tok.encode(_BETWEEN, add_special_tokens=False).ids
        self.most, self.new, self.old = most, {}, {}

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids' bytes of each word; words that the store lacks are learned."""
        ids = list(map(self.new.get, words))
        missing = [w for w, x in zip(words, ids, strict=True) if x is None]
        if not missing:
            return ids
        if len(self.new) + len(missing) > self.most:
            self.old, self.new = self.new, {w: x for w, x in zip(words, ids, strict=True) if x is not None}
        self.new.update((w, x) for w, x in zip(missing, map(self.old.get, missing), strict=True) if x is not None)
        fresh = list(dict.fromkeys(w for w in missing if w not in self.new))
        plain, rest = [], []
        for w in fresh:
            (plain if _PLAIN(w) else rest).append(w)
        for k in range(0, len(plain), _TOGETHER):
            self._learn_plain(plain[k : k + _TOGETHER])
        for k in range(0, len(rest), _TOGETHER):
            self._learn_rest(rest[k : k + _TOGETHER])
        return list(map(self.new.__getitem__, words))

    def _learn_plain(self, words: list[bytes]) -> None:
        """Plain words: each ends with the only one of its ids that ends a word."""
        ids = np.array(self.bare.encode_batch_fast([_LETTERS[np.frombuffer(b" ".join(words), np.uint8)].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, self.kind)
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) == len(words):
            self._store(words, ids, cut)
        else:  # no such ends in this vocabulary
            self._learn_singly(words)

    def _learn_rest(self, words: list[bytes]) -> None:
        """Any words: the ids of a sign that none of them holds stand after each."""
        if len(self.between) != 1 or any(_BETWEEN.encode() in w for w in words):
            self._learn_singly(words)
            return
        text = "".join([f"{w.decode()} {_BETWEEN} " for w in words])
        ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        cut = np.flatnonzero(ids == self.between[0])
        if len(cut) != len(words):
            self._learn_singly(words)
            return
        self._store(words, np.delete(ids, cut), cut - np.arange(len(cut)))

    def _learn_singly(self, words: list[bytes]) -> None:
        ids = [e.ids for e in self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        self._store(words, np.fromiter(chain.from_iterable(ids), self.kind), np.cumsum([len(x) for x in ids]))

    def _store(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, at = ids.tobytes(), 0
        for w, e in zip(words, (ends * self.kind.itemsize).tolist(), strict=True):
            self.new[w] = raw[at:e]
            at = e

    def encode_column(self, column: pa.Array, end_id: int) -> Iterator[bytes]:
        """The ids' bytes of each text, with the end id. A slice's distinct words are looked up once each."""
        data, offsets = textscan.spans(column)
        end = np.array([end_id], self.kind).tobytes()
        for i, j in textscan.slices(offsets, _SLICE):
            o = offsets[i : j + 1] - offsets[i]
            for ids in self._encode(data[offsets[i] : offsets[j]], o):
                yield ids + end

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        if not any(x in data.tobytes() for x in (b"<|", b"\xcc", b"\xcd")):  # special tokens have a case of their own, and marks may join lower-case letters alone
            data = textscan.lowered(data)
            latin = np.flatnonzero(data == 0xC3) + 1
            latin = latin[(data[latin] <= 0x9E) & (data[latin] != 0x97)]
            data[latin] += np.uint8(32)
        start, end = _words(data, offsets)
        first, which = _distinct(textscan.hashes(data, start, end), end - start)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        ids = self.ids_of(words)
        flat = np.frombuffer(b"".join(ids), self.kind)
        counts = np.array([len(x) for x in ids], np.int64) // self.kind.itemsize
        starts = np.cumsum(counts) - counts
        out = flat[textscan.ranges(starts[which], counts[which])]
        bounds = np.concatenate(([0], np.cumsum(counts[which])))[np.searchsorted(start, offsets)].tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield out[a:b].tobytes()


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs between white space; end marks after a plain letter at a word's end are a word of their own."""
    start, end = textscan.word_spans(data, offsets, textscan.SPACED)
    if not len(start):
        return start, end
    place = np.where(_MARK[data], 0, np.arange(1, len(data) + 1))
    body = np.maximum(np.maximum.accumulate(place)[end - 1], start)  # after the last byte that is no mark
    cut = (body > start) & (body < end)
    before = data[body[cut] - 1]
    cut[cut] = ((before >= 97) & (before <= 122)) | (_TAIL[before] & (data[np.maximum(body[cut] - 2, 0)] == 0xC3) & (body[cut] - 2 >= start[cut]))
    return np.sort(np.concatenate((start, body[cut]))), np.sort(np.concatenate((end, body[cut])))


def _distinct(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct word stands first, and which of them every word is. Words are told apart by 64-bit hash and length."""
    order = np.argsort(hashes, kind="stable")
    h, n = hashes[order], lengths[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (n[1:] != n[:-1])
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def repair(symbols: np.ndarray, last: np.ndarray, base: int, per_round: int = RULES_PER_ROUND, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (uint32) with frequent pairs replaced, their flags of a document's end, and the rules.

    last flags the ends of documents; a flagged symbol is never the left of a pair. In each round
    up to per_round of the most frequent pairs become rules; overlapping occurrences are taken
    from the left, every second one. Rounds end when no pair stands ``least`` times, or there are
    no numbers for rules left.
    """
    rules: list[np.ndarray] = []
    n_rules, room = 0, (1 << 16) - base if base < 1 << 16 else (1 << 31) - base
    while len(symbols) > 1 and n_rules < room:
        key = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:] if base + n_rules > 1 << 16 else symbols[:-1] * np.uint32(1 << 16) + symbols[1:]
        free = np.flatnonzero(~last[:-1])
        key = key[free]
        if key.dtype == np.uint32:  # pair and place as one number: a sort gives where each pair stands
            ordered = np.sort(key.astype(np.uint64) << np.uint64(32) | free.astype(np.uint64))
            place, ordered = (ordered & np.uint64(0xFFFFFFFF)).astype(np.int64), (ordered >> np.uint64(32)).astype(np.uint32)
        else:
            order = np.argsort(key, kind="stable")
            place, ordered = free[order], key[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(counts >= least)
        often = np.sort(often[np.argsort(-counts[often], kind="stable")[: min(per_round, room - n_rules)]])
        if not len(often):
            break
        chosen = ordered[first[often]]
        rule = np.full(len(symbols), -1, np.int32)
        rule[place[textscan.ranges(first[often], counts[often])]] = np.repeat(np.arange(len(often), dtype=np.int32), counts[often])
        at = np.flatnonzero(rule >= 0)
        # of each run of neighbouring occurrences every second one
        begins = np.concatenate(([True], np.diff(at) != 1))
        run = np.flatnonzero(begins)
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        shift = np.uint64(32) if chosen.dtype == np.uint64 else np.uint32(16)
        left, right = chosen >> shift, chosen & ((type(shift)(1) << shift) - type(shift)(1))
        rules.append(np.stack((left, right), 1).astype(np.uint32))
        symbols = symbols.copy()
        last = last.copy()
        symbols[at] = rule[at].astype(np.uint32) + np.uint32(base + n_rules)
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
        n_rules += len(chosen)
    return symbols, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def pack(doc_ids: list[int | None], ids: list[np.ndarray], base: int) -> bytes:
    """The bytes of a shard."""
    counts = np.array([len(x) for x in ids], np.uint32)
    last = np.zeros(int(counts.sum()), bool)
    last[np.cumsum(counts.astype(np.int64)) - 1] = True
    symbols, last, rules = repair(np.concatenate(ids).astype(np.uint32), last, base)
    lengths: list[int] = []
    for x, y in rules.tolist():
        lengths.append((1 if x < base else lengths[x - base]) + (1 if y < base else lengths[y - base]))
    width = 2 if base + len(rules) <= 1 << 16 else 4
    ends = np.flatnonzero(last)
    head = _MAGIC + struct.pack("<5I", base, width, len(rules), len(ids), len(symbols))
    return b"".join(
        [head, rules.astype("<u4").tobytes(), np.array(lengths, "<u4").tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), counts.astype("<u4").tobytes(), np.diff(ends, prepend=-1).astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes()]
    )


class Shard:
    """A shard's bytes, with random access to its documents."""

    def __init__(self, raw: bytes):
        if raw[:4] != _MAGIC:
            raise ValueError("not a shard")
        self.base, width, n_rules, n_docs, n = struct.unpack_from("<5I", raw, 4)
        at = 24

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.counts = take("<u4", n_docs)
        self.ends = np.cumsum(take("<u4", n_docs).astype(np.int64))
        self.symbols = take(f"<u{width}", n)
        self._expanded: tuple[np.ndarray, np.ndarray] | None = None

    def _rules(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rules, one after the other, and where each starts."""
        if self._expanded is None:
            flat = self.rules.ravel().astype(np.int64)
            while (open_ := flat >= self.base).any():  # each nonterminal by its two symbols, as often as rules are deep
                at = np.cumsum(1 + open_) - (1 + open_)
                out = np.empty(len(flat) + int(open_.sum()), np.int64)
                out[at] = np.where(open_, self.rules[np.where(open_, flat - self.base, 0), 0], flat)
                out[at[open_] + 1] = self.rules[flat[open_] - self.base, 1]
                flat = out
            self._expanded = flat.astype(np.uint32), np.concatenate(([0], np.cumsum(self.lengths.astype(np.int64))))
        return self._expanded

    def expand(self, i: int, j: int) -> np.ndarray:
        """The ids of documents i to j (not included), uint32."""
        flat, starts = self._rules()
        s = self.symbols[int(self.ends[i - 1]) if i else 0 : int(self.ends[j - 1]) if j else 0].astype(np.int64)
        rule = s >= self.base
        counts = np.ones(len(s), np.int64)
        counts[rule] = self.lengths[s[rule] - self.base]
        out = np.zeros(int(counts.sum()), np.uint32)
        first = np.cumsum(counts) - counts
        out[first[~rule]] = s[~rule]
        out[textscan.ranges(first[rule], counts[rule])] = flat[textscan.ranges(starts[s[rule] - self.base], counts[rule])]
        return out


def write(documents: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the shards of all documents to path.

    Documents go to ``shards`` range partitions (spark.sql.shuffle.partitions of them unless
    given), whose bounds come from quantiles of the ids, so texts are encoded only once and
    only compressed ids are moved.
    """
    spark = documents.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = documents.select(F.col(id_col).cast("long").alias("doc_id"))
    bounds = sorted(set(ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    base = _vocabulary(tokenizer_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, pack_ids = word_store(tokenizer_path), zstandard.ZstdCompressor(level=1)
        for b in batches:
            own = b.column("doc_id").to_numpy(zero_copy_only=False)
            where = np.searchsorted(np.array(bounds), np.nan_to_num(own.astype(float), nan=-np.inf), "right")
            packed = [pack_ids.compress(x) for x in store.encode_column(b.column("text"), end_id)]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), b.column("doc_id"), pa.array(packed, pa.binary())], names=["part", "doc_id", "ids"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, kind = zstandard.ZstdDecompressor(), np.dtype("<u2" if base <= 1 << 16 else "<u4")
        docs, held, size, part, k = [], [], 0, 0, 0

        def out() -> pa.RecordBatch:
            row = {"shard": [(part << 32) + k], "first_doc": docs[:1], "n_docs": [len(docs)], "n_tokens": [size], "bytes": [pack(docs, held, base)]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int64()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.binary())]))

        for b in batches:
            for p, d, packed in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                x = np.frombuffer(unpack.decompress(packed.as_py()), kind)
                if docs and (size + len(x) > shard_tokens or p != part):
                    yield out()
                    docs, held, size, k = [], [], 0, k + 1
                part = p
                docs.append(d)
                held.append(x)
                size += len(x)
        if docs:
            yield out()

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    moved = rows.mapInArrow(encode, "part int, doc_id long, ids binary").repartitionById(n, F.col("part"))
    moved.sortWithinPartitions("doc_id", "ids").mapInArrow(shard, SHARD_SCHEMA).write.parquet(path)


def _vocabulary(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path).get_vocab_size()


def read_index(shards: DataFrame) -> DataFrame:
    """One row per document from the shards' bytes: doc_id, start, n_tokens, ids_crc32.

    The ids before a shard are a prefix sum over the range partitions (as many as were asked
    for, so bounded, on the driver) and over the shards of one partition.
    """
    spark = shards.sparkSession
    heads = shards.select(F.shiftright("shard", 32).alias("part"), "shard", "n_tokens")
    totals, before = {}, 0
    for r in heads.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toLocalIterator():
        totals[r.part] = before
        before += r.n
    from pyspark.sql import Window

    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = heads.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    starts = spark.createDataFrame(list(totals.items()) or [(0, 0)], "part long, before long")
    placed = base.withColumn("part", F.col("part").cast("long")).join(starts, "part").select("shard", (F.col("own") + F.col("before")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for before, raw in zip(b.column("before").to_pylist(), b.column("bytes"), strict=True):
                s = Shard(raw.as_py())
                counts = s.counts.astype(np.int64)
                start = before + np.cumsum(counts) - counts
                ids = s.expand(0, len(counts)).astype("<u4").tobytes()
                ends = np.cumsum(counts) * 4
                crc = [zlib.crc32(ids[e - 4 * c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(start), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(F.broadcast(placed) if _few(placed) else placed, "shard").select("before", "bytes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _few(placed: DataFrame, most: int = 100_000) -> bool:
    return placed.limit(most + 1).count() <= most


def read_ids(shards: DataFrame) -> DataFrame:
    """doc_id and the ids of every document, decoded from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("bytes"):
                s = Shard(raw.as_py())
                offsets = np.concatenate(([0], np.cumsum(s.counts.astype(np.int64))))
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), textscan.list_column(s.expand(0, len(s.counts)).astype(np.int32), offsets, pa.int32())], names=["doc_id", "ids"])

    return shards.select("bytes").mapInArrow(run, "doc_id long, ids array<int>")


def token_index(documents: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """write() to path (a new folder of the shared one unless given), then read_index() of what was written."""
    import uuid

    spark = documents.sparkSession
    path = path or f"{storage.shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write(documents, tokenizer_path, path, **options)
    return read_index(spark.read.schema(SHARD_SCHEMA).parquet(path))
