"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash over 16 bytes meets a condition, so equal passages give
equal chunks wherever they stand. A chunk is encoded once and its ids are reused for every
document of the worker that holds it (a bounded least-recently-used store). Chunk cuts may fall
inside what the tokenizer sees as one piece; a join is repaired by re-encoding the last piece
before the cut together with what follows it, up to the first place where a piece of the right
chunk must end too, so both encodings agree from there on.

Pieces are runs of white space followed by other characters. Byte-level pre-tokenizers with
the usual pattern always split between a character that isn't white space and one that is,
and what they match after such a place doesn't depend on what stands before, so the ids of a
text are those of its pieces, one after the other. Special tokens hold no white space.

Defined results: null and empty texts have no tokens; each row gives one result row, repeated
rows too; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import textscan

#: Unicode White_Space, which the tokenizers' patterns mean by \s.
_SPACE = "\t-\r \x85\xa0  -     　"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_IS_SPACE = re.compile(f"[{_SPACE}]")
#: A character that isn't white space before one that is.
_AGREE = re.compile(f"[^{_SPACE}][{_SPACE}]")
_LAST = re.compile(f"[^{_SPACE}](?=[{_SPACE}]+[^{_SPACE}]*\\Z)")

ROLL_BYTES = 16
#: A cut follows every 2**CUT_BITS-th byte on average.
CUT_BITS = 10
#: Bodies and pieces that a worker stores; a full store of pieces becomes the older of two.
CHUNKS, PIECES = 8192, 300_000
SLICE_BYTES = 1 << 17

_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Places at which chunks of the bytes end, each at a character's start; the end is not among them.

    The hash at a byte is that of the 16 bytes up to it, made by doubling: 1, 2, 4, 8, 16.
    """
    if len(data) <= ROLL_BYTES:
        return np.zeros(0, np.int64)
    h, width, k = _GEAR[data], 1, 0x85EBCA6B
    while width < ROLL_BYTES:
        h = h[width:] + h[:-width] * np.uint32(k)
        width, k = 2 * width, (k * k + 2) & 0xFFFFFFFF
    h ^= h >> np.uint32(15)
    at = np.flatnonzero((h & np.uint32((1 << bits) - 1)) == 0) + ROLL_BYTES
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


_stores: dict[tuple, Reuse] = {}
textscan.kept.append(_stores)


def reuse(path: str, chunks: int, bits: int) -> Reuse:
    """The worker's store for this tokenizer, which later tasks of the worker find filled."""
    key = (path, chunks, bits)
    if key not in _stores:
        textscan.forget()
        _stores[key] = Reuse(path, chunks, bits)
    return _stores[key]


class Reuse:
    """A tokenizer with a store of encoded chunks, and one of pieces for what is new in a chunk.

    A chunk is its first piece, its body and its last piece. The body's ids are stored; the
    last piece of a chunk and the first of the next are encoded together. Both stores are
    bounded; ids are kept as little-endian bytes.
    """

    def __init__(self, path: str, chunks: int = CHUNKS, bits: int = CUT_BITS, pieces: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.bodies: OrderedDict[str, bytes] = OrderedDict()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most, self.bits, self.most_pieces = chunks, bits, pieces
        self.decimal = [b"%d" % i for i in range(size)]
        self.bytes = _byte_table(self.tok)
        self.encoded_chars = self.reused_chars = 0

    def _learn(self, pieces: set[str]) -> None:
        missing = pieces.difference(self.new)
        if not missing:
            return
        if len(self.new) + len(missing) > self.most_pieces:
            self.old, self.new, missing = self.new, {}, pieces
        fresh = []
        for p in missing:
            if (known := self.old.get(p)) is not None:
                self.new[p] = known
            else:
                fresh.append(p)
        ids = [e.ids for e in self.tok.encode_batch_fast(fresh, add_special_tokens=False)]
        flat, at = np.fromiter(chain.from_iterable(ids), self.kind).tobytes(), 0
        for p, x in zip(fresh, ids, strict=True):
            self.new[p] = flat[at : (at := at + self.kind.itemsize * len(x))]

    def _encode(self, texts: list[str]) -> list[bytes]:
        pieces = [_PIECE.findall(x) for x in texts]
        self._learn({p for x in pieces for p in x})
        get = self.new.__getitem__
        return [b"".join(map(get, x)) for x in pieces]

    def _parts(self, raw: bytes) -> list[tuple[str, bool]]:
        """The text as bodies of chunks (True) and repaired joins (False), split only between pieces."""
        at = cuts(np.frombuffer(raw, np.uint8), self.bits).tolist()
        parts, tail = [], ""
        for a, b in zip([0, *at], [*at, len(raw)], strict=True):
            text = raw[a:b].decode()
            if tail and _IS_SPACE.match(tail[-1]) is None and _IS_SPACE.match(text) is not None:
                parts.append((tail, False))  # the cut is between two pieces: both sides agree
                head = 0
            else:
                # encoding over the cut goes on up to the first place where both sides agree
                found = _AGREE.search(text)
                if found is None:
                    tail += text
                    continue
                head = found.start() + 1
                parts.append((tail + text[:head], False))
            last = _LAST.search(text, max(head, len(text) - 120)) or _LAST.search(text, head)
            end = last.start() + 1 if last else head
            parts.append((text[head:end], True))
            tail = text[end:]
        parts.append((tail, False))
        return [x for x in parts if x[0]]

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        texts = [self._parts(raw) for raw in raws]
        wanted = dict.fromkeys(x for parts in texts for x in parts)
        bodies = [x for x, whole in wanted if whole and x not in self.bodies]
        joins = [x for x, whole in wanted if not whole]
        ids = self._encode(joins + bodies)
        joined, new = dict(zip(joins, ids, strict=False)), dict(zip(bodies, ids[len(joins) :], strict=True))
        for x, whole in wanted:
            if whole and x not in new:
                self.bodies.move_to_end(x)
                self.reused_chars += len(x)
        self.encoded_chars += sum(map(len, bodies)) + sum(map(len, joins))
        self.bodies |= new
        out = [np.frombuffer(b"".join([self.bodies[x] if whole else joined[x] for x, whole in parts]), self.kind) for parts in texts]
        while len(self.bodies) > self.most:
            self.bodies.popitem(last=False)
        return out

    def encode_column(self, column: pa.Array) -> list[np.ndarray]:
        data, offsets = textscan.spans(column)
        out = []
        for i, j in textscan.slices(offsets, SLICE_BYTES):
            base = int(offsets[i])
            raw = data[base : int(offsets[j])].tobytes()
            o = (offsets[i : j + 1] - base).tolist()
            out += self.encode([raw[a:b] for a, b in zip(o[:-1], o[1:], strict=True)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """As the tokenizer's decode(ids, skip_special_tokens=False)."""
        if self.bytes is None:
            return self.tok.decode(ids.tolist(), skip_special_tokens=False)
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode(errors="replace")

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids joined by commas."""
        return hashlib.sha256(b",".join(map(self.decimal.__getitem__, ids.tolist()))).hexdigest()


def _byte_table(tok) -> list[bytes] | None:
    """The bytes of every id, if the tokenizer's decoder is the byte-level one, which only joins them."""
    spec = json.loads(tok.to_str())
    if (spec.get("decoder") or {}).get("type") != "ByteLevel":
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    return [added[i] if i in added else bytes(letters[c] for c in tok.id_to_token(i)) for i in range(tok.get_vocab_size())]


def _rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _parts_of(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def encoded(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunks: int = CHUNKS, bits: int = CUT_BITS) -> DataFrame:
    """doc_id and the token ids of each text, by chunk reuse within each worker. Needs no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reuse(tokenizer_path, chunks, bits)
        for part in _parts_of(batches):
            ids = own.encode_column(part.column(1))
            offsets = np.cumsum([0, *map(len, ids)])
            yield pa.RecordBatch.from_arrays([part.column(0), textscan.list_column(np.concatenate([*ids, np.zeros(0, own.kind)]).astype(np.int32), offsets, pa.int32())], names=["doc_id", "ids"])

    return _rows(documents, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(encodings: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the text that the ids stand for, special tokens included. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reuse(tokenizer_path, CHUNKS, CUT_BITS)
        for part in _parts_of(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.decode(np.array(x or [], np.int64)) for x in part.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encodings.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunks: int = CHUNKS, bits: int = CUT_BITS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text: encoded, decoded and digested in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reuse(tokenizer_path, chunks, bits)
        for part in _parts_of(batches):
            ids = own.encode_column(part.column(1))
            texts = [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([own.digest(x) for x in ids]), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(documents, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
