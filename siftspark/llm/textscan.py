"""Vectorised word scanning of Arrow string columns.

All functions work on the UTF-8 bytes of a batch and are exact for any text: word
separators are ASCII, so no multi-byte character is ever split. Work goes in slices of a
bounded number of bytes (one document at least), so memory does not follow the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE_2 = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def _flags(separators: str) -> np.ndarray:
    """256 flags: the byte is part of a word."""
    flags = np.ones(256, bool)
    flags[[ord(c) for c in separators]] = False
    return flags


#: Words are runs of anything but space and \x09-\x0D.
SPACED = _flags(" \t\n\x0b\x0c\r")
#: Words are runs of ASCII letters, digits and non-ASCII characters.
ALNUM = _flags("".join(chr(c) for c in range(128) if not chr(c).isalnum()))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        inverse = pow(int(base), -1, 1 << 64)
        self.base, self.inverse = base, np.uint64(inverse)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_STEP)


@dataclass
class Words:
    """The words of some consecutive documents. offsets[i]:offsets[i+1] are those of document i."""

    data: np.ndarray  # bytes, lower-cased if asked for
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray

    def text(self, i: int, j: int) -> bytes:
        """The words i to j, each followed by a space but the last."""
        d = self.data
        return b" ".join(d[a:b].tobytes() for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True))


#: Stores that a worker keeps for later tasks of the same operator.
kept: list[dict] = []


def forget() -> None:
    """Empties the stores of other operators: a worker holds those of one at a time."""
    if any(kept):
        for store in kept:
            store.clear()
        release()


def release() -> None:
    """Gives memory that is free but kept back to the system; workers live for many tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), o


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def scan(column: pa.Array, is_word: np.ndarray, lower: bool, second: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, Words) of each slice of a string column."""
    forget()
    data, offsets = spans(column)
    for i, j in slices(offsets):
        o = offsets[i : j + 1] - offsets[i]
        yield i, j, words(data[offsets[i] : offsets[j]], o, is_word, lower, second)
    release()


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool, second: bool = False) -> Words:
    """second: hashes of the second family, for a key of 128 bits."""
    if lower:
        data = _LOWER[data]
    start, end = word_spans(data, offsets, is_word)
    return Words(data, start, end, np.searchsorted(start, offsets), hashes(data, start, end, second))


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start and end; none reaches over a document's end."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a document that ends in a word directly before one that starts with a word
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))]) if len(cut) else cut
    if len(cut):
        cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
        if len(cut):
            start, end = np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))
    return start, end


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """Hashes of the spans of bytes."""
    up, down = _BYTE_POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_TABLE_2 if second else _TABLE)[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that lie in one document, and the words at which they start."""
    m = len(w.hash)
    if m < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _WORD_POWERS.upto(m + 1)
    total = np.zeros(m + 1, np.uint64)
    np.cumsum(w.hash * up[:m], out=total[1:])
    h = mix((total[n:] - total[:-n]) * down[: m - n + 1] + np.uint64(n))
    ok = np.ones(m - n + 1, bool)
    for o in w.offsets[1:-1].tolist():
        ok[max(0, o - n + 1) : o] = False
    at = np.flatnonzero(ok)
    return h[at], at


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated starts[i], starts[i] + 1, ... of counts[i] members each."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts, counts)


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
