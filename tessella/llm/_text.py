"""Vectorised words and n-grams over Arrow text columns.

Words are ``[^\\x20\\x09-\\x0D]+`` and lower-casing touches A-Z only, so both
work on UTF-8 bytes. All rows of a chunk are hashed at once from the column's
byte buffer: a word's hash is a polynomial over random 64-bit byte codes, taken
as a difference of prefix sums modulo 2**64 and mixed. No Python object is
made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 18

_MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: What a worker keeps between tasks for one operator; it gives that up when it does other work.
KEPT: dict = {}

_BASE = 0x9E3779B97F4A7C15
_GRAM = 0xD1B54A32D192ED03
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


class _Ladder:
    """Powers of an odd number and of its inverse, made longer when needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


_BYTES, _WORDS = _Ladder(_BASE), _Ladder(0xC2B2AE3D27D4EB4F)
_CODES: dict[tuple[int, bool], np.ndarray] = {}


def _codes(seed: int, fold: bool) -> np.ndarray:
    if (seed, fold) not in _CODES:
        table = np.random.Generator(np.random.PCG64(20240 + seed)).integers(0, 1 << 64, 256, np.uint64)
        if fold:
            table[65:91] = table[97:123]
        _CODES[seed, fold] = table
    return _CODES[seed, fold]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of pieces of about ``limit`` bytes; a row is never split."""
    KEPT.clear()
    data, offsets = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    trim()


def trim() -> None:
    """Give memory that this worker no longer uses back to the machine; workers that wait keep little."""
    pa.default_memory_pool().release_unused()
    if _MALLOC_TRIM is not None:
        _MALLOC_TRIM(0)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and per row the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; ``fold``: A-Z counts as a-z."""
    up, down = _BYTES.reach(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_codes(seed, fold)[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def hash_words(data: np.ndarray, offsets: np.ndarray, fold: bool, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the row splits."""
    starts, ends, splits = word_spans(data, offsets)
    return hash_spans(data, starts, ends, fold, seed), splits


def grams(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` words, also those that cross rows (see ``inside``)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.reach(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    k = len(words) - n + 1
    return mix((total[n:] - total[:k]) * down[:k] + np.uint64(_GRAM * (2 * n + 1 + 1000 * seed) % (1 << 64)))


def rows_of(splits: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(splits) - 1), np.diff(splits))


def inside(splits: np.ndarray, n: int) -> np.ndarray:
    """Which runs of ``n`` words lie in one row."""
    row = rows_of(splits)
    return row[: max(0, len(row) - n + 1)] == row[n - 1 :] if len(row) >= n else np.zeros(0, bool)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column, a row for each part."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
