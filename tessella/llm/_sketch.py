"""Arrays of a fixed size that are built over all rows: frequency sketches and Bloom filters.

Each task fills one array; pieces of it travel as binary rows and are merged in
two steps, first the arrays of many tasks side by side, then by piece number.
Both steps read a stream and hold one array at most, however many tasks there
are. The merged array (``SKETCH_SLOTS`` counters or ``BLOOM_BITS`` bits,
whatever the input) is read by the driver and broadcast. ``key_filter`` makes a
filter that grows with its keys up to a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of a frequency sketch (8 bytes each: 2 MB).
SKETCH_SLOTS = 1 << 18
#: Bits of a Bloom filter (2 MB). It only saves traffic: what passes it wrongly is dropped by the join after it.
BLOOM_BITS = 1 << 24
#: The table that ``gathered`` reads: the pieces of a task's array.
PIECE_SCHEMA = "task int, piece int, data binary"
_PIECES = 64


def pieces_of(array: np.ndarray) -> list[pa.Array]:
    """Columns of ``PIECE_SCHEMA`` for the parts of a task's array that aren't all zero."""
    full = [(k, p) for k, p in enumerate(np.split(array, _PIECES)) if p.any()]
    task = TaskContext.get().partitionId()
    return [pa.array([task] * len(full), pa.int32()), pa.array([k for k, _ in full], pa.int32()), pa.array([p.tobytes() for _, p in full], pa.binary())]


def gathered(pieces: DataFrame, size: int, dtype: str, how: str) -> np.ndarray:
    """The arrays behind ``pieces`` (``PIECE_SCHEMA``), added (``sum``) or united (``or``)."""
    step = size // _PIECES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column("piece").to_pylist(), batch.column("data"), strict=True):
                part = np.frombuffer(data.as_buffer(), dtype)
                if piece not in held:
                    held[piece] = part.copy()
                elif how == "or":
                    held[piece] |= part
                else:
                    held[piece] += part
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(held), pa.int32()), pa.array(list(held), pa.int32()), pa.array([p.tobytes() for p in held.values()], pa.binary())], ["task", "piece", "data"])

    some = pieces.repartition("task").mapInArrow(add, PIECE_SCHEMA)
    out = np.zeros(size, dtype)
    for row in some.repartition("piece").mapInArrow(add, PIECE_SCHEMA).collect():
        out[row["piece"] * step : (row["piece"] + 1) * step] = np.frombuffer(row["data"], dtype)
    return out


def merged(df: DataFrame, fill: Callable[[pa.RecordBatch, np.ndarray], None], size: int, dtype: str, how: str) -> np.ndarray:
    """``fill(batch, array)`` adds each batch to its task's array; the arrays are added (``sum``) or united (``or``)."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, some = np.zeros(size, dtype), False
        for batch in batches:
            if batch.num_rows:
                fill(batch, own)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays(pieces_of(own), ["task", "piece", "data"])

    return gathered(df.mapInArrow(one, PIECE_SCHEMA), size, dtype, how)


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bit numbers for each 64-bit key, which must be a hash already."""
    return (keys & np.uint64(BLOOM_BITS - 1)).astype(np.int64), ((keys >> np.uint64(40)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)


def _longs(column: pa.Array) -> np.ndarray:
    return column.drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def bloom(df: DataFrame, keys: Callable[[pa.Array], np.ndarray] = _longs) -> np.ndarray:
    """A Bloom filter of the first column of ``df``: 64-bit hashes as long, or what ``keys`` makes of the column.

    The hashes are made where the filter is filled: two Python steps in one task
    would take two workers, all of which stay and get later stages' work in turn.
    """

    def fill(batch: pa.RecordBatch, bits: np.ndarray) -> None:
        for p in _places(keys(batch.column(0))):
            np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))

    return merged(df, fill, BLOOM_BITS // 8, "uint8", "or")


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be in the filter."""
    a, b = _places(keys)
    return ((bits[a >> 3] >> (a & 7)) & (bits[b >> 3] >> (b & 7)) & 1).astype(bool)


#: Bits of a piece of a filter that grows, bits for each key, and pieces at most (64 MB).
_PIECE_BITS, _KEY_BITS, _MOST_PIECES = 1 << 16, 12, 1 << 13


def _spots(keys: np.ndarray, pieces: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The piece of each 64-bit hash, and its three bits there."""
    shift = np.uint64(64 - (pieces.bit_length() - 1))
    return (keys >> shift).astype(np.int64), [((keys >> np.uint64(16 * k)) & np.uint64(_PIECE_BITS - 1)).astype(np.int64) for k in range(3)]


def key_filter(keys: DataFrame, count: int) -> np.ndarray:
    """A filter of about ``count`` 64-bit hashes, the first column of ``keys``, as rows of bytes.

    Keys are shuffled to their piece and each piece is built once. Beyond the
    greatest size it lets more strangers pass; it never holds a key back.
    """
    pieces = 1 << min(_MOST_PIECES.bit_length() - 1, max(4, (count * _KEY_BITS // _PIECE_BITS).bit_length()))
    width = _PIECE_BITS // 8

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            piece, spots = _spots(own, pieces)
            for k in np.unique(piece).tolist():
                bits = held.setdefault(k, np.zeros(width, np.uint8))
                for spot in spots:
                    at = spot[piece == k]
                    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(held), pa.int32()), pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["task", "piece", "data"])

    own = keys.select(keys[keys.columns[0]].alias("k")).where("k is not null")
    dealt = own.withColumn("piece", F.shiftrightunsigned("k", 64 - (pieces.bit_length() - 1))).repartition("piece").select("k")
    out = np.zeros((pieces, width), np.uint8)
    for row in dealt.mapInArrow(build, PIECE_SCHEMA).collect():  # the greatest size at most
        out[row["piece"]] = np.frombuffer(row["data"], np.uint8)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes a filter of ``key_filter`` lets pass."""
    piece, spots = _spots(keys, len(bits))
    flat, base = bits.ravel(), piece * bits.shape[1]
    out = np.ones(len(keys), bool)
    for spot in spots:
        out &= ((flat[base + (spot >> 3)] >> (spot & 7)) & 1).astype(bool)
    return out
