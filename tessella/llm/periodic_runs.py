"""Periodic run detection (operator 11) by Karp-Miller-Rosenberg naming.

A run is a stretch of words with smallest period q, at least ``least_length``
words and ``least_exponent`` periods long, that no neighbouring word extends
keeping that period.

* Naming: level 0 names words, level k + 1 names pairs of names of level k, so
  a name stands for ``2**k`` words exactly. A block that occurs once in its
  document gets a name of its own and takes no part in higher levels; naming
  ends when no block repeats. Names are ranks of sorted pairs, so nothing is
  hashed and no suffixes are sorted.
* Grid: a run of period q holds a stretch of ``(least_exponent - 1) * q``
  places i with equal words at i and i + q, hence a multiple of that number.
  Those grid points with equal names are extended both ways by descending name
  levels (longest common extensions), all of a chunk at once.
* A stretch found with several periods keeps the smallest: by the theorem of
  Fine and Wilf the others are its multiples.

A document is judged where it is read, so nothing is shuffled. Documents of a
chunk are named side by side, by (document, word). A chunk of n words takes
n log n time and 4 bytes a word for each level on which blocks repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import _text
from tessella.llm._cluster import bound_batches

#: Grid points that are compared at a time.
GRID_POINTS = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span of bytes, equal for equal bytes."""
    mask = np.zeros(len(data) + 1, np.int8)
    mask[starts] += 1
    mask[ends] -= 1
    packed = data[np.cumsum(mask[:-1], dtype=np.int8).astype(bool)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _named(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Names of the blocks at ``at`` by their keys, for all ``n`` places; a block that occurs once is negative, and no other's name."""
    names = -np.arange(1, n + 2, dtype=np.int64)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    names[at[again]] = inverse[again]
    return names.astype(np.int32) if n < 1 << 31 else names, len(counts)


def name_levels(words: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Level k: a name of the ``2**k`` words from each place on (and one place more); none repeats on the level after the last."""
    n = len(words)
    top = int(words.max()) + 1 if n else 1
    names, kinds = _named(rows * top + words, np.arange(n), n)
    levels = []
    while (names >= 0).any():
        levels.append(names)
        width = 1 << (len(levels) - 1)
        at = np.flatnonzero(names[: max(0, n - width)] >= 0)
        at = at[(names[at + width] >= 0) & (rows[at] == rows[at + width])]
        names, kinds = _named(names[at].astype(np.int64) * kinds + names[at + width], at, n)
    return levels


def extend(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from ``i`` and ``j`` (i < j) on, or before them."""
    have = np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        at = i - have - (1 << k) if back else i + have
        low = np.maximum(at, 0)
        equal = (at >= 0) & (levels[k][low] == levels[k][np.minimum(low + (j - i), len(levels[k]) - 1)])
        have += equal.astype(np.int64) << k
    return have


def _grid(sizes: np.ndarray, firsts: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``i, q`` of all grid points of documents of ``sizes`` words that begin at ``firsts``."""
    most = sizes // exponent
    doc = np.repeat(np.arange(len(sizes)), most)
    q = np.arange(1, len(doc) + 1) - np.repeat(np.cumsum(most) - most, most)
    step = (exponent - 1) * q
    points = -((q - sizes[doc]) // step)
    ends = np.cumsum(points)
    lo = 0
    while lo < len(q):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + GRID_POINTS, side="right")))
        own = points[lo:hi]
        pick = np.repeat(np.arange(lo, hi), own)
        nth = np.arange(len(pick)) - np.repeat(np.cumsum(own) - own, own)
        yield firsts[doc[pick]] + nth * step[pick], q[pick]
        lo = hi


def find_runs(words: np.ndarray, splits: np.ndarray, least_length: int, least_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs of all rows of numbered words, by start, then period."""
    levels = name_levels(words, _text.rows_of(splits))
    none = np.zeros(0, np.int64)
    if not levels:
        return none, none, none
    found = [(none, none, none)]
    for i, q in _grid(np.diff(splits), splits[:-1], least_exponent):
        equal = levels[0][i] == levels[0][i + q]
        i, q = i[equal], q[equal]
        after, before = extend(levels, i, i + q, False), extend(levels, i, i + q, True)
        fits = after + before + q >= np.maximum(least_length, least_exponent * q)
        found.append(((i - before)[fits], (i + q + after)[fits], q[fits]))
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def joined_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, splits: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Texts of the kept words of each row, joined by one space."""
    mask = np.zeros(len(data) + 1, np.int8)
    mask[starts[keep]] += 1
    mask[ends[keep]] -= 1
    stay = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
    kept = np.flatnonzero(keep)
    row = _text.rows_of(splits)[kept]
    gaps = ends[kept[:-1][row[:-1] == row[1:]]]
    data = data.copy()
    data[gaps] = 0x20
    stay[gaps] = True
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(stay, out=total[1:])
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(total[offsets]), pa.py_buffer(data[stay])]).cast(pa.string())


def periodic_runs(docs: DataFrame, text: str = "text", least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """``row, text, n_words, runs`` for each row of ``docs``.

    ``row`` is a struct of the input's other columns, so no name can clash.
    ``runs``: all runs by start, then period; starts are word numbers from 0.
    ``text``: the words but those that a run contains after its first period,
    joined by one space. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and
    empty texts have no word, no run and an empty text. Rows are judged one by
    one, so repeated rows get equal results and ids may be null or repeat; an
    empty table gives no rows. Whole texts are searched, however long.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    bound_batches(docs.sparkSession)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")
    data = docs.select(rest, F.col(f"`{text}`").cast("string").alias("text"))
    out = T.StructType([data.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(RUNS))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _text.chunks(batch.column(1)):
                starts, ends, splits = _text.word_spans(data, offsets)
                start, end, period = find_runs(word_ids(data, starts, ends), splits, least_length, least_exponent)
                gone = np.zeros(len(starts) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, end, -1)
                texts = joined_words(data, offsets, starts, ends, splits, np.cumsum(gone[:-1]) == 0)
                bounds = np.searchsorted(start, splits)
                own = splits[np.searchsorted(splits, start, side="right") - 1]
                fields = pa.StructArray.from_arrays([pa.array(start - own), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), fields)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), texts, pa.array(np.diff(splits)), runs], out.names)

    return data.mapInArrow(search, out)
