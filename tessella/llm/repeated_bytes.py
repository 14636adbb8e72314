"""Removal of byte strings that repeat anywhere (operator 13), by run-length indexes.

Every byte goes that is covered by a string of ``window`` bytes which also starts
at another place, in the same or another row; strings are judged on the input.

* Meeting: each window belongs to the gram of ``GRAM`` bytes in it whose hash is
  least (the leftmost, if several are), its anchor. Equal windows have equal
  anchors at equal distances. The windows of one anchor follow each other, so
  they are a segment of fewer than ``2 * window`` bytes, and only segments under
  the same hash can hold equal windows. Hashes that occur once in the corpus
  end here; no text is moved for them.
* Equal segments need no search: all their windows repeat. Only where one hash
  has different segments are their bytes brought together, each once.
* Index: a task takes groups of segments in order of their hash and builds, for
  a megabyte at a time, the Burrows-Wheeler transform by prefix doubling and
  keeps it by runs with the text positions of each run's first and last row.
* Matching statistics: how far the string at a position also occurs elsewhere
  is one less than at the position before, unless its row begins (or, for the
  next row, ends) a run. So they follow in text order from the samples, where
  they are compared with the text. In repetitive text there are few runs.
* A group of more than ``MOST_SEGMENTS`` segments (the edge of a passage that
  very many documents hold) isn't indexed in one task but split: its windows by
  their distance to the anchor, under the bytes that all of a distance share.
  Inside the passage the parts are equal, outside they are alone, and only those
  over its edge are split again, so few parts are made of each segment.

Rows with equal texts form a class, which is read once; all their bytes repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import _sketch, _text
from tessella.llm._cluster import bound_batches, cut, release, remove
from tessella.llm.substring_dedup import _filter_of, _seq64, _slide

#: Bytes of the grams that anchor windows.
GRAM = 32
#: Segments that one index may hold of one anchor.
MOST_SEGMENTS = 512
#: Bytes that are indexed at a time.
INDEX_BYTES = 1 << 20
#: Long texts are read in pieces of so many bytes, which overlap by a window; places of a piece fit in ``_PLACE_BITS`` bits.
PIECE_BYTES = 1 << 20
_PLACE_BITS = 24
#: No byte of UTF-8: ends a segment in an indexed text.
END = 0xFF


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of segments of UTF-8, with the text positions of each run's first and last row.

    Each segment is followed by an end that is greater than all bytes and
    smaller than the ends after it. ``chars``, ``lengths``: the runs; an end is a
    run of its own. ``first``, ``last``: the sampled positions.
    """

    def __init__(self, segments: list[bytes]):
        self.offsets = np.zeros(len(segments) + 1, np.int64)
        np.cumsum([len(s) + 1 for s in segments], out=self.offsets[1:])
        self.text = np.frombuffer(b"".join(s + bytes([END]) for s in segments), np.uint8)
        self.left = np.repeat(self.offsets[1:] - 1, np.diff(self.offsets)) - np.arange(len(self.text))
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)])
        self.words = np.zeros(len(self.text), np.uint64)
        for k in range(8):
            self.words = (self.words << np.uint64(8)) | padded[k : len(self.text) + k]
        rows = self._sorted()
        before = self.text[rows - 1]
        starts = np.ones(len(rows), bool)
        starts[1:] = (before[1:] != before[:-1]) | (before[1:] == END)
        at = np.flatnonzero(starts)
        self.chars, self.lengths = before[at], np.diff(np.append(at, len(rows)))
        self.first, self.last = rows[at], rows[np.append(at, len(rows))[1:] - 1] if len(at) else rows

    def _sorted(self) -> np.ndarray:
        """All positions by their suffixes; prefix doubling from eight bytes, on positions that are still tied."""
        n = len(self.text)
        bits = 8 * np.maximum(7 - self.left, 0)  # what lies behind the end doesn't count
        keys = (self.words >> bits.astype(np.uint64)) << bits.astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = (keys[order[1:]] != keys[order[:-1]]) | (self.left[order[1:]] < 8)
        slots = np.arange(n)
        group = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank = np.empty(n, np.int64)
        rank[order] = group
        depth = 8
        while True:
            alone = fresh.copy()
            alone[:-1] &= fresh[1:]
            tied = np.flatnonzero(~alone)
            slots, own = slots[tied], order[slots[tied]]
            if not len(own):
                return order
            key = rank[own] * (n + 1) + rank[own + depth]
            by = np.argsort(key, kind="stable")
            own, key = own[by], key[by]
            order[slots] = own
            fresh = np.ones(len(own), bool)
            fresh[1:] = key[1:] != key[:-1]
            rank[own] = np.maximum.accumulate(np.where(fresh, slots, 0))
            depth *= 2

    def _common(self, i: np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
        """How many bytes agree from ``i`` and ``j`` on; where that is under ``least``, something under it."""
        have, most = np.zeros(len(i), np.int64), np.minimum(self.left[i], self.left[j])
        live = np.flatnonzero(most >= least)
        while len(live):
            on = live[have[live] + 8 <= most[live]]
            live = on[self.words[i[on] + have[on]] == self.words[j[on] + have[on]]]
            have[live] += 8
        near = np.flatnonzero((have + 8 > least) & (most >= least))
        for _ in range(7):
            near = near[have[near] < most[near]]
            near = near[self.text[i[near] + have[near]] == self.text[j[near] + have[near]]]
            have[near] += 1
        return have

    def matching_statistics(self, least: int) -> np.ndarray:
        """For each position, how many bytes from it on also start at another position, where that is ``least`` or more; else something less."""
        n = len(self.text)
        if not n:
            return np.zeros(0, np.int64)
        common = np.append(self._common(self.last[:-1], self.first[1:], least), 0)
        place, best = np.arange(n), np.zeros(n, np.int64)
        for samples, values in ((self.first, np.append(common[-1:], common[:-1])), (self.last, common)):
            at = np.full(n, -1, np.int64)
            at[samples] = values + samples
            known = np.maximum.accumulate(np.where(at >= 0, place, 0))
            best = np.maximum(best, at[known] - place)
        return best


def _each(column: pa.Array, window: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Row, class and bytes of texts that hold a window."""
    for first, end, data, offsets in _text.chunks(column):
        for r in range(end - first):
            own = data[offsets[r] : offsets[r + 1]]
            if len(own) >= window:
                yield first + r, hashlib.blake2b(own, digest_size=16).digest(), own


def anchored(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``anchors, starts``: the hashes of a text's anchors, and where the first window of each starts; a window at most starts before the next one's."""
    anchors, starts = [], []
    for base in range(0, max(1, len(data) - window + 1), PIECE_BYTES):
        piece = data[base : base + PIECE_BYTES + window - 1]
        at = np.arange(len(piece) - GRAM + 1)
        grams = _text.hash_spans(piece, at, at + GRAM, fold=False)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        owner = (_slide((grams & ~low) | at.astype(np.uint64), window - GRAM + 1, np.minimum) & low).astype(np.int64)
        change = np.flatnonzero(np.diff(owner, prepend=-1))
        anchors.append(_text.signed(grams[owner[change]]))
        starts.append((base + change).astype(np.int32))
    return np.concatenate(anchors), np.concatenate(starts)


def _prints(texts: DataFrame, window: int) -> DataFrame:
    """``seq, n, anchors, starts`` of each row with a window; the arrays once a class and task."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            seqs, sizes, anchors, starts = [], [], [], []
            for _, seq, data in _each(batch.column(0), window):
                own = (None, None) if seq in seen else anchored(data, window)
                seen.add(seq)
                seqs.append(seq)
                sizes.append(len(data))
                anchors.append(own[0])
                starts.append(own[1])
            if seqs:
                fresh = pa.array([a is not None for a in anchors])
                none = np.zeros(0, np.int64)
                lists = [pa.compute.if_else(fresh, _text.list_array([none if p is None else p for p in part], kind), None) for part, kind in ((anchors, pa.int64()), (starts, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.binary()), pa.array(sizes, pa.int64()), *lists], ["seq", "n", "anchors", "starts"])

    return texts.mapInArrow(one, "seq binary, n bigint, anchors array<bigint>, starts array<int>")


def _texts_of(texts: DataFrame, seqs: DataFrame, window: int) -> DataFrame:
    """``seq, text`` of rows whose class may be in ``seqs``, a class once a task."""
    wanted = _filter_of(seqs)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows, names = [], []
            for r, seq, _ in _each(batch.column(0), window):
                if seq not in seen and _sketch.may_hold(wanted.value, _seq64([seq]))[0]:
                    seen.add(seq)
                    rows.append(r)
                    names.append(seq)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), batch.column(0).take(pa.array(rows))], ["seq", "text"])

    return texts.mapInArrow(one, "seq binary, text string")


def _segments(joined: DataFrame, window: int) -> DataFrame:
    """``seq, start, h, d1, d2, size, segment`` for each row of ``joined(seq, text, found)``; the bytes once a task."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = batch.column(2)
            for r in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[r].as_buffer(), np.uint8)
                own = found[r].values
                h, lo, hi = (own.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                d1, d2 = (_text.signed(_text.hash_spans(data, lo, hi + window, fold=False, seed=s)) for s in (3, 4))
                if len(seen) > 1_000_000:
                    seen.clear()
                segments = []
                for k, d in enumerate(d1.tolist()):
                    segments.append(None if d in seen else data[lo[k] : hi[k] + window].tobytes())
                    seen.add(d)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[r].as_py()] * len(h), pa.binary()), pa.array(lo.astype(np.int32)), pa.array(h), pa.array(d1), pa.array(d2), pa.array((hi - lo + 1).astype(np.int32)), pa.array(segments, pa.binary())], ["seq", "start", "h", "d1", "d2", "size", "segment"])

    return joined.mapInArrow(one, "seq binary, start int, h bigint, d1 bigint, d2 bigint, size int, segment binary")


_SPANS = "array<struct<lo: int, hi: int>>"


def _spans(starts: np.ndarray) -> list[dict]:
    """Stretches ``[lo, hi)`` of sorted numbers."""
    edge = np.flatnonzero(np.diff(starts) > 1)
    return [{"lo": int(a), "hi": int(b) + 1} for a, b in zip(starts[np.append(0, edge + 1)], starts[np.append(edge, len(starts) - 1)], strict=True)] if len(starts) else []


def _indexed(groups: DataFrame, window: int) -> DataFrame:
    """``d1, d2, spans``: where windows of a segment start that another of its group holds; ``groups(g, d1, d2, size, segment)``, small ones."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        index = RunLengthIndex([r[4] for r in rows])
        again = index.matching_statistics(window) >= window
        spans = [_spans(np.flatnonzero(again[o : o + r[3]])) for r, o in zip(rows, index.offsets[:-1], strict=True)]
        kept = [k for k, s in enumerate(spans) if s]
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([rows[k][1] for k in kept], pa.int64()), pa.array([rows[k][2] for k in kept], pa.int64()), pa.array([spans[k] for k in kept], kind)], ["d1", "d2", "spans"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if held > INDEX_BYTES and row[0] != rows[-1][0]:
                    yield search(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield search(rows)

    return groups.repartition("g").sortWithinPartitions("g").mapInArrow(one, f"d1 bigint, d2 bigint, spans {_SPANS}")


def anchor_of(segment: np.ndarray, window: int) -> int:
    """Where the anchor of a segment begins: its first window's least gram, the leftmost."""
    at = np.arange(window - GRAM + 1)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    return int(np.argmin(_text.hash_spans(segment[:window], at, at + GRAM, fold=False) & ~low))


def cells(at: int, size: int, width: int, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """``cell, first, n, core, end``: the windows of a segment by how far they begin before its anchor at ``at``, in steps of ``width``.

    ``core, end``: the bytes that all windows of the cell hold, in any segment,
    at the same distances from the anchor.
    """
    for cell in range((at - size + 1) // width, at // width + 1):
        first, end = max(0, at - (cell + 1) * width + 1), min(size, at - cell * width + 1)
        if first < end:
            yield cell, first, end - first, at - cell * width, at + window - min((cell + 1) * width - 1, window - GRAM)


def _split(groups: DataFrame, window: int, width: int) -> DataFrame:
    """``o1, o2, lo, g, d1, d2, size, at, segment``: each segment of large groups in cells, under the hash of their core.

    Segments that share a window share the core of its cell, so they meet again;
    others part. ``o1, o2`` is the segment, ``lo`` its first window in the cell.
    """

    def digests(data: bytes) -> tuple[int, int]:
        return tuple(np.frombuffer(hashlib.blake2b(data, digest_size=16).digest(), np.int64).tolist())

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d1, d2, size, at, segment in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                at = anchor_of(np.frombuffer(segment, np.uint8), window) if at is None else at
                for cell, lo, n, core, end in cells(at, size, width, window):
                    part = segment[lo : lo + n + window - 1]
                    own = segment[core:end]
                    rows.append((d1, d2, lo, digests(own + cell.to_bytes(2, "little", signed=True))[0], *digests(part), n, at - lo, part))
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["o1", "o2", "lo", "g", "d1", "d2", "size", "at", "segment"])

    return groups.select("d1", "d2", "size", "at", "segment").mapInArrow(one, "o1 bigint, o2 bigint, lo int, g bigint, d1 bigint, d2 bigint, size int, at int, segment binary")


def shared_windows(kinds: DataFrame, window: int, most_segments: int, width: int) -> DataFrame:
    """``d1, d2, spans``: where windows of a segment start that another of its group ``g`` holds; ``kinds(g, d1, d2, size, at, segment)``, all different.

    Groups of up to ``most_segments`` are indexed. Larger ones are split into
    cells of ``width``; cells that are equal in several segments repeat as a
    whole, those that are alone end, and what is left is resolved in the same way
    with half the width. A cell of width 1 is one window, so that ends.
    """
    mixed = kinds.groupBy("g").agg(F.count("*").alias("m")).where("m > 1")
    met = cut(kinds.join(mixed, "g"), "bytes-met")
    found = cut(_indexed(met.where(F.col("m") <= most_segments).select("g", "d1", "d2", "size", "segment"), window), "bytes-indexed")
    large = met.where(F.col("m") > most_segments)
    if width == 0 or large.isEmpty():
        remove(met)
        return found
    rows = cut(_split(large, window, width), "bytes-cells")
    remove(met)
    inner = cut(rows.groupBy("g", "d1", "d2").agg(F.first("size").alias("size"), F.first("at").alias("at"), F.first("segment").alias("segment"), F.count("*").alias("n")), "bytes-kinds")
    shared = shared_windows(inner.drop("n"), window, most_segments, width // 2)
    marks = cut(inner.select("d1", "d2", "n").join(shared, ["d1", "d2"], "left").where("n > 1 or spans is not null").select("d1", "d2", F.when(F.col("n") == 1, F.col("spans")).alias("spans")).dropDuplicates(["d1", "d2"]), "bytes-marks")
    moved = F.expr("if(spans is null, array(struct(lo as lo, lo + size as hi)), transform(spans, s -> struct(s.lo + lo as lo, s.hi + lo as hi)))")
    own = rows.drop("segment").join(marks, ["d1", "d2"]).select(F.col("o1").alias("d1"), F.col("o2").alias("d2"), moved.alias("spans"))
    out = cut(found.unionByName(own.groupBy("d1", "d2").agg(F.flatten(F.collect_list("spans")).alias("spans"))), "bytes-shared")
    remove(found, rows, inner, shared, marks)
    return out


def repeated_windows(texts: DataFrame, window: int, most_segments: int) -> DataFrame:
    """``seq, whole, spans`` of the classes with a repeated window: all bytes go, or those of windows that start in ``spans``."""
    spark = texts.sparkSession
    classes = cut(_prints(texts, window).groupBy("seq").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("anchors", ignorenulls=True).alias("anchors"), F.first("starts", ignorenulls=True).alias("starts")), "bytes-classes")
    repeated = cut(classes.select(F.explode("anchors").alias("h")).groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "bytes-repeated")
    last = F.expr("transform(starts, (s, i) -> if(i + 1 < size(starts), starts[i + 1], int(n) - {0} + 1) - 1)".format(window))
    posted = classes.select("seq", F.explode(F.arrays_zip("anchors", "starts", last.alias("lasts"))).alias("x")).select("seq", F.col("x.anchors").alias("h"), F.col("x.starts").alias("lo"), F.col("x.lasts").alias("hi"))
    wanted = cut(posted.join(repeated, "h").groupBy("seq").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("found")), "bytes-wanted")
    remove(repeated)
    release(spark)
    joined = wanted.join(_texts_of(texts, wanted.select("seq"), window), "seq").dropDuplicates(["seq"]).select("seq", "text", "found")
    places = cut(_segments(joined, window), "bytes-segments")
    remove(wanted)
    release(spark)
    kinds = cut(places.groupBy("h", "d1", "d2").agg(F.count("*").alias("n")), "bytes-kinds")
    mixed = cut(kinds.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "bytes-mixed")
    met = places.where("segment is not null").select("h", "d1", "d2", "size", "segment").join(mixed, "h").groupBy("h", "d1", "d2").agg(F.first("size").alias("size"), F.first("segment").alias("segment"))
    met = cut(met.select(F.col("h").alias("g"), "d1", "d2", "size", F.lit(None).cast("int").alias("at"), "segment"), "bytes-segments")
    shared = shared_windows(met, window, most_segments, 1 << ((window - GRAM).bit_length() - 1))
    remove(mixed, met)
    known = kinds.join(shared, ["d1", "d2"], "left").where("n > 1 or spans is not null").select("d1", "d2", F.when(F.col("n") == 1, F.col("spans")).alias("spans"))
    known = cut(known, "bytes-known")
    remove(kinds, shared)
    own = F.expr("if(spans is null, array(struct(start as lo, start + size as hi)), transform(spans, s -> struct(s.lo + start as lo, s.hi + start as hi)))")
    spans = places.select("seq", "start", "size", "d1", "d2").join(known, ["d1", "d2"]).select("seq", own.alias("spans"))
    spans = spans.groupBy("seq").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    results = cut(classes.select("seq", (F.col("copies") > 1).alias("whole")).join(spans, "seq", "left").where("whole or spans is not null"), "bytes-results")
    remove(classes, places, known)
    release(spark)
    return results


def keep_bytes(data: np.ndarray, spans: list[dict] | None, whole: bool, window: int) -> tuple[bytes, int, int]:
    """``kept, n_removed, n_spans`` after the bytes under windows that start in ``spans`` have gone."""
    if whole:
        return b"", len(data), 1
    if not spans:
        return data.tobytes(), 0, 0
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, [s["lo"] for s in spans], 1)
    np.add.at(edge, [s["hi"] + window - 1 for s in spans], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return data[~gone].tobytes(), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])


def repeated_bytes(docs: DataFrame, text: str = "text", window: int = 200, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """``row, kept, n_bytes, n_removed, n_spans`` for each row of ``docs``.

    ``row`` is a struct of the input's other columns, so no name can clash.
    ``kept`` are the text's UTF-8 bytes but those that a repeated window covers,
    as binary, since a window may begin within a character; ``n_spans`` counts the
    maximal stretches that went. Nulls and empty texts have no byte, texts
    shorter than a window stay whole. Rows count one by one, whatever their ids:
    repeated rows of a window's length and more are each other's copies and go,
    all of them. An empty table gives no rows. ``window`` must be ``2 * GRAM`` at
    least.
    """
    if window < 2 * GRAM:
        raise ValueError(f"windows have {2 * GRAM} bytes at least")
    spark = docs.sparkSession
    bound_batches(spark)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")
    data = docs.select(rest, F.col(f"`{text}`").cast("string").alias("text"))
    results = repeated_windows(data.where("text is not null").select("text"), window, most_segments)
    wanted = _filter_of(results.select("seq"))
    numbers = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    out = T.StructType([data.schema["row"], T.StructField("kept", T.BinaryType()), *numbers])
    between = T.StructType([data.schema["row"], data.schema["text"], T.StructField("seq", T.BinaryType())])

    def parted(column: pa.Array) -> tuple[list[int], list[bytes]]:
        rows = [(r, seq) for r, seq, _ in _each(column, window) if _sketch.may_hold(wanted.value, _seq64([seq]))[0]]
        return [r for r, _ in rows], [s for _, s in rows]

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that surely lose nothing."""
        for batch in batches:
            rows = np.setdiff1d(np.arange(batch.num_rows), parted(batch.column(1))[0])
            if len(rows):
                own = batch.take(pa.array(rows))
                texts = own.column(1).fill_null("").cast(pa.binary())
                none = pa.array(np.zeros(len(rows), np.int64))
                yield pa.RecordBatch.from_arrays([own.column(0), texts, pa.compute.binary_length(texts).cast(pa.int64()), none, none], out.names)

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seqs = parted(batch.column(1))
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(seqs, pa.binary())], between.names)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, new = [], []
            for text, whole, spans in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = np.frombuffer(text.as_buffer(), np.uint8)
                sizes.append(len(own))
                new.append(keep_bytes(own, spans.as_py(), bool(whole), window))
            if new:
                kept, gone, parts = zip(*new, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, parts))], out.names)

    met = data.where("text is not null").mapInArrow(doubtful, between).join(results, "seq", "left").select("row", "text", "whole", "spans")
    return data.mapInArrow(clear, out).unionByName(met.mapInArrow(rewrite, out))
