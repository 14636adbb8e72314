"""Benchmark decontamination (operator 2).

Every document is read in windows as long as an item, at every word. A window
has a SimHash of ``BITS`` bits: bit by bit the majority over the hashes of its
word shingles, taken from running sums. Item fingerprints are indexed in
``BLOCKS`` blocks of bits: fingerprints within ``RADIUS`` of each other agree on
some block but for ``RADIUS // BLOCKS`` bits. Each block is halved again and
looked up by every value of a half that is close enough, so fingerprints within
the radius are all found, and fewer than one in a hundred strangers. Candidates
are verified by the exact similarity of weighted shingles: the sum of the smaller
weights over the sum of the greater, a weight being how often a shingle occurs.

* A window with no shingle of any item has similarity 0, so it gets no
  fingerprint; that loses nothing and saves nearly all of the work.
* The radius is for sets. Where a shingle repeats within a window or an item the
  angle says little about the similarity, so those are candidates of each other
  if they share a shingle, without a fingerprint.
* Items go to the tasks in shards of ``SHARD_WORDS`` words at most, one pass over
  the documents each, so memory is bounded for a benchmark of any size. A shingle
  that very many items share is a row for each length of item. Nothing of the
  documents is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import _text
from tessella.llm._cluster import bound_batches, cut

#: Bits of a fingerprint.
BITS = 256
#: Bits in which fingerprints may differ, as many as 8 blocks within 7 bits allow. At similarity 0.8 sets of equal size are
#: 27.3 degrees apart: 38.8 bits on average with a deviation of 5.7, so the radius is four deviations away.
RADIUS = 63
#: Blocks of the index. Strangers agree on a block of 32 bits but for 7 with a probability of 0.001.
BLOCKS = 8
#: Words of benchmark items that are broadcast together (under 200 MB with the index).
SHARD_WORDS = 2_000_000
#: Windows that are fingerprinted together.
WINDOWS = 4096


def balls(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits of which at most ``radius`` are set."""
    every = np.arange(1 << width, dtype=np.uint32)
    return every[np.bitwise_count(every) <= radius]


class HammingIndex:
    """Which of some fingerprints, rows of 64-bit words, are within ``radius`` bits of given ones: all, by blocks and halves of blocks."""

    def __init__(self, prints: np.ndarray, radius: int, blocks: int = BLOCKS):
        self.prints, self.radius, self.blocks = prints, radius, blocks
        self.width = 64 * prints.shape[1] // blocks // 2
        self.within = radius // blocks
        self.ball = balls(self.width, self.within // 2)
        self.tables = []
        for k, half in enumerate(self._halves(prints).T):
            order = np.argsort(half, kind="stable")
            self.tables.append((k, half[order], order))

    def _halves(self, prints: np.ndarray) -> np.ndarray:
        """Each fingerprint's halves of blocks, two after each other to a block."""
        return prints.view("<u2" if self.width == 16 else "u1").astype(np.uint32)

    def candidates(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of rows of ``wanted`` and of the index that agree on a block but for few bits."""
        asked, found = self._halves(wanted), []
        known = self._halves(self.prints)
        for k, keys, order in self.tables:
            near = asked[:, k][:, None] ^ self.ball[None] if len(self.ball) < len(keys) else None
            if near is None:  # so few that comparing each is less work than looking all values up
                row, at = np.nonzero(np.bitwise_count(asked[:, k][:, None] ^ keys[None]) <= self.within // 2)
            else:
                lo, hi = np.searchsorted(keys, near, side="left"), np.searchsorted(keys, near, side="right")
                row, value = np.nonzero(hi > lo)
                n = (hi - lo)[row, value]
                at = np.repeat(lo[row, value] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                row = np.repeat(row, n)
            at = order[at]
            block = slice(k // 2 * 2, k // 2 * 2 + 2)
            close = np.bitwise_count(asked[row, block] ^ known[at, block]).sum(axis=1) <= self.within
            found.append(row[close] * len(self.prints) + at[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))

    def near(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of ``wanted`` and of the index within the radius, in order."""
        row, at = self.candidates(wanted)
        close = np.bitwise_count(wanted[row] ^ self.prints[at]).sum(axis=1) <= self.radius
        return row[close], at[close]


def simhash(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprints of runs of hashed shingles, rows of 64-bit words, from running sums of their bits."""
    words = BITS // 64
    hashes = np.stack([_text.mix(shingles + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(1, words + 1)], axis=1)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(len(shingles), -1), axis=1, bitorder="little")
    total = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    most = 2 * (total[ends] - total[starts]) > (ends - starts)[:, None]
    return np.ascontiguousarray(np.packbits(most, axis=1, bitorder="little")).view("<u8")


def repeats(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a shingle occurs twice in runs of shingles; ``starts`` and ``ends`` ascend."""
    order = np.argsort(shingles, kind="stable")
    again = np.full(len(shingles) + 1, len(shingles) + 1)  # the next place of each shingle
    same = shingles[order[1:]] == shingles[order[:-1]]
    again[order[:-1][same]] = order[1:][same]
    first = np.minimum.accumulate(again[::-1])[::-1]  # the first place that repeats one at or after each
    return first[starts] < ends


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The sum of smaller weights over the sum of greater ones of two sequences of shingles."""
    keys, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(where[: len(a)], minlength=len(keys)), np.bincount(where[len(a) :], minlength=len(keys))
    return int(np.minimum(x, y).sum()) / int(np.maximum(x, y).sum())


class Items:
    """A shard of benchmark items: shingles, fingerprints by length, and an index of them."""

    def __init__(self, rows: list[tuple[int, str]], width: int, radius: int):
        self.width = width
        column = pa.array([text for _, text in rows], pa.string())
        self.ids: list[int] = []
        lengths: list[int] = []
        self.shingles: list[np.ndarray] = []
        for first, end, data, offsets in _text.chunks(column):
            words, splits = _text.hash_words(data, offsets, fold=True)
            for r in range(end - first):
                own = words[splits[r] : splits[r + 1]]
                if len(own):
                    self.ids.append(rows[first + r][0])
                    lengths.append(len(own))
                    self.shingles.append(_text.grams(own, min(width, len(own))))
        self.lengths = np.asarray(lengths, np.int64)
        flat = np.concatenate(self.shingles) if self.shingles else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.shingles])
        # the lengths of items that hold a shingle, however many items do
        order = np.lexsort((self.lengths[owner], flat))
        key, length = flat[order], self.lengths[owner][order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (length[1:] != length[:-1])
        self.held, self.held_lengths = key[new], length[new]
        self.keys = np.unique(self.held)
        self.short = sorted({min(width, n) for n in lengths})
        odd = np.asarray([len(np.unique(x)) < len(x) for x in self.shingles], bool)
        self.groups: dict[int, tuple[np.ndarray, HammingIndex, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]] = {}
        for n in sorted(set(lengths)):
            members = np.flatnonzero(self.lengths == n)
            plain = members[~odd[members]]
            runs = [self.shingles[k] for k in plain]
            ends = np.cumsum([len(x) for x in runs], dtype=np.int64)
            prints = simhash(np.concatenate(runs), ends - [len(x) for x in runs], ends) if runs else np.zeros((0, BITS // 64), np.uint64)
            every, of = np.concatenate([self.shingles[k] for k in members]), np.repeat(members, [len(self.shingles[k]) for k in members])
            order = np.argsort(every, kind="stable")
            every, of = every[order], of[order]
            strange = odd[of]  # items of this length in which a shingle repeats
            self.groups[n] = (plain, HammingIndex(prints, radius), (every, of), (every[strange], of[strange]))

    def matches(self, words: np.ndarray, hits: dict[int, np.ndarray], least: float) -> list[tuple[int, int, int, float]]:
        """``item, first word, words, similarity`` of the best window for each item that one reaches ``least`` for.

        ``hits``: by shingle width, places of shingles that some item has.
        """
        wanted: dict[int, list[np.ndarray]] = {}
        for size, places in hits.items():
            shingles = _text.grams(words, size)[places]
            lo, hi = np.searchsorted(self.held, shingles, side="left"), np.searchsorted(self.held, shingles, side="right")
            n = hi - lo
            length = self.held_lengths[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            place = np.repeat(places, n)
            for value in np.unique(length).tolist():
                if min(self.width, value) == size:
                    wanted.setdefault(value, []).append(place[length == value])
        best: dict[int, tuple[float, int, int]] = {}
        for length, places in wanted.items():
            size, span = min(self.width, length), min(length, len(words))
            shingles = _text.grams(words, size)
            place = np.unique(np.concatenate(places))
            lo, hi = np.maximum(0, place - (span - size)), np.minimum(place, len(words) - span)
            near = np.zeros(len(words) - span + 2, np.int32)
            np.add.at(near, lo, 1)
            np.add.at(near, hi + 1, -1)
            starts = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            n = span - size + 1
            edges = np.append(np.flatnonzero(np.diff(starts, prepend=-2) > 1), len(starts))
            for first, last in zip(edges[:-1], edges[1:], strict=True):  # windows next to each other
                for k in range(first, last, WINDOWS):
                    part = starts[k : min(last, k + WINDOWS)]
                    low = int(part[0])
                    for at, item in self._pairs(length, shingles[low : int(part[-1]) + n], part - low, n):
                        start = low + at
                        score = weighted_similarity(shingles[start : start + n], self.shingles[item])
                        if score >= least and (item not in best or (score, -start) > (best[item][0], -best[item][1])):
                            best[item] = (score, start, span)
        return [(self.ids[k], start, span, score) for k, (score, start, span) in sorted(best.items())]

    def _pairs(self, length: int, shingles: np.ndarray, starts: np.ndarray, n: int) -> list[tuple[int, int]]:
        """Windows of ``n`` shingles at ``starts`` and the items of a length that they are candidates for."""
        plain, index, every, strange = self.groups[length]
        twice = repeats(shingles, starts, starts + n)
        clear = np.flatnonzero(~twice)
        out: list[tuple[int, int]] = []
        if len(clear) and len(plain):
            row, at = index.near(simhash(shingles, starts[clear], starts[clear] + n))
            out += zip(starts[clear][row].tolist(), plain[at].tolist(), strict=True)
        # where a shingle repeats, in the window or in an item, all that share one are candidates
        for windows, (keys, of) in ((starts[twice], every), (starts[clear], strange)):
            if len(windows) and len(keys):
                at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
                held = np.concatenate([[0], np.cumsum(keys[at] == shingles)])
                for start in windows[held[windows + n] > held[windows]].tolist():
                    own = np.unique(shingles[start : start + n])
                    lo, hi = np.searchsorted(keys, own, side="left"), np.searchsorted(keys, own, side="right")
                    out += [(start, k) for k in sorted({int(k) for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True) for k in of[a:b]})]
        return out


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", width:
    int = 5, least: float = 0.8, radius: int = RADIUS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``row, <item_col>, start, n_words, similarity``: which document holds which item, and where best.

    ``row`` is a struct of the document's columns but its text, so no name can
    clash. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, shingles
    ``width`` of them; an item of fewer words is one shingle. ``start`` counts
    words; of equally similar windows the first is given. A document shorter
    than an item is one window.

    Null and empty texts and items hold nothing. Rows with null ids take part,
    repeated rows and items each give their rows. Whole texts are read. Without
    documents or items there are no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    clean = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    size = clean.agg(F.sum(F.size(F.split("text", "[\\x20\\x09-\\x0D]+"))).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // shard_words))
    data = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = clean.schema["item"].dataType.simpleString()
    schema = data.select("row", F.lit(None).cast(kind).alias(item_col), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("n_words"), F.lit(0.0).alias("similarity")).schema
    found = None
    for k in range(shards):
        rows = clean.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k).orderBy("item").collect()  # a shard's words
        shared = spark.sparkContext.broadcast(Items([(r["item"], r["text"]) for r in rows], width, radius))
        part = _scan(data, shared, least, schema)
        if shards > 1:  # one shard at a time, in the driver and in the tasks
            part = cut(part, "leaks", slim=True)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def _scan(data: DataFrame, shared: Broadcast, least: float, schema) -> DataFrame:
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            out: list[tuple] = []
            for first, _, data, offsets in _text.chunks(batch.column(1)):
                words, splits = _text.hash_words(data, offsets, fold=True)
                hits: dict[int, dict[int, np.ndarray]] = {}
                for size in items.short:
                    shingles = _text.grams(words, size)
                    at = np.minimum(np.searchsorted(items.keys, shingles), len(items.keys) - 1)
                    places = np.flatnonzero((items.keys[at] == shingles) & _text.inside(splits, size))
                    rows = np.searchsorted(splits, places, side="right") - 1
                    for r in np.unique(rows).tolist():
                        hits.setdefault(r, {})[size] = places[rows == r] - splits[r]
                for r, own in hits.items():
                    out += [(first + r, *m) for m in items.matches(words[splits[r] : splits[r + 1]], own, least)]
            if out:
                row, item, start, n, score = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(score, pa.float64())], schema.names)

    return data.mapInArrow(one, schema)
