"""Vector code compression (operator 12): product quantisation by Lloyd's rounds with heaps.

Vectors of scaled integers are cut into equal parts; each part position has a
codebook, and a vector becomes the numbers of its parts' nearest entries.

Every part remembers a slack, how much farther its second nearest entry was
than its nearest when it was last compared with all (lower minus upper bound).
Entries move by at most their drift, so a part can only change its entry once
the drift of its entry and the largest drift of the others, summed over rounds,
reach that slack. Each block of vectors keeps, for each entry of each codebook,
a heap of its parts by slack plus the entry's drift so far. A round looks at the
tops: only parts below the drift are popped and compared exactly with all
entries; nothing below an unviolated node is touched. Distances are integers
and bounds are rounded against the part, so results are those of plain rounds.

Blocks (vectors, codes, heaps) are rows of a table that is written anew each
round; tasks work on their own blocks. What moved between entries travels as
sums for each entry and block, which are added up before and after a shuffle.
Only the codebooks, ``parts * entries`` rows, reach the driver and are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._cluster import bound_batches, cut, remove

#: Vectors of a block; fewer if they are long.
BLOCK_ROWS, BLOCK_CELLS = 4096, 1 << 20
#: Components of this magnitude and more would overflow sums of squares.
LARGEST = float(1 << 15)
#: By this share bounds are rounded against a part.
ROUNDING = 1e-9
_DELTA = "array<struct<part: int, entry: int, n: bigint, sums: array<bigint>>>"


def heapify(order: np.ndarray, keys: np.ndarray, firsts: np.ndarray, counts: np.ndarray, which: np.ndarray) -> None:
    """Make binary heaps of the slices ``order[firsts[e] : firsts[e] + counts[e]]``, e in ``which``, all side by side; least key on top."""
    inner = counts[which] // 2
    for depth in reversed(range(int(inner.max(initial=0)).bit_length())):
        first = (1 << depth) - 1
        width = np.clip(inner - first, 0, 1 << depth)
        e = np.repeat(which, width)
        at = first + np.arange(len(e)) - np.repeat(np.cumsum(width) - width, width)
        while len(e):
            base = firsts[e]
            left = 2 * at + 1
            right = np.minimum(left + 1, counts[e] - 1)
            child = np.where(keys[order[base + right]] < keys[order[base + left]], right, left)
            own, below = order[base + at], order[base + child]
            down = keys[below] < keys[own]
            order[(base + at)[down]], order[(base + child)[down]] = below[down], own[down]
            e, at = e[down], child[down]
            deeper = 2 * at + 1 < counts[e]
            e, at = e[deeper], at[deeper]


def violated(order: np.ndarray, keys: np.ndarray, firsts: np.ndarray, counts: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """The members at the tops of the heaps whose key doesn't exceed their entry's ``drift``; no others are looked at but the first below them."""
    e = np.flatnonzero(counts)
    at, found = np.zeros(len(e), np.int64), [np.zeros(0, np.int64)]
    limit = drift + ROUNDING * (drift + 1)
    while len(e):
        members = order[firsts[e] + at]
        bad = keys[members] <= limit[e]
        found.append(members[bad])
        e, at = np.repeat(e[bad], 2), np.repeat(2 * at[bad] + 1, 2)
        at[1::2] += 1
        there = at < counts[e]
        e, at = e[there], at[there]
    return np.concatenate(found)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties: the lowest number), and how much farther the second nearest is, rounded down."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 52 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    away = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    best = away.argmin(1)
    if len(entries) == 1:
        return best, np.full(len(x), np.inf)
    near = away[np.arange(len(x)), best].astype(np.float64)
    away[np.arange(len(x)), best] = np.inf if kind is np.float64 else np.iinfo(np.int64).max
    upper, lower = np.sqrt(near), np.sqrt(away.min(1).astype(np.float64))
    return best, lower - upper - ROUNDING * (lower + upper + 1)


class Block:
    """Vectors with their codes and, for each part position, heaps of their parts by entry."""

    def __init__(self, vectors: np.ndarray, parts: int, codes: np.ndarray | None = None, keys: np.ndarray | None = None, order: np.ndarray | None = None):
        n = len(vectors)
        self.vectors, self.parts = vectors, parts
        self.codes = np.full((parts, n), -1, np.int32) if codes is None else codes
        self.keys = np.zeros((parts, n)) if keys is None else keys
        self.order = np.zeros((parts, n), np.int32) if order is None else order
        self.scanned = 0

    def part(self, p: int) -> np.ndarray:
        width = self.vectors.shape[1] // self.parts
        return self.vectors[:, p * width : (p + 1) * width].astype(np.int64)

    def round(self, books: list[np.ndarray], drifts: list[np.ndarray] | None) -> list[dict]:
        """Assign parts to the entries of ``books`` (all at first, then those that ``drifts`` violates); the sums that moved."""
        moved = []
        for p, entries in enumerate(books):
            x, codes, keys, order, k = self.part(p), self.codes[p], self.keys[p], self.order[p], len(entries)
            drift = np.zeros(k) if drifts is None else drifts[p]
            counts = np.bincount(codes[codes >= 0], minlength=k)
            if drifts is None:
                popped = np.arange(len(x))
            else:
                popped = violated(order, keys, np.cumsum(counts) - counts, counts, drift)
            self.scanned += len(popped)
            if not len(popped):
                continue
            best, slack = nearest(x[popped], entries)
            old = codes[popped].copy()
            codes[popped], keys[popped] = best, slack + drift[best]
            stay = np.ones(len(x), bool)
            stay[popped] = False
            rest = order[stay[order]] if drifts is not None else popped[:0]
            rows = np.concatenate([rest, popped]).astype(np.int32)
            order[:] = rows[np.argsort(codes[rows], kind="stable")]
            counts = np.bincount(codes, minlength=k)
            heapify(order, keys, np.cumsum(counts) - counts, counts, np.unique(np.concatenate([old[old >= 0], best])))
            change = old != best
            sums, sizes = np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)
            for at, sign in ((best[change], 1), (old[change], -1)):
                own = at >= 0
                np.add.at(sums, at[own], sign * x[popped][change][own])
                np.add.at(sizes, at[own], sign)
            for e in np.flatnonzero(sizes.astype(bool) | sums.any(1)):
                moved.append({"part": p, "entry": int(e), "n": int(sizes[e]), "sums": sums[e].tolist()})
        return moved

    def errors(self, books: list[np.ndarray]) -> np.ndarray:
        return sum((((self.part(p) - entries[self.codes[p]]) ** 2).sum(1) for p, entries in enumerate(books)), np.zeros(len(self.vectors), np.int64))


def next_books(books: list[np.ndarray], totals: list[tuple[np.ndarray, np.ndarray]], drifts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Entries at the floors of their parts' means, unused ones unmoved; and drifts so far, rounded up."""
    new, far = [], []
    for entries, (sums, sizes), drift in zip(books, totals, drifts, strict=True):
        mean = np.where(sizes[:, None] > 0, sums // np.maximum(sizes, 1)[:, None], entries)
        own = np.sqrt(((mean - entries) ** 2).sum(1).astype(np.float64)) * (1 + ROUNDING)
        others = np.full(len(own), own.max(initial=0))
        if len(own) > 1:
            others[own.argmax()] = np.delete(own, own.argmax()).max()
        new.append(mean)
        far.append(drift + own + others)
    return new, far


class VectorCodes:
    """``table``: ``row, codes, error``; ``books``: for each part position its entries."""

    def __init__(self, table: DataFrame, books: list[np.ndarray]):
        self.table, self.books = table, books

    def sha256(self) -> str:
        """Of all components by part, entry and position, as decimals with commas between."""
        return hashlib.sha256(",".join(str(c) for b in self.books for c in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> VectorCodes:
    """Codes of ``df``'s vectors by codebooks that are trained on all of them; ``table`` has a row for each vector that takes part.

    ``row`` is a struct of the input's other columns, so no name can clash;
    ``codes`` the entry of each part (from 0), ``error`` the squared distances of
    the parts to their entries, summed. Component x counts as floor(scale * x).
    Codebooks start as the parts of the ``entries`` smallest ids (null ids last,
    equal ids by their vectors); with fewer vectors they have fewer entries.
    Repeated rows all count. Vectors that are null or empty, hold a null, a
    component that isn't finite or is of magnitude 2**15 and more, or have
    another number of components than the smallest id's, take no part. Without a
    vector the table and the books are empty. The number of components must be a
    multiple of ``parts``.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != vector]).alias("row")
    kept = df.select(rest, F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    kept = kept.where(F.expr(f"v is not null and size(v) > 0 and forall(v, x -> x is not null and abs(x) < {LARGEST})"))  # a NaN is larger than all
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(1).collect()
    out = T.StructType([kept.schema["row"], T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    if not first:
        return VectorCodes(spark.createDataFrame([], out), [])
    dims = len(first[0]["v"])
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    kept = kept.where(F.size("v") == dims)
    seeds = kept.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.split(np.floor(scale * np.array([r["v"] for r in seeds])).astype(np.int64), parts, axis=1)
    size = max(1, min(BLOCK_ROWS, BLOCK_CELLS // dims))
    state = T.StructType([T.StructField("rows", T.ArrayType(kept.schema["row"].dataType)), *(T.StructField(c, T.BinaryType()) for c in ("vectors", "codes", "keys", "heaps")), T.StructField("moved", T._parse_datatype_string(_DELTA))])

    def row_of(rows: pa.Array, block: Block, moved: list[dict]) -> pa.RecordBatch:
        binary = [pa.array([x.tobytes()], pa.binary()) for x in (block.vectors, block.codes, block.keys, block.order)]
        delta = pa.array([moved], pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), *binary, delta], state.names)

    def load(batch: pa.RecordBatch, k: int) -> tuple[pa.Array, Block]:
        take = lambda c, kind, shape: np.frombuffer(batch.column(c)[k].as_buffer(), kind).reshape(shape).copy()
        return batch.column(0)[k].values, Block(take(1, np.int32, (-1, dims)), parts, take(2, np.int32, (parts, -1)), take(3, np.float64, (parts, -1)), take(4, np.int32, (parts, -1)))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, vectors = [], []

        def close() -> pa.RecordBatch:
            block = Block(np.concatenate(vectors), parts)
            out = row_of(pa.concat_arrays(rows), block, block.round(books, None))
            rows.clear()
            vectors.clear()
            return out

        for batch in batches:
            for k in range(0, batch.num_rows, size):
                some = batch.slice(k, size)
                if rows and sum(map(len, rows)) + some.num_rows > size:
                    yield close()
                rows.append(some.column(0))
                vectors.append(np.floor(scale * some.column(1).flatten().to_numpy(zero_copy_only=False)).astype(np.int32).reshape(-1, dims))
        if rows:
            yield close()

    table = cut(kept.select("row", "v").mapInArrow(begin, state), "vector-blocks")
    width = dims // parts
    totals = [(np.zeros((len(b), width), np.int64), np.zeros(len(b), np.int64)) for b in books]
    drifts = [np.zeros(len(b)) for b in books]
    for _ in range(rounds):
        one = table.select(F.explode("moved").alias("m")).select("m.part", "m.entry", "m.n", "m.sums")
        summed = one.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        for r in summed.collect():  # parts * entries rows at most
            sums, sizes = totals[r["part"]]
            sums[r["entry"]] += np.array(r["sums"], np.int64)
            sizes[r["entry"]] += r["n"]
        new, far = next_books(books, totals, drifts)
        still = all((a == b).all() for a, b in zip(books, new, strict=True))
        books, drifts = new, far
        if still:
            break

        def again(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books, drifts: list[np.ndarray] = drifts) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    rows, block = load(batch, k)
                    yield row_of(rows, block, block.round(books, drifts))

        old, table = table, cut(table.mapInArrow(again, state), "vector-blocks")
        remove(old)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, block = load(batch, k)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * parts + 1, parts, dtype=np.int32)), pa.array(np.ascontiguousarray(block.codes.T).ravel()))
                yield pa.RecordBatch.from_arrays([rows, codes, pa.array(block.errors(books))], out.names)

    found = cut(table.mapInArrow(finish, out), "vector-codes")
    remove(table)
    return VectorCodes(found, books)
