"""Exact top-k search (operator 4): a Voronoi kNN join for the inner product.

* Pivots are vectors of a sample of bounded size, chosen far apart; their number
  grows with the square root of the table. Every vector goes to the cell of its
  nearest pivot.
* A summary of each cell holds the distance of its farthest member and the least
  and greatest value of each component. A member ``x`` of a cell with pivot
  ``p`` and radius ``r`` scores at most ``q.p + |q| r`` by Cauchy-Schwarz, and at
  most the sum over components of the greater of ``q_i lo_i`` and ``q_i hi_i``.
* Pivots are members themselves, so a query's k-th best score among them is a
  score that its k-th best vector reaches for sure; so is the least that any
  member of a cell of more than k can have. Cells whose bound is below the
  greatest of these are left out. The query, the smaller side, is replicated to
  what remains; data vectors are never replicated.
* Large cells are split, neighbouring small ones are put together, so that all
  blocks are of bounded size, also where a cell holds a third of all rows. Blocks
  next to each other form a group; a query goes once to each group with a block
  that it needs, and names those blocks with their bounds. A task holds a group
  and the queries pass by: each takes its blocks by falling bound, by matrix
  products, and is done when the next bound is below its k-th score so far. The
  best of the groups are merged by a window.

How much is left out depends on the data. Vectors in clusters need few cells.
Vectors without any structure in many dimensions are all about equally far from
each other, so that no bound of this kind can exclude a cell; then every query
meets every block, which is still solved exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._cluster import bound_batches, cut

#: Cells at most (for 16,777,216 vectors; beyond, cells grow and have several blocks), and vectors of the sample that their pivots are chosen from.
MOST_PIVOTS, SAMPLE_ROWS = 4096, 16_384
#: Vectors of a block at most, and bytes of its matrix.
BLOCK_ROWS, BLOCK_BYTES = 8192, 1 << 24
#: Bytes of the blocks that a task holds at a time; a query goes once to each such group of blocks.
GROUP_BYTES = 1 << 26
#: Queries that are solved together.
QUERY_ROWS = 256


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component; null if the vector or a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~odd, F.transform(wide, lambda x: F.floor(x * scale)))


def _matrix(rows: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for r, data in enumerate(rows):
        x = np.frombuffer(data, np.int64)
        out[r, : len(x)] = x
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where that is exact."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best_of(scores: np.ndarray, ids: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
    """The ``k`` highest scores with their ids, ties to smaller ids; ``ids`` ascend, and ``own`` is left out."""
    scores, ids = (scores[ids != own], ids[ids != own])
    if len(scores) > k:
        top = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        scores, ids = scores[top], ids[top]
    order = np.argsort(-scores, kind="stable")[:k]
    return list(zip(scores[order].tolist(), ids[order].tolist(), strict=True))


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Numbers of up to ``count`` different rows, each the farthest from those before it."""
    x = sample.astype(np.float64)
    chosen, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.asarray(chosen)


@dataclass
class Cells:
    """Pivots with their ids, and of each cell its size, its radius and the least and greatest values of components."""

    ids: np.ndarray
    pivots: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its distance from the pivot."""
        x, p = x.astype(np.float64), self.pivots.astype(np.float64)
        cell = ((p * p).sum(axis=1)[None] - 2 * x @ p.T).argmin(axis=1)
        return cell, np.sqrt(((x - p[cell]) ** 2).sum(axis=1))

    def needed(self, queries: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Which cells (columns) may hold one of the ``k`` best of each query (rows), whose ids are ``own``."""
        upper, least = self.bounds(queries, own, k)
        return upper >= least[:, None]

    def bounds(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """What a score in each cell (column) can be at most, and a score that the ``k`` best of each query (row) reach; the queries' ids are ``own``."""
        q, p = queries.astype(np.float64), self.pivots.astype(np.float64)
        scores = q @ p.T
        sure = np.where(self.ids[None] == own[:, None], -np.inf, scores)
        least = np.partition(sure, -k, axis=1)[:, -k] if len(self.ids) >= k else np.full(len(q), -np.inf)
        size = np.sqrt((q * q).sum(axis=1))
        reach = np.sqrt((np.maximum(np.abs(self.low), np.abs(self.high)) ** 2).sum(axis=1).max(initial=0))
        if float(size.max(initial=0)) * reach >= 2**62:  # scores may wrap around, so no bound holds
            return np.full(scores.shape, np.inf), np.full(len(q), -np.inf)
        far, slack = size[:, None] * self.radius[None], 1e-9 * (1 + size[:, None]) * (1 + reach)
        box = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        full = self.sizes > k  # one more, as the query may be one of them
        if full.any():
            floor = np.maximum(scores - far, np.maximum(q, 0) @ self.low.T + np.minimum(q, 0) @ self.high.T) - slack
            least = np.maximum(least, floor[:, full].max(axis=1))
        return np.minimum(scores + far, box) + slack, least


def _summaries(placed: DataFrame, pivots: np.ndarray, ids: np.ndarray, width: int) -> Cells:
    """The cells of ``placed(cell, far, data)``; merged in a stream, a row a cell at the end."""
    schema = "cell int, n bigint, far double, low binary, high binary"

    def merge(rows, held: dict[int, list]) -> None:
        for cell, n, far, low, high in rows:
            old = held.get(cell)
            held[cell] = [n, far, low, high] if old is None else [old[0] + n, max(old[1], far), np.minimum(old[2], low), np.maximum(old[3], high)]

    def batch_of(held: dict[int, list]) -> pa.RecordBatch:
        n, far, low, high = zip(*held.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(n, pa.int64()), pa.array(far, pa.float64()), *(pa.array([x.tobytes() for x in side], pa.binary()) for side in (low, high))], ["cell", "n", "far", "low", "high"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("data").to_pylist(), width)
            cell, far = batch.column("cell").to_numpy(), batch.column("far").to_numpy()
            order = np.argsort(cell, kind="stable")
            at = np.flatnonzero(np.diff(cell[order], prepend=-1))
            sides = (f.reduceat(x[order], at, axis=0) for f in (np.minimum, np.maximum))
            merge(zip(cell[order][at].tolist(), np.diff(np.append(at, len(order))).tolist(), np.maximum.reduceat(far[order], at).tolist(), *sides, strict=True), held)
        if held:
            yield batch_of(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cell", "n", "far")] + [[np.frombuffer(x, np.int64) for x in batch.column(c).to_pylist()] for c in ("low", "high")]
            merge(zip(*columns, strict=True), held)
        if held:
            yield batch_of(held)

    found = placed.select("cell", "far", "data").mapInArrow(one, schema).repartition("cell").mapInArrow(add, schema).collect()
    sizes, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    low, high = pivots.copy(), pivots.copy()
    for r in found:
        c = r["cell"]
        sizes[c], radius[c], low[c], high[c] = r["n"], r["far"], np.frombuffer(r["low"], np.int64), np.frombuffer(r["high"], np.int64)
    return Cells(ids, pivots, sizes, radius, low, high)


def blocks_of(sizes: np.ndarray, pivots: np.ndarray, most: int) -> list[tuple[int, int]]:
    """First block and number of blocks of each cell: large cells have several, neighbouring small ones share one."""
    x, left = pivots.astype(np.float64), set(range(len(sizes)))
    out, block, room, now = [(0, 1)] * len(sizes), -1, 0, 0
    while left:
        now = min(left, key=lambda c: (((x[c] - x[now]) ** 2).sum(), c))
        left.remove(now)
        n = int(sizes[now])
        if n > most:
            parts = -(-n // most)
            out[now] = (block + 1, parts)
            block, room = block + parts, 0
        else:
            if n > room or block < 0:
                block, room = block + 1, most
            out[now] = (block, 1)
            room -= n
    return out


class Nearby:
    """The blocks of a group: vectors by block, ascending ids in each."""

    def __init__(self, width: int):
        self.width, self.rows, self.ready = width, {}, {}
        self.compared = 0

    def add(self, block: int, ids: list[int], data: list[bytes]) -> None:
        held = self.rows.setdefault(block, ([], []))
        held[0].extend(ids)
        held[1].extend(data)

    def _block(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        if block not in self.ready:
            ids, data = self.rows.pop(block)
            order = np.argsort(np.asarray(ids), kind="stable")
            self.ready[block] = np.asarray(ids)[order], _matrix([data[o] for o in order], self.width)
        return self.ready[block]

    def solve(self, queries: np.ndarray, own: list[int], blocks: list[list[int]], bounds: list[list[float]], k: int) -> list[list[tuple[int, int]]]:
        """The ``k`` best of each query as ``(-score, id)``, from the blocks that it asks for.

        Each query takes its blocks by falling bound; it is done when the next can't
        reach its k-th score so far. Queries that take the same block are multiplied
        together.
        """
        best: list[list[tuple[int, int]]] = [[] for _ in own]
        steps = [sorted(zip((-b for b in bound), block, strict=True), reverse=True) for bound, block in zip(bounds, blocks, strict=True)]
        while True:
            turn: dict[int, list[int]] = {}
            for r, todo in enumerate(steps):
                if todo and (len(best[r]) < k or -todo[-1][0] >= -best[r][-1][0]):
                    turn.setdefault(todo.pop()[1], []).append(r)
            if not turn:
                return best
            for block, rows in turn.items():
                if block not in self.rows and block not in self.ready:
                    continue  # the query's own vector may have been its only one
                ids, matrix = self._block(block)
                self.compared += len(rows) * len(ids)
                for r, scores in zip(rows, _product(queries[rows], matrix), strict=True):
                    best[r] = sorted(best[r] + [(-s, i) for s, i in best_of(scores, ids, k, own[r])])[:k]


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, most_pivots: int =
    MOST_PIVOTS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, <id_col>, score``: the ``k`` best of all other rows for each row where ``queries`` holds.

    Scores are inner products of ``floor(scale * x)``, ties go to smaller ids.
    Rows with a null id or vector, or with a component that is null or not
    finite, take no part. A query's own id is never returned; a repeated row is
    a candidate as often as it is there, and one query. Of vectors of unequal
    length the shorter counts as filled up with zeros. With fewer candidates
    than ``k`` all are returned; an empty table gives no rows. Products beyond
    64 bits wrap around. Other columns are read by ``queries`` alone, so their
    names can't clash.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    clean = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), quantised(F.col(f"`{vector}`"), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("id is not null and v is not null")
    whole = clean.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    schema = "query_id bigint, rank int, id bigint, score bigint"
    if not whole["n"]:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    width = max(1, whole["width"])
    sample = clean.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
    vectors_of = np.asarray([r["v"] + [0] * (width - len(r["v"])) for r in sample], np.int64).reshape(len(sample), width)
    chosen = far_apart(vectors_of, max(4 * k, min(most_pivots, math.isqrt(whole["n"]))))
    pivots, ids = vectors_of[chosen], np.asarray([r["id"] for r in sample])[chosen]
    centres = spark.sparkContext.broadcast(Cells(ids, pivots, *[np.zeros(0)] * 4))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))])
            data = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            cell, far = centres.value.nearest(_matrix(data, width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(data, pa.binary()), pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "asks", "data", "cell", "far"])

    placed = cut(clean.mapInArrow(assign, "id bigint, asks boolean, data binary, cell int, far double"), "topk-cells")
    cells = _summaries(placed, pivots, ids, width)
    blocks = blocks_of(cells.sizes, pivots, max(1, min(block_rows, BLOCK_BYTES // (8 * width))))
    shared = spark.sparkContext.broadcast((cells, blocks))
    each = max(1, GROUP_BYTES // (8 * width * max(1, min(block_rows, BLOCK_BYTES // (8 * width)))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group of blocks that may hold one of the query's best, with those blocks and their bounds."""
        cells, blocks = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            upper, least = cells.bounds(_matrix(batch.column(1).to_pylist(), width), batch.column(0).to_numpy(), k)
            rows, groups, own, reach = [], [], [], []
            for r in range(len(upper)):
                bound: dict[int, float] = {}
                for c in np.flatnonzero((upper[r] >= least[r]) & (cells.sizes > 0)).tolist():
                    for b in range(blocks[c][0], sum(blocks[c])):
                        bound[b] = max(bound.get(b, -np.inf), float(upper[r, c]))
                for g in sorted({b // each for b in bound}):
                    rows.append(r)
                    groups.append(g)
                    own.append([b for b in bound if b // each == g])
                    reach.append([bound[b] for b in own[-1]])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), *(batch.column(c).take(take) for c in range(2)), pa.array(own, pa.list_(pa.int32())), pa.array(reach, pa.list_(pa.float64()))], ["group", "id", "data", "blocks", "bounds"])

    asked = placed.where("asks").select("id", "data").distinct().mapInArrow(spread, "group int, id bigint, data binary, blocks array<int>, bounds array<double>").withColumn("side", F.lit(1))
    first, parts = (F.array(*[F.lit(x[j]) for x in blocks])[F.col("cell")] for j in (0, 1))
    block = (first + F.pmod(F.xxhash64("id", "data", F.lit(7)), parts)).cast("int")
    held = placed.select(block.alias("block"), "id", "data").select(F.expr(f"block div {each}").cast("int").alias("group"), "id", "data", F.array("block").alias("blocks"), F.lit(None).cast("array<double>").alias("bounds"), F.lit(0).alias("side"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group, its vectors first, then the queries."""
        now, near = None, Nearby(width)
        for batch in batches:
            at, n = 0, batch.num_rows
            group, side = batch.column("group").to_numpy(), batch.column("side").to_numpy()
            while at < n:
                end = at + int(np.argmax((group[at:] != group[at]) | (side[at:] != side[at]))) or n
                end = end if end > at else n
                some = batch.slice(at, min(end - at, QUERY_ROWS) if side[at] else end - at)
                if group[at] != now:
                    now, near = group[at], Nearby(width)
                ids, data, blocks = (some.column(c).to_pylist() for c in ("id", "data", "blocks"))
                if side[at] == 0:
                    for i, x, (b,) in zip(ids, data, blocks, strict=True):
                        near.add(b, [i], [x])
                else:
                    found = near.solve(_matrix(data, width), ids, blocks, some.column("bounds").to_pylist(), k)
                    out = [(query, i, -s) for query, best in zip(ids, found, strict=True) for s, i in best]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["query_id", "id", "score"])
                at += some.num_rows

    solved = held.unionByName(asked).repartition("group").sortWithinPartitions("group", "side").mapInArrow(solve, "query_id bigint, id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
