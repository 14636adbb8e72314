"""Connected components: links contracted within tasks, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._cluster import cut, remove

#: Links that a task contracts together.
CONTRACTED = 100_000


def contracted(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Links between each node of ``a`` and ``b`` and the smallest node of its component among them."""
    both = pa.concat_arrays([a, b])
    order = pc.array_sort_indices(both)
    ranks = np.empty(len(both), np.int64)
    coded = pc.dictionary_encode(both.take(order))
    ranks[order.to_numpy()] = coded.indices.to_numpy()  # equal nodes are neighbours, so codes ascend with the nodes
    top = list(range(len(coded.dictionary)))
    for x, y in ranks.reshape(2, -1).T.tolist():
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        while top[y] != y:
            top[y] = top[top[y]]
            y = top[y]
        if x != y:
            top[max(x, y)] = min(x, y)
    for x in range(len(top)):
        top[x] = top[top[x]]  # a smaller node comes first and is at its root already
    ends = np.asarray(top)
    low = np.flatnonzero(ends != np.arange(len(ends)))
    return coded.dictionary.take(pa.array(low)), coded.dictionary.take(pa.array(ends[low]))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        flat = lambda c: pa.concat_arrays(table.column(c).chunks)
        return pa.RecordBatch.from_arrays(list(contracted(flat("u"), flat("v"))), ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= CONTRACTED:
            yield stars()
            held = []
    if held:
        yield stars()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node, root`` of every node of ``links(a, b)``; the root is a component's smallest node.

    Tasks first replace the links that they read by stars. Then each step
    replaces a node's links by links to its smallest neighbour, so stars form
    in a number of rounds that grows with the logarithm of the longest path.
    Minima are aggregated before they are shuffled; the join that hands them
    back is a plain equi-join, which adaptive execution splits where a node has
    very many links. Every round is written to the shared folder. Loops,
    repeated links and nulls do no harm; an empty input gives no rows.
    """
    plain = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut(plain.mapInArrow(_contract, plain.schema).distinct(), label, slim=True)
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if not ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below = 1 and above = 1").take(1):
            break  # each node has one root, and no root has another
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        after = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        new = cut(after.mapInArrow(_contract, plain.schema).distinct(), label, slim=True)
        remove(edges)
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
