"""Row numbers over whole tables and within groups without a task that sorts everything, and joins whose tasks stay small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.scratch import stage

#: Rows that a task of a join or a grouping gets, about, and those that aren't dealt out any further.
TASK_ROWS, FEW_ROWS = 250_000, 10_000
#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
_ROW_BITS = 33


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``, 1..N by ``order``, which must tell all rows apart.

    Rows are dealt by ranges of the order, sorted there and written once; a partition's numbers
    follow from the sizes of those before it, a row a partition. So equal leading
    columns, or a group with a third of all rows, are spread like any others.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(dealt.withColumn("_rank_at", F.monotonically_increasing_id()), "ranked").withColumn("_rank_part", F.shiftright("_rank_at", _ROW_BITS))
    before = Window.orderBy("_rank_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_rank_part").agg(F.count("*").alias("_rank_n")).select("_rank_part", F.coalesce(F.sum("_rank_n").over(before), F.lit(0)).alias("_rank_before"))
    number = F.col("_rank_before") + F.col("_rank_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return placed.join(offsets, "_rank_part").withColumn(name, number.cast("bigint")).drop("_rank_at", "_rank_part", "_rank_before")


def within(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``, 1..n by ``order`` within each group."""
    out = ranked(df, [*(F.col(c) for c in group), *order], "_rank")
    first = out.groupBy(*group).agg(F.min("_rank").alias("_first"))
    return out.join(first, list(group)).withColumn(name, F.col("_rank") - F.col("_first") + 1).drop("_rank", "_first")


def parts_for(df: DataFrame, rows: int) -> int:
    """How many partitions ``rows`` rows are dealt into, so that tasks stay as they are when tables grow."""
    return max(1, -(-rows // TASK_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FEW_ROWS)))
