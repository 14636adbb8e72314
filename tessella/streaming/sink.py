"""Results of a stream as a table: a folder for each batch, written over if the batch comes again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.scratch import stage


def run_to_end(stream: DataFrame, folder: str, checkpoint: str, mode: str = "update") -> None:
    """Process all that has arrived; a run that starts again with the same checkpoint goes on where the last one ended."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The row of the last batch for each of ``keys``."""
    rows = spark.read.parquet(folder)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("m")).select(*keys, *[f"m.{c}" for c in rest])


def in_turns(df: DataFrame, order: str, folder: str, turns: int = 3):
    """Write ``df`` into ``folder`` in ranges of ``order``, one after the other, as if it arrived so; yields after each."""
    held = stage(df, "arrivals")
    cuts = held.agg(F.percentile_approx(order, [k / turns for k in range(1, turns)]).alias("q")).first()["q"] or []
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = held.where((F.lit(True) if lo is None else F.col(order) > F.lit(lo)) & (F.lit(True) if hi is None else F.col(order) <= F.lit(hi)))
        part.write.mode("append").parquet(folder)
        yield
