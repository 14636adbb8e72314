"""Progress of a run from its events: windows of time, speed and what is left; the same over a table and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import formats


def windows(events: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``stage, start, files, bytes`` of ``events(stage, at, arrived, files, bytes)``.

    An event that arrived more than ``late`` after its time is dropped: by a rule
    on the event itself, so a table and a stream drop the same ones. A stream also
    has a watermark of that length, so its state is a few windows a stage. Nulls
    in ``at`` or ``arrived`` are dropped.
    """
    kept = events.where(F.col("arrived") <= F.col("at") + F.expr(f"interval {late}"))
    if kept.isStreaming:
        kept = kept.withWatermark("at", late)
    g = kept.groupBy("stage", F.window("at", length).alias("w"))
    return g.agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes")).select("stage", F.col("w.start").alias("start"), "files", "bytes")


def speeds(found: DataFrame, totals: DataFrame, length: str = "1 hour") -> DataFrame:
    """``stage, start, files, bytes, speed, percent, eta``: the latest window of each stage, with the mean speed since the first.

    ``totals(stage, total)``: bytes of a stage; unknown ones give 0 percent and an ETA of -1.
    """
    end = F.col("last.start") + F.expr(f"interval {length}")
    per = found.groupBy("stage").agg(F.min("start").alias("first"), F.max(F.struct("start", "files", "bytes")).alias("last"), F.sum("bytes").alias("done"))
    per = per.join(totals, "stage", "left").withColumn("elapsed", (F.unix_micros(end) - F.unix_micros("first")) / 1e6)
    speed = F.round(F.col("done") / F.col("elapsed"), 6)
    share, eta = F.round(formats.percent(F.col("done"), F.col("total")), 6), formats.eta_seconds(F.col("done"), F.coalesce("total", F.lit(0)), F.col("elapsed"))
    return per.select("stage", F.col("last.start").alias("start"), F.col("last.files").alias("files"), F.col("last.bytes").alias("bytes"), speed.alias("speed"), share.alias("percent"), eta.alias("eta"))
