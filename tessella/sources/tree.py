"""Foreign ledgers and made corpora as sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables and columns of a ledger, by which a foreign one is recognised.
LEDGER = {
    "scan_history": ("id", "saved_at", "roots", "filters", "threads", "paranoid", "groups_count", "files_count", "orig_files", "reclaimable", "failed_json", "keep_paths"),
    "hist_groups": ("id", "hist_id", "hash", "size", "reclaimable", "ord"),
    "hist_files": ("id", "hist_id", "group_id", "path", "size", "mtime_ns"),
    "op_records": ("id", "op_kind", "created_at", "target_dir", "hist_id", "undoable", "done_count", "reclaimed"),
    "op_items": ("id", "op_id", "orig_path", "dest_path", "link_src", "hash", "size", "mtime_ns", "state", "err"),
}


def checked_ledger(tables: Mapping[str, DataFrame]) -> Mapping[str, DataFrame]:
    """The tables, or ValueError naming what a foreign ledger lacks."""
    lacks = [f"{name}.{c}" for name, columns in LEDGER.items() for c in columns if name not in tables or c not in tables[name].columns]
    if lacks:
        raise ValueError("not a ledger: no " + ", ".join(lacks))
    return tables


def corpus(spark: SparkSession, files: int, copies_every: int = 12, seed: int = 1) -> DataFrame:
    """A synthetic corpus by rule: ``path, content``; every ``copies_every``-th file is a copy of the one before."""
    original = F.when(F.col("id") % copies_every == copies_every - 1, F.col("id") - 1).otherwise(F.col("id"))
    body = F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), original.cast("string")), 256)
    repeat = (F.pmod(F.xxhash64(original, F.lit(seed)), F.lit(60)) + 1).cast("int")
    return spark.range(files).select(F.concat(F.lit("/data/"), (F.col("id") % 10).cast("string"), F.lit("/f"), F.col("id").cast("string"), F.lit(".bin")).alias("path"), F.encode(F.repeat(body, repeat), "UTF-8").alias("content"))
