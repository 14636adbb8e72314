"""Adapters that read the test tables as file metadata and as a ledger.

``files``: ``id, path, name, ext, size, actual, actual_known, mtime_ns,
volume_id, file_index, resolved`` and, where asked for, ``content``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import paths

#: File name endings by ``doc_id % 6``.
ENDINGS = (".txt", ".md", ".TXT", ".log", ".tmp", "")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, content: bool = True, aliases: bool = False) -> DataFrame:
    """``documents`` as files; other columns follow by arithmetic. ``aliases``: equal texts may be one physical file."""
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("doc_id") % 6 + 1).cast("int"))
    hidden = F.when(F.col("doc_id") % 11 == 0, F.lit("/.h/")).otherwise(F.lit("/"))
    data = F.encode("text", "UTF-8")
    volume = F.substring("source", 4, 10).cast("bigint") % 4
    out = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/"), "source", hidden, "lang", F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path"),
        F.octet_length(data).cast("bigint").alias("size"),
        ((F.lit(1700000000) + F.col("doc_id") * 7919 % 86400) * 1000000000).alias("mtime_ns"),
        volume.alias("volume_id"),
        F.col("doc_id").alias("file_index"),
        (F.col("doc_id") % 7 != 0).alias("resolved"),
        (F.col("doc_id") % 13 != 0).alias("actual_known"),
        data.alias("content"),
    )
    known = F.when(F.col("actual_known"), F.col("size") + F.pmod(-F.col("size"), F.lit(4096))).otherwise(0)
    out = out.withColumn("name", paths.base_name(F.col("path"))).withColumn("ext", paths.extension(F.col("name"))).withColumn("actual", known)
    if aliases:
        first = out.groupBy("volume_id", F.sha2("content", 256).alias("h")).agg(F.min("id").alias("least"))
        out = out.withColumn("h", F.sha2("content", 256)).join(first, ["volume_id", "h"]).withColumn("file_index", F.when(F.col("id") % 5 == 0, F.col("least")).otherwise(F.col("id")))
    columns = ["id", "path", "name", "ext", "size", "actual", "actual_known", "mtime_ns", "volume_id", "file_index", "resolved"]
    return out.select(*columns, *(["content"] if content else []))


def operations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``orders`` and ``lineitem`` as operation records and items; states and kinds stand in for the ledger's."""
    kinds, states = ("trash", "move", "delete", "hardlink", "symlink"), ("planned", "done", "failed", "skipped", "cancelled", "interrupted", "undone", "undo_failed", "undoing")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    ops = table(spark, folder, "orders").select(F.col("o_orderkey").alias("op_id"), pick(kinds, F.col("o_custkey")).alias("op_kind"), F.unix_timestamp("o_orderdate").alias("created_at"), (F.col("o_custkey") % 5 != 2).alias("undoable"))
    items = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_id"),
        F.col("l_orderkey").alias("op_id"),
        F.concat(F.lit("/v"), (F.col("l_suppkey") % 4).cast("string"), F.lit("/p"), F.col("l_partkey").cast("string")).alias("orig_path"),
        (F.col("l_quantity") * 100).cast("bigint").alias("size"),
        pick(states, F.col("l_partkey") + F.col("l_linenumber")).alias("state"),
        (F.col("l_suppkey") % 3 == 0).alias("cross_volume"),
    )
    return ops, items
