"""Incremental scans of arriving files: an extension, since the batch engine has no streams of its own.

Each batch of files meets the cache store: what it knows by path, size and time
keeps its hash, the rest is read. A batch goes into the store with its number,
in one version, so one that comes again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.store import CacheStore
from tessella.sources.contents import CHUNK, SAMPLES, SMALL, OnDisk
from tessella.sources.scratch import stage


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files below a folder as ``path, size, mtime_ns``, not opened; their number per batch is bounded."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return found.where("length > 0").select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def take_in(store: CacheStore, batch: DataFrame, name: str, number: int, now: int, chunk: int = CHUNK, small: int = SMALL) -> int:
    """Put the files of a batch into the store; how many were read. A batch that is in already is left out."""
    if store.committed(name) >= number:
        return 0
    rows = batch.groupBy("path").agg(F.max(F.struct("mtime_ns", "size")).alias("m")).select("path", "m.size", "m.mtime_ns")
    known = store.read().select("path", F.col("size").alias("c_size"), F.col("mtime_ns").alias("c_mtime_ns"), F.col("full").alias("c_full"))
    met = rows.join(known, "path", "left").withColumn("same", F.coalesce((F.col("size") == F.col("c_size")) & (F.col("mtime_ns") == F.col("c_mtime_ns")) & F.col("c_full").isNotNull(), F.lit(False)))
    met = stage(met.withColumn("id", F.col("path")), "arrived")
    contents = OnDisk()
    taken = stage(contents.samples(met.where("not same").select("id", "path", "size", "mtime_ns"), chunk, small).where("problem is null"), "arrived-samples")
    fine = taken.withColumn("size", F.col("length")).drop("problem", "read_bytes", "length")
    whole = contents.hashes(fine.where("hash is null").drop("hash")).where("problem is null").drop("problem", "read_bytes")
    entries = fine.where("hash is not null").unionByName(whole)
    zero = F.lit(0).cast("bigint")
    fresh = entries.select("path", "size", "mtime_ns", *SAMPLES, F.col("hash").alias("full"), F.lit(now).alias("last_hit"), zero.alias("dev"), zero.alias("ino"))
    again = met.where("same").select("path", "size", "mtime_ns", *[zero.alias(c) for c in SAMPLES], F.lit(None).cast("string").alias("full"), F.lit(now).alias("last_hit"), zero.alias("dev"), zero.alias("ino"))
    store.upsert(fresh.unionByName(again), (name, number))
    return taken.count()


def run_once(seen: DataFrame, store: CacheStore, name: str, checkpoint: str, now: int = 0) -> None:
    """Take in all that has arrived, then stop."""
    seen.writeStream.foreachBatch(lambda batch, number: take_in(store, batch, name, number, now) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def duplicates(store: CacheStore) -> DataFrame:
    """``size, hash, n_files, reclaimable`` of contents that the store holds more than once."""
    g = store.read().where("full is not null").groupBy("size", F.col("full").alias("hash")).agg(F.count("*").alias("n_files"))
    return g.where("n_files > 1").withColumn("reclaimable", (F.col("n_files") - 1) * F.col("size"))
