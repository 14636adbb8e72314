"""The incremental hash cache: ``path, size, mtime_ns, head, mid1, mid2, tail, full, last_hit, dev, ino``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import dedup
from tessella.operators.rank import ranked
from tessella.sources.scratch import stage

SAMPLES = ("head", "mid1", "mid2", "tail")
#: Rows that a cache keeps.
MOST_ROWS = 500_000
#: Caches of another version are dropped.
VERSION = 3


def _blank(prefix: str = "") -> Column:
    out = F.lit(True)
    for c in SAMPLES:
        out &= F.coalesce(F.col(prefix + c), F.lit(0)) == 0
    return out


def empty(cache: DataFrame) -> DataFrame:
    """A cleared cache."""
    return cache.where(F.lit(False))


def cleared(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A cleared cache, and the snapshot that was written before, by which it can be taken back."""
    kept = stage(cache, "cache-snapshot")
    return empty(cache), kept


def usable(cache: DataFrame, version: int) -> DataFrame:
    return cache if version == VERSION else empty(cache)


def lookup(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``files(path, size, mtime_ns, dev, ino, resolved)`` with ``verdict`` and the cached samples and full hash.

    ``hit`` needs equal size and time, the same identity if it is resolved, and
    samples that aren't all zero; else ``stale``, or ``miss`` without a row.
    """
    old = cache.select("path", *[F.col(c).alias(f"c_{c}") for c in ("size", "mtime_ns", "dev", "ino", "full", *SAMPLES)])
    same = (F.col("size") == F.col("c_size")) & (F.col("mtime_ns") == F.col("c_mtime_ns")) & (~F.col("resolved") | ((F.col("dev") == F.col("c_dev")) & (F.col("ino") == F.col("c_ino")))) & ~_blank("c_")
    out = files.join(old, "path", "left")
    return out.withColumn("verdict", F.when(F.col("c_size").isNull(), "miss").when(same, "hit").otherwise("stale")).drop("c_size", "c_mtime_ns", "c_dev", "c_ino")


def trusted_full(looked: DataFrame) -> DataFrame:
    """``cached_full``: the cached full hash, if all samples of this run equal the cached ones and it has 32 bytes."""
    same = F.col("verdict") == "hit"
    for c in SAMPLES:
        same &= F.col(c).eqNullSafe(F.col(f"c_{c}"))
    return looked.withColumn("cached_full", F.when(same & (F.length("c_full") == 64), F.col("c_full")))


def upsert(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache after ``entries`` of the same columns, at most one a path.

    Samples that are all zero leave the old ones. A new full hash wins; without
    one the old stays if size, time and samples are the same or no samples came.
    """
    columns = ["path", "size", "mtime_ns", *SAMPLES, "full", "last_hit", "dev", "ino"]
    old, new = cache.select(*[F.col(c).alias(f"o_{c}") for c in columns]), entries.select(*[F.col(c).alias(f"n_{c}") for c in columns])
    both = old.join(new, F.col("o_path") == F.col("n_path"), "full_outer")
    blank, came, had = _blank("n_"), F.col("n_path").isNotNull(), F.col("o_path").isNotNull()
    same = (F.col("o_size") == F.col("n_size")) & (F.col("o_mtime_ns") == F.col("n_mtime_ns"))
    equal = F.lit(True)
    for c in SAMPLES:
        equal &= F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    full = F.when(~came, F.col("o_full")).when(F.col("n_full").isNotNull(), F.col("n_full")).when(had & same & (equal | blank), F.col("o_full"))
    out = {c: F.when(came, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")) for c in columns}
    out |= {c: F.when(came & ~(blank & had), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")) for c in SAMPLES}
    return both.select(*[(full if c == "full" else e).alias(c) for c, e in out.items()])


def touch(cache: DataFrame, hits: DataFrame, now: int) -> DataFrame:
    """``last_hit`` of the paths in ``hits`` becomes ``now``."""
    return cache.join(hits.select("path", F.lit(True).alias("_h")).distinct(), "path", "left").withColumn("last_hit", F.when(F.col("_h"), F.lit(now)).otherwise(F.col("last_hit"))).select(*cache.columns)


def evict(cache: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The ``most`` latest by ``last_hit``, then the greatest paths."""
    return ranked(cache, [F.col("last_hit").desc(), F.col("path").desc()], "_rank").where(F.col("_rank") <= most).drop("_rank")


def incremental(files: DataFrame, cache: DataFrame, chunk: int = dedup.CHUNK, small: int = dedup.SMALL, contents: dedup.Contents | None = None) -> dedup.Found:
    """What a run finds that takes full hashes from the cache where it may.

    ``files`` has ``dev, ino`` and, unless ``contents`` are elsewhere, ``content``.
    Samples are taken of files that share a size; of those that share samples too
    only the ones that the cache lacks are read as a whole.
    """

    def known(rows: DataFrame) -> DataFrame:
        return trusted_full(lookup(rows, cache)).withColumnRenamed("cached_full", "cached").drop("verdict", *[f"c_{c}" for c in ("full", *SAMPLES)])

    return dedup.detect(files.drop("content"), contents or dedup.InTable(files), chunk, small, known=known)


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.count("full").alias("with_full"))
