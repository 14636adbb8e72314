"""A walk of file trees: directories are listed in tasks, a level of all trees at a time.

The frontier is a table of directories. Each round lists it, keeps what was
found, and takes as the next frontier the directories that nothing prunes, so
an excluded tree is never entered. Rounds are as many as the trees are deep;
only their number, never an entry, is known to the driver.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import classify, paths
from tessella.operators.scan import Filters
from tessella.sources.scratch import stage

#: Entries that a task hands on at a time; a directory may have any number.
_BATCH = 10_000
#: Contents that a task is handed at a time: rows and bytes.
_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
_LISTED = "id bigint, path string, root string, kind string, size bigint, mtime_ns bigint, volume_id bigint, file_index bigint, blocks bigint, links bigint, problem string"
#: A walk ends after so many levels.
MOST_LEVELS = 1 << 10
_KINDS = ((stat.S_ISREG, "file"), (stat.S_ISDIR, "dir"), (stat.S_ISLNK, "symlink"))


@dataclass(frozen=True)
class Listing:
    """``files`` of all kinds but directories, ``rejects(path, reason)`` that couldn't be read, ``pruned(path, reason)`` directories, and how many were listed."""

    files: DataFrame
    rejects: DataFrame
    pruned: DataFrame
    listed: int


def entries(folder: str) -> Iterator[tuple]:
    """``path, kind, size, mtime_ns, volume_id, file_index, blocks, links, problem`` of what a directory holds; symlinks aren't followed."""
    none = (None,) * 6
    try:
        with os.scandir(folder) as found:
            for e in found:
                try:
                    e.name.encode()
                except UnicodeEncodeError:
                    yield (os.fsencode(e.path).decode(errors="replace"), "problem", *none, "UnicodeEncodeError")
                    continue
                try:
                    s = e.stat(follow_symlinks=False)
                except OSError as x:
                    yield (e.path, "problem", *none, type(x).__name__)
                    continue
                kind = next((name for test, name in _KINDS if test(s.st_mode)), "other")
                yield e.path, kind, s.st_size, s.st_mtime_ns, s.st_dev, s.st_ino, getattr(s, "st_blocks", None), s.st_nlink, None
    except OSError as x:
        yield (folder, "problem", *none, type(x).__name__)


def _list(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(c.split() for c in _LISTED.split(", ")), strict=True)
    types = [pa.int64() if k == "bigint" else pa.string() for k in kinds]
    first = (level << 52) + (TaskContext.get().partitionId() << 36)
    rows: list[tuple] = []

    def close() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))
        rows.clear()
        return out

    for batch in batches:
        for folder, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for path, *rest in entries(folder):
                rows.append((first, path, root, *rest))
                first += 1
                if len(rows) == _BATCH:
                    yield close()
    if rows:
        yield close()


def _pruned(filters: Filters, platform: str, number: Column) -> Column:
    """Why a directory isn't entered: ``protected``, ``hidden`` or ``excluded``; null if it is."""
    path, rel = F.col("path"), F.col("rel")
    name = paths.base_name(path)
    out = F.when(classify.protected_dir(name, platform) | classify.protected_path(path, platform), "protected")
    if not filters.hidden:
        out = out.when(paths.hidden_name(name), "hidden")
    for pattern in filters.exclude:
        if paths.prunable(pattern):
            out = out.when(filters.excluded(pattern, rel, number), "excluded")
    for folder in filters.exclude_dirs:
        out = out.when(paths.under(path, paths.dir_key(F.lit(folder))), "excluded")
    return out


def walk(spark: SparkSession, roots: Sequence[str], filters: Filters | None = None, platform: str = "linux") -> Listing:
    """What lies below ``roots``, folders that all machines mount.

    ``files``: ``id, path, name, ext, rel, root_ord, kind, size, mtime_ns,
    volume_id, file_index, resolved, actual, actual_known, flags``; of all kinds
    and sizes, since gates and filters of files are the scan's. Directories that
    are protected, hidden (unless asked for) or excluded aren't entered, but a
    root is, whatever its name. A root below another is walked on its own and
    not from there, so no path appears twice. Directories and entries that
    can't be read, and names that aren't UTF-8, are rejects.
    """
    filters = filters or Filters()
    clean = list(dict.fromkeys(os.path.normpath(r) for r in roots))
    frontier = spark.createDataFrame([(r, r) for r in clean], "path string, root string")
    number = F.lit(-1)
    for k, root in reversed(list(enumerate(clean))):
        number = F.when(F.col("root") == root, k).otherwise(number)
    levels, listed = [], 0
    for level in range(MOST_LEVELS):
        n = frontier.count()
        if not n:
            break
        listed += n
        spread = frontier.repartition(min(n, 8 * spark.sparkContext.defaultParallelism))
        found = stage(spread.mapInArrow(lambda batches, level=level: _list(batches, level), _LISTED), "listed")
        cut = F.when(F.col("root") == "/", 2).otherwise(F.char_length("root") + 2)
        levels.append(found.withColumn("rel", F.substr("path", cut)))
        levels[-1] = levels[-1].withColumn("pruned", F.when(F.col("kind") == "dir", _pruned(filters, platform, number)))
        frontier = levels[-1].where((F.col("kind") == "dir") & F.col("pruned").isNull() & ~F.col("path").isin(clean)).select("path", "root")
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    name = paths.base_name(F.col("path"))
    files = every.where("kind not in ('dir', 'problem')").select(
        "id", "path", name.alias("name"), paths.extension(name).alias("ext"), "rel", number.alias("root_ord"), "kind", "size", "mtime_ns", "volume_id", "file_index",
        F.lit(True).alias("resolved"), (F.coalesce("blocks", F.lit(0)) * 512).alias("actual"), F.col("blocks").isNotNull().alias("actual_known"), F.lit(0).alias("flags"),
    )
    return Listing(files, every.where("kind = 'problem'").select("path", F.col("problem").alias("reason")), every.where("pruned is not null").select("path", F.col("pruned").alias("reason")), listed)


def lay_out(files: DataFrame, folder: str) -> int:
    """Write ``files(path, content)`` below ``folder``, which all machines mount; how many there are. A task that runs again writes the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                target = folder + path
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as out:
                    out.write(memoryview(content.as_buffer()) if content.is_valid else b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    conf = files.sparkSession.conf
    before = {key: conf.get(key) for key in _BOUNDS}
    try:
        for key, value in _BOUNDS.items():
            conf.set(key, value)
        return files.select("path", "content").mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    finally:
        for key, value in before.items():
            conf.set(key, value)
