"""Contents of files, read no further than needed: samples of some, hashes of fewer.

``InTable`` has them in a column and finds rows by id, ``OnDisk`` reads ranges of
files by path, on folders that all machines mount. Both are asked for rows that
are still candidates; nothing else is read. What can't be read, or isn't as long
as was declared, comes back with a ``problem`` in place of a hash.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import treehash

#: Bytes of a sample and the size up to which a file is hashed as a whole at once (production values).
CHUNK, SMALL = 65536, 131072
SAMPLES = ("head", "mid1", "mid2", "tail")
#: Larger files are hashed by BLAKE3 in ranges of so many bytes, each a task's work; others by SHA-256. Equal sizes are hashed alike.
RANGE = 1 << 26
#: Bytes that a task reads at a time.
_PIECE = 1 << 22
#: Spark's seed of ``xxhash64``, so that samples from files and from tables are the same numbers.
_SEED = 42
#: Bits of the filter by which rows of a table are found (2 MB, whatever the input).
_FILTER_BITS = 1 << 24
_SAMPLE_SCHEMA = "head bigint, mid1 bigint, mid2 bigint, tail bigint, length bigint, hash string, problem string, read_bytes bigint"


def sample_hashes(content: Column, size: Column, chunk: int = CHUNK, small: int = SMALL) -> dict[str, Column]:
    """``head, mid1, mid2, tail``: hashes of four samples; a small file's hash is in all four."""
    last = F.greatest(size - chunk, F.lit(0))
    at = {"head": F.lit(0), "mid1": F.least(F.floor(size / 2), last), "mid2": F.least(F.floor(size * 3 / 4), last), "tail": last}
    return {name: F.when(size <= small, F.xxhash64(content)).otherwise(F.xxhash64(F.substring(content, (o + 1).cast("int"), chunk))) for name, o in at.items()}


def may_be_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``id`` isn't in ``ids``: a bitmap of hashed ids is broadcast, so no row is shuffled for it."""
    bit = lambda: F.pmod(F.xxhash64("id"), F.lit(_FILTER_BITS)) + 1
    bits = ids.select(bit().alias("_b")).groupBy(F.bitmap_bucket_number("_b").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_b")).alias("_bits"))
    held = F.conv(F.hex(F.substring("_bits", (F.expr("_at div 8") + 1).cast("int"), 1)), 16, 10).cast("int")
    marked = rows.withColumn("_b", bit()).withColumn("_bucket", F.bitmap_bucket_number("_b")).withColumn("_at", F.bitmap_bit_position("_b"))
    met = marked.join(F.broadcast(bits), "_bucket").where(F.getbit(held, F.pmod(F.col("_at"), F.lit(8)).cast("int")) == 1)
    return met.select(*rows.columns)


class InTable:
    """Contents in a column of ``files(id, content)``."""

    def __init__(self, files: DataFrame):
        self.files = files.select("id", "content")

    def _of(self, rows: DataFrame) -> DataFrame:
        return may_be_in(self.files, rows.select("id"))

    def samples(self, rows: DataFrame, chunk: int = CHUNK, small: int = SMALL) -> DataFrame:
        """``rows`` with samples, ``length``, ``hash`` (of small files from disk only), ``problem`` and ``read_bytes``."""
        size = F.octet_length("content").cast("bigint")
        taken = self._of(rows).select("id", *[c.alias(n) for n, c in sample_hashes(F.col("content"), size, chunk, small).items()], size.alias("length"))
        read = F.coalesce(F.when(F.col("length") <= small, F.col("length")).otherwise(4 * chunk), F.lit(0)).cast("bigint")
        problem = F.when(F.col("length").isNull(), "unreadable").when(F.col("size") < 0, "negative").when(F.col("length") > F.col("size"), "grown")
        return rows.join(taken, "id", "left").withColumns({"hash": F.lit(None).cast("string"), "problem": problem, "read_bytes": read})

    def hashes(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``hash``, ``problem`` and ``read_bytes``."""
        taken = self._of(rows).select("id", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("bigint").alias("read_bytes"))
        return rows.join(taken, "id", "left").withColumn("problem", F.when(F.col("hash").isNull(), "unreadable"))

    def proofs(self, rows: DataFrame, at: Column, n: Column) -> DataFrame:
        """``rows`` with ``proof``, a digest of ``n`` bytes from ``at`` on, ``problem`` and ``read_bytes``."""
        part = F.substring("content", (F.col("_at") + 1).cast("int"), F.col("_n").cast("int"))
        asked = rows.withColumns({"_at": at, "_n": n})
        taken = self._of(rows).join(asked.select("id", "_at", "_n"), "id").select("id", F.sha2(part, 512).alias("proof"), F.octet_length(part).cast("bigint").alias("read_bytes"))
        out = rows.join(taken, "id", "left")
        return out.withColumn("problem", F.when(F.col("proof").isNull(), "unreadable"))


def read_at(handle: int, at: int, n: int) -> bytes:
    """Up to ``n`` bytes from ``at`` on; fewer only at the end of the file."""
    parts = []
    while n > 0 and (got := os.pread(handle, n, at)):
        parts.append(got)
        at, n = at + len(got), n - len(got)
    return b"".join(parts)


def offsets(size: int, chunk: int) -> list[int]:
    """Where the four samples of a file start, in ascending order."""
    last = max(0, size - chunk)
    return [0, min(size // 2, last), min(size * 3 // 4, last), last]


def length_of(size: int, starts: list[int], reads: list[int], chunk: int) -> int:
    """What a file's length can be at most, from what its samples gave: the least end of one that isn't full, but no less than the first proves."""
    ends = [s + n for s, n in zip(starts, reads, strict=True) if n < chunk]
    return max(min(ends), chunk if reads[0] == chunk else 0) if ends else size


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def take_samples(path: str, size: int, chunk: int, small: int, whole: int) -> tuple:
    """A row of ``_SAMPLE_SCHEMA`` from one opened file."""
    if size < 0:
        return (None, None, None, None, None, None, "negative", 0)
    try:
        handle = os.open(path, os.O_RDONLY)
    except (OSError, ValueError) as e:
        return (None, None, None, None, None, None, type(e).__name__, 0)
    try:
        read = 0
        if size <= small:
            data = read_at(handle, 0, size)
            parts, length, full = [data] * 4, len(data), hashlib.sha256(data).hexdigest() if len(data) <= whole else None
            read = len(data)
        else:
            starts = offsets(size, chunk)
            parts, full = [read_at(handle, at, chunk) for at in starts], None
            read = sum(map(len, parts))
            length = length_of(size, starts, [len(p) for p in parts], chunk)
        if os.pread(handle, 1, size):
            return (None, None, None, None, None, None, "grown", read)
        return (*(_signed(xxhash.xxh64_intdigest(p, _SEED)) for p in parts), length, full, None, read)
    except OSError as e:
        return (None, None, None, None, None, None, type(e).__name__, 0)
    finally:
        os.close(handle)


def hash_ranges(asked: Iterable[tuple[str, int, int, int]], whole: int) -> list[tuple[list[dict] | None, str | None, int]]:
    """For each ``(path, size, at, n)`` nodes of that range (or one with the hash, if the file isn't over ``whole`` bytes), a problem, and the bytes read.

    Ranges of large files are hashed together, ``_PIECE`` bytes or so at a time.
    """
    out, waiting, held = [], [], 0

    def close() -> None:
        for (nodes, *_), found in zip(waiting, treehash.ranges_nodes([w[1:] for w in waiting]), strict=True):
            nodes += found
        waiting.clear()

    for path, size, at, n in asked:
        nodes: list[treehash.Node] = []
        problem, read = None, 0
        total, running = treehash.chunks_of(size), hashlib.sha256()
        try:
            handle = os.open(path, os.O_RDONLY)
        except (OSError, ValueError) as e:
            out.append((nodes, type(e).__name__, 0))
            continue
        try:
            for k in range(at, at + n, _PIECE):
                data = read_at(handle, k, min(_PIECE, at + n - k))
                read += len(data)
                if len(data) < min(_PIECE, at + n - k):
                    problem = "short"
                    break
                if size <= whole:
                    running.update(data)
                    continue
                waiting.append((nodes, data, k // treehash.CHUNK, total))
                held += len(data)
                if held >= _PIECE:
                    close()
                    held = 0
            if problem is None and at + n >= size and os.pread(handle, 1, size):
                problem = "grown"
        except OSError as e:
            problem = type(e).__name__
        finally:
            os.close(handle)
        if size <= whole:
            nodes.append((-1, 0, running.digest()))
        out.append((nodes, problem, read))
    close()
    return [(None if problem else [{"level": level, "index": index, "value": value} for level, index, value in nodes], problem, read) for nodes, problem, read in out]


def hash_range(path: str, size: int, at: int, n: int, whole: int) -> tuple[list[dict] | None, str | None, int]:
    """What ``hash_ranges`` has of one range."""
    return hash_ranges([(path, size, at, n)], whole)[0]


class OnDisk:
    """Contents of files at ``path``, read by ranges in tasks. ``range_bytes``: a multiple of ``_PIECE`` that one task hashes of a large file."""

    def __init__(self, range_bytes: int = RANGE):
        if range_bytes % treehash.CHUNK:
            raise ValueError("ranges end between chunks of 1 KiB")
        self.range_bytes = range_bytes

    @staticmethod
    def _dealt(rows: DataFrame) -> DataFrame:
        """Rows spread over all cores, whatever table they come from: reading waits for disks."""
        return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)

    def samples(self, rows: DataFrame, chunk: int = CHUNK, small: int = SMALL) -> DataFrame:
        """``rows`` with samples, the true ``length``, the ``hash`` of small files, ``problem`` and ``read_bytes``; each file is opened once."""
        whole = self.range_bytes

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [c.split()[0] for c in _SAMPLE_SCHEMA.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
            for batch in batches:
                taken = [take_samples(p, s, chunk, small, whole) for p, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                columns = list(zip(*taken, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", *names])

        taken = self._dealt(rows.select("id", "path", "size")).mapInArrow(one, f"id {_kind(rows, 'id')}, {_SAMPLE_SCHEMA}")
        return rows.join(taken, "id")

    def hashes(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``hash``, ``problem`` and ``read_bytes``; ranges of large files are hashed apart and put together."""
        step, whole = self.range_bytes, self.range_bytes
        work = rows.select("id", "path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(step).cast("bigint"))).alias("at"))
        work = work.withColumn("n", F.least(F.lit(step), F.col("size") - F.col("at")))
        kind = _kind(rows, "id")

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            node = pa.list_(pa.struct([("level", pa.int32()), ("index", pa.int64()), ("value", pa.binary())]))
            for batch in batches:
                if batch.num_rows:
                    nodes, problems, reads = zip(*hash_ranges(zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True), whole), strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, node), pa.array(problems, pa.string()), pa.array(reads, pa.int64())], ["id", "nodes", "problem", "read_bytes"])

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                files = [(size, [(n["level"], n["index"], n["value"]) for n in nodes or []], problem) for size, nodes, problem in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)]
                trees = iter(treehash.all_combined([(nodes, treehash.chunks_of(size)) for size, nodes, problem in files if not problem and size > whole]))
                found = [None if problem else (nodes[0][2] if size <= whole else next(trees)).hex() for size, nodes, problem in files]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), batch.column(3), batch.column(4)], ["id", "hash", "problem", "read_bytes"])

        ranges = self._dealt(work).mapInArrow(one, f"id {kind}, nodes array<struct<level: int, index: bigint, value: binary>>, problem string, read_bytes bigint")
        each = ranges.groupBy("id").agg(F.flatten(F.collect_list("nodes")).alias("nodes"), F.max("problem").alias("problem"), F.sum("read_bytes").alias("read_bytes"))
        each = each.join(rows.select("id", "size"), "id").select("id", "size", "nodes", "problem", "read_bytes")
        return rows.join(each.mapInArrow(join, f"id {kind}, hash string, problem string, read_bytes bigint"), "id")

    def proofs(self, rows: DataFrame, at: Column, n: Column) -> DataFrame:
        """``rows`` with ``proof``, a digest of ``n`` bytes from ``at`` on, ``problem`` and ``read_bytes``."""

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [prove(*x) for x in zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True)]
                proofs, problems, reads = list(zip(*out, strict=True)) or ([], [], [])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(proofs, pa.string()), pa.array(problems, pa.string()), pa.array(reads, pa.int64())], ["id", "proof", "problem", "read_bytes"])

        work = self._dealt(rows.select("id", "path", "size", at.alias("at"), n.alias("n")))
        return rows.join(work.mapInArrow(one, f"id {_kind(rows, 'id')}, proof string, problem string, read_bytes bigint"), "id")


def prove(path: str, size: int, at: int, n: int) -> tuple[str | None, str | None, int]:
    """A digest of ``n`` bytes from ``at`` on."""
    read = 0
    try:
        handle = os.open(path, os.O_RDONLY)
    except (OSError, ValueError) as e:
        return None, type(e).__name__, 0
    try:
        running = hashlib.sha512()
        for k in range(at, at + n, _PIECE):
            data = read_at(handle, k, min(_PIECE, at + n - k))
            read += len(data)
            if len(data) < min(_PIECE, at + n - k):
                return None, "short", read
            running.update(data)
        if at + n >= size and os.pread(handle, 1, size):
            return None, "grown", read
    except OSError as e:
        return None, type(e).__name__, read
    finally:
        os.close(handle)
    return running.hexdigest(), None, read


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()

