"""Token ids in fixed-width bit-packed files (operator 10).

Ids are stored in the fewest bits that hold the vocabulary. A file has, all
little-endian:

* 8 bytes ``TOKBITS1``; unsigned 32-bit: bits per id, ids per block; unsigned
  64-bit: number of documents ``d``, of ids ``n``, of blocks ``b``
* ``d`` signed 64-bit document ids, ``d`` bytes that are 1 where an id is null
* ``d + 1`` unsigned 64-bit places: the first id of each document, and ``n``
* ``b + 1`` unsigned 64-bit byte offsets of the blocks, counted from the first
* the blocks: the lowest bit first, each padded to whole bytes

Blocks have as many ids each, so any run of ids is read from a few of them.
Files are in ascending document order, each written by one task within a
bounded buffer under a name of its own; a manifest lists those that count, so
a task that runs twice does no harm.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm._cluster import bound_batches, cut, scratch
from tessella.llm._tokens import encoder, pieces_of

MAGIC = b"TOKBITS1"
#: Ids in a block, a multiple of 8 so that every full block is whole bytes.
BLOCK_IDS = 1 << 14
#: Ids after which a task starts another file.
FILE_IDS = 1 << 22
_HEAD = struct.Struct("<8sIIQQQ")


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    lanes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(lanes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    lanes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits).astype(np.uint32)
    return (lanes << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def to_file(docs: list[int | None], texts: list[bytes], bits: int, block: int = BLOCK_IDS) -> bytes:
    """A whole file of documents' ids, given as little-endian unsigned 32-bit bytes."""
    ids = np.frombuffer(b"".join(texts), "<u4")
    starts = np.concatenate([[0], np.cumsum([len(t) // 4 for t in texts])]).astype("<u8")
    blocks = [pack_bits(ids[k : k + block], bits) for k in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    names = np.asarray([d or 0 for d in docs], "<i8").tobytes() + np.asarray([d is None for d in docs], np.uint8).tobytes()
    return _HEAD.pack(MAGIC, bits, block, len(docs), len(ids), len(blocks)) + names + starts.tobytes() + offsets.tobytes() + b"".join(blocks)


class TokenFile:
    """Random access to the ids in a file's bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.bits, self.block, d, self.n_ids, b = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        null = np.frombuffer(data, np.uint8, d, at + 8 * d)
        self.docs = [None if gone else x for x, gone in zip(np.frombuffer(data, "<i8", d, at).tolist(), null.tolist(), strict=True)]
        self.starts = np.frombuffer(data, "<u8", d + 1, at + 9 * d).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", b + 1, at + 9 * d + 8 * (d + 1)).astype(np.int64)
        self.base = at + 9 * d + 8 * (d + 1) + 8 * (b + 1)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi``, of which only the blocks that hold them are unpacked."""
        if lo >= hi:
            return np.zeros(0, "<u4")
        first, last = lo // self.block, (hi - 1) // self.block
        data = self.data[self.base + int(self.offsets[first]) : self.base + int(self.offsets[last + 1])]
        if self.bits % 8 == 0 or self.block % 8 == 0:
            n = min(self.n_ids, (last + 1) * self.block) - first * self.block
            return unpack_bits(data, self.bits, n)[lo - first * self.block : hi - first * self.block]
        parts = [unpack_bits(self.data[self.base + int(self.offsets[k]) : self.base + int(self.offsets[k + 1])], self.bits, min(self.n_ids - k * self.block, self.block)) for k in range(first, last + 1)]
        return np.concatenate(parts)[lo - first * self.block : hi - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_files(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 2, file_ids: int = FILE_IDS,
) -> tuple[str, DataFrame]:
    """Encode ``docs`` into files in the shared folder; the folder, and the manifest ``file, n_docs, n_ids, base``.

    Documents are in ascending ``id_col`` order, null ids first, rows with the
    same id by their text. Null texts are empty. Each document ends with
    ``end_id``. ``base``: ids in all files before. An empty table makes no file.
    """
    bound_batches(docs.sparkSession)
    folder = scratch(docs.sparkSession, "tokens")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        code = encoder(tokenizer)
        bits = max(1, max(code.size - 1, end_id).bit_length())
        tail = np.asarray([end_id], "<u4").tobytes()
        docs: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def write() -> pa.RecordBatch:
            system, at = fs.FileSystem.from_uri(folder)
            system.create_dir(at, recursive=True)
            name = f"{uuid.uuid4().hex}.tok"
            with system.open_output_stream(f"{at}/{name}") as out:
                out.write(to_file(docs, texts, bits))
            row = [[name], [len(docs)], [sum(map(len, texts)) // 4], [docs[0]], [docs[-1]]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["file", "n_docs", "n_ids", "first", "last"])

        number = 0
        for batch in batches:
            for first, part in pieces_of(batch.column(1)):
                for r, ids in enumerate(code.encode(part)):
                    docs.append(batch.column(0)[first + r].as_py())
                    texts.append(ids + tail)
                    held += len(ids) // 4 + 1
                    if held >= file_ids:
                        yield write().append_column("number", pa.array([number], pa.int32()))
                        docs, texts, held, number = [], [], 0, number + 1
        if docs:
            yield write().append_column("number", pa.array([number], pa.int32()))

    ordered = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text).alias("text")).repartitionByRange(F.col("doc").asc_nulls_first()).sortWithinPartitions(F.col("doc").asc_nulls_first(), "text")
    made = cut(ordered.mapInArrow(one, "file string, n_docs bigint, n_ids bigint, first bigint, last bigint, number int"), "token-manifest")
    before = Window.orderBy(F.col("first").asc_nulls_first(), F.col("last").asc_nulls_first(), "number").rowsBetween(Window.unboundedPreceding, -1)
    return folder, made.select("file", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files that ``manifest`` lists."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                found, base = TokenFile(batch.column(1)[r].as_py()), batch.column(0)[r].as_py()
                for k in range(0, len(found.docs), 256):
                    end = min(len(found.docs), k + 256)
                    ids = [found.document(i).tobytes() for i in range(k, end)] if found.bits % 8 else _whole(found, k, end)
                    yield pa.RecordBatch.from_arrays([pa.array(found.docs[k:end], pa.int64()), pa.array(base + found.starts[k:end]), pa.array(np.diff(found.starts[k : end + 1])), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids binary")
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(manifest.select("file", "base"), "file").select("base", "content").mapInArrow(one, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_range(spark: SparkSession, folder: str, manifest: DataFrame, lo: int, hi: int) -> DataFrame:
    """``start, ids`` of ids ``lo`` to ``hi`` of all files in order, in pieces of a block at most; only the blocks that hold them are unpacked."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = TokenFile(data.as_buffer())
                first, last = max(0, lo - base), min(found.n_ids, hi - base)
                edges = [first, *range(first // found.block * found.block + found.block, last, found.block), last]
                pieces = [(base + a, found.ids(a, b).tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]
                if pieces:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pieces], pa.int64()), pa.array([x for _, x in pieces], pa.binary())], ["start", "ids"])

    wanted = manifest.where((F.col("base") < hi) & (F.col("base") + F.col("n_ids") > lo))
    names = [f"{folder}/{r['file']}" for r in wanted.select("file").collect()]  # files of millions of ids each
    if not names:
        return spark.createDataFrame([], "start bigint, ids binary")
    files = spark.read.format("binaryFile").load(names).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(wanted.select("file", "base"), "file").select("base", "content").mapInArrow(one, "start bigint, ids binary")


def _whole(found: TokenFile, k: int, end: int) -> list[bytes]:
    """Documents ``k`` to ``end`` from one unpacking."""
    base = int(found.starts[k])
    ids = found.ids(base, int(found.starts[end]))
    return [ids[int(a) - base : int(b) - base].tobytes() for a, b in zip(found.starts[k:end], found.starts[k + 1 : end + 1], strict=True)]
