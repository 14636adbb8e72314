"""Packing (operator 6): bounded-space online best fit.

Each task keeps a fixed number of open windows. A document's full windows go
out at once; its last piece goes to the open window it leaves least room in.
When none fits, the fullest open window is emitted and a new one is opened.
The windows still open at a task's end are merged: the pieces of neighbouring
tasks are placed anew, largest first, by best fit. Memory is bounded by the
number of open windows; nothing is sorted or shuffled but those leftovers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._cluster import bound_batches, cut
from tessella.llm._tokens import MEMORY_PIECES, encoder, pieces_of

#: Windows that a task keeps open.
OPEN_WINDOWS = 128
#: Tasks whose leftovers are merged together.
MERGED_TASKS = 32
_MERGED = 1 << 62


class BestFit:
    """Open windows by room left; ``place`` returns the windows that it closes."""

    def __init__(self, size: int, most: int | None):
        self.size, self.most, self.open, self.made = size, most, [], 0

    def place(self, length: int) -> tuple[int, int, list[int]]:
        """``window, offset, windows closed`` for a piece."""
        closed = []
        k = bisect_left(self.open, (length, -1))
        if k < len(self.open):
            room, window = self.open.pop(k)
        else:
            if self.most is not None and len(self.open) >= self.most:
                closed.append(self.open.pop(0)[1])
            room, window = self.size, self.made
            self.made += 1
        if room > length:
            insort(self.open, (room - length, window))
        else:
            closed.append(window)
        return window, self.size - room, closed


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1, open_windows: int =
    OPEN_WINDOWS, remembered: int = MEMORY_PIECES,
) -> DataFrame:
    """``<id_col>, start, length, doc_tokens, sequence_id, offset, ids``: a row per piece of a document.

    A document is its ids by the tokenizer file, then ``end_id``. ``ids``: the
    piece's ids as little-endian unsigned 32-bit bytes; ``start``: ids of its
    document before it; ``offset``: ids of its sequence before it, without a
    gap. A sequence holds ``size`` ids at most and is padded to that, unless
    its length is a power of two, which is a shape of its own.

    Null and empty texts are documents of one id. Null and repeated ids keep
    their rows: a row is a document. Very long texts are cut into full windows.
    An empty table gives no rows. Other columns are not read. ``remembered``:
    words whose ids a worker keeps, some 200 bytes each; the rest is encoded anew.
    """
    bound_batches(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType
    longs = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("ids", T.BinaryType()), T.StructField("task", T.LongType()), T.StructField("done", T.BooleanType())])
    tail = np.asarray([end_id], "<u4").tobytes()

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task = encoder(tokenizer, remembered), TaskContext.get().partitionId()
        fit = BestFit(size, open_windows)
        held: dict[int, list[tuple]] = {}
        arrow_kind = None

        def rows(pieces: list[tuple], done: bool) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True))
            data = [pa.array(cols[0], arrow_kind), *(pa.array(c, pa.int64()) for c in cols[1:6]), pa.array(cols[6], pa.binary()), pa.array([task] * len(pieces), pa.int64()), pa.array([done] * len(pieces))]
            return pa.RecordBatch.from_arrays(data, schema.names)

        for batch in batches:
            arrow_kind = batch.column(0).type
            for first, texts in pieces_of(batch.column(1)):
                out = []
                for r, ids in enumerate(code.encode(texts)):
                    doc, ids = batch.column(0)[first + r].as_py(), ids + tail
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        length = min(size, n - start)
                        window, offset, closed = (fit.made, 0, [fit.made]) if length == size else fit.place(length)
                        if length == size:
                            fit.made += 1
                        held.setdefault(window, []).append((doc, start, length, n, (task << 32) + window, offset, ids[4 * start : 4 * (start + length)]))
                        for w in closed:
                            out += held.pop(w)
                if out:
                    yield rows(out, True)
        if held:
            yield rows([p for w in sorted(held) for p in held[w]], False)

    placed = cut(docs.select(id_col, text).mapInArrow(one, schema), "packed")

    def merge(left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["length", "task", "sequence_id", "offset"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        fit, base = BestFit(size, None), _MERGED + (int(left["task"].iloc[0]) // MERGED_TASKS << 32)
        spots = [fit.place(n)[:2] for n in left["length"].tolist()]
        left["sequence_id"] = [base + w for w, _ in spots]
        left["offset"] = [o for _, o in spots]
        return left

    merged = placed.where("not done").groupBy((F.col("task") / MERGED_TASKS).cast("bigint")).applyInPandas(merge, schema)
    return placed.where("done").unionByName(merged).drop("task", "done")
