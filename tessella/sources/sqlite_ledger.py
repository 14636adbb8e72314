"""A ledger in an SQLite file as tables: each read in tasks, by ranges of row ids, from a file that all machines mount."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.sources.tree import LEDGER, checked_ledger

#: Row ids of a range.
RANGE_ROWS = 100_000
#: Rows that a task hands on at a time.
_BATCH = 5_000
_KINDS = {"INTEGER": ("bigint", pa.int64()), "BIGINT": ("bigint", pa.int64()), "INT": ("bigint", pa.int64()), "BOOLEAN": ("bigint", pa.int64()), "BLOB": ("binary", pa.binary()), "REAL": ("double", pa.float64())}


def _open(path: str) -> sqlite3.Connection:
    """Read only; a foreign file is never changed."""
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _value(x: object, kind: str) -> object:
    """A value as its column's declared kind says; SQLite holds anything in any column."""
    if x is None:
        return None
    if kind == "binary":
        return x if isinstance(x, bytes) else str(x).encode()
    if kind == "string":
        return x.decode(errors="replace") if isinstance(x, bytes) else str(x)
    try:
        return int(x) if kind == "bigint" else float(x)
    except (TypeError, ValueError):
        return None


def read_ledger(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five tables of the ledger at ``path``; ValueError names what it lacks, or that it is no database.

    Columns have the kinds that the file declares; a value that isn't of its
    column's kind is null. ``undoable`` and ``paranoid`` become booleans.
    """
    try:
        with _open(path) as db:
            there = {name: {row[1]: str(row[2]).upper() for row in db.execute(f"PRAGMA table_info({name})")} for name in LEDGER}
            tops = {name: db.execute(f"SELECT min(rowid), max(rowid) FROM {name}").fetchone() for name in LEDGER if there[name]}
    except sqlite3.DatabaseError as x:
        raise ValueError(f"{path} is no ledger: {x}") from x
    lacks = [f"{name}.{c}" for name, columns in LEDGER.items() for c in columns if c not in there[name]]
    if lacks:
        raise ValueError("not a ledger: no " + ", ".join(lacks))
    tables = {}
    for name, columns in LEDGER.items():
        kinds = [_KINDS.get(there[name][c].split("(")[0].strip(), ("string", pa.string())) for c in columns]
        tables[name] = _read(spark, path, name, columns, kinds, tops[name])
        for flag in ("undoable", "paranoid"):
            if flag in columns:
                tables[name] = tables[name].withColumn(flag, tables[name][flag].cast("boolean"))
    return dict(checked_ledger(tables))


def _read(spark: SparkSession, path: str, name: str, columns: tuple, kinds: list, top: tuple) -> DataFrame:
    listed, types = ", ".join(f'"{c}"' for c in columns), [t for _, t in kinds]
    schema = ", ".join(f"{c} {k}" for c, (k, _) in zip(columns, kinds, strict=True))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in batch.column(0).to_pylist():
                with _open(path) as db:
                    found = db.execute(f"SELECT {listed} FROM {name} WHERE rowid >= ? AND rowid < ?", (lo, lo + RANGE_ROWS))
                    while rows := found.fetchmany(_BATCH):
                        values = zip(*([_value(x, k) for x, (k, _) in zip(r, kinds, strict=True)] for r in rows), strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], list(columns))

    if top[0] is None:
        return spark.createDataFrame([], schema)
    n = (top[1] - top[0]) // RANGE_ROWS + 1
    return spark.range(top[0], top[1] + 1, RANGE_ROWS, min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(one, schema)
