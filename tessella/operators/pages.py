"""Sorted results in files by ranges of their order, so that a page is read from the one or two files that hold it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.policy import PAGE_DEFAULT, PAGE_MOST, SORTS

#: Rows of a file, about.
FILE_ROWS = 100_000
_ROW_BITS = 33


class PageStore:
    """Pages of ``groups`` by one sort, all descending, ties to the smaller group number.

    ``starts``: the rank of the first row of each file; a number for each file is
    all that the driver holds.
    """

    def __init__(self, spark: SparkSession, folder: str, starts: list[int], rows: int, schema):
        self.spark, self.folder, self.starts, self.rows, self.schema = spark, folder, starts, rows, schema

    @classmethod
    def write(cls, groups: DataFrame, folder: str, sort: str = "reclaimable", file_rows: int = FILE_ROWS) -> PageStore:
        spark = groups.sparkSession
        order = [F.col(SORTS.get(sort, "reclaimable")).desc(), F.col("group_id")]
        dealt = groups.repartitionByRange(max(1, -(-groups.count() // file_rows)), *order).sortWithinPartitions(*order)
        at = F.monotonically_increasing_id()
        placed = dealt.withColumn("_file", F.shiftright(at, _ROW_BITS)).withColumn("_at", at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        data = f"{folder}/{sort}-{uuid.uuid4().hex}"
        placed.write.partitionBy("_file").parquet(data)
        sizes = {r["_file"]: r["n"] for r in spark.read.parquet(data).groupBy("_file").agg(F.count("*").alias("n")).collect()} if groups.take(1) else {}
        starts, rows = [], 0
        for k in range(max(sizes, default=-1) + 1):
            starts.append(rows)
            rows += sizes.get(k, 0)
        return cls(spark, data, starts, rows, groups.schema)

    def manifest(self) -> str:
        return json.dumps({"folder": self.folder, "starts": self.starts, "rows": self.rows, "schema": self.schema.json()})

    @classmethod
    def opened(cls, spark: SparkSession, manifest: str) -> PageStore:
        from pyspark.sql.types import StructType

        x = json.loads(manifest)
        return cls(spark, x["folder"], x["starts"], x["rows"], StructType.fromJson(json.loads(x["schema"])))

    def page(self, number: int = 0, size: int = PAGE_DEFAULT) -> DataFrame:
        """A page in order. Sizes are clamped to 1..500, numbers to 0 and above; past the end it is empty."""
        size = PAGE_DEFAULT if size <= 0 else min(size, PAGE_MOST)
        lo = max(0, number) * size
        hi = min(lo + size, self.rows)
        ends = [*self.starts[1:], self.rows]
        found = None
        for k, (first, end) in enumerate(zip(self.starts, ends, strict=False)):
            if first < hi and end > lo and end > first:
                rows = self.spark.read.parquet(f"{self.folder}/_file={k}").where(F.col("_at").between(lo - first, hi - first - 1)).withColumn("_rank", F.col("_at") + first)
                found = rows if found is None else found.unionByName(rows)
        if found is None:
            return self.spark.createDataFrame([], self.schema)
        return found.orderBy("_rank").select(*self.schema.names)
