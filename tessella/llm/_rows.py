"""Rows of a table by their place, so that a stage can drop some without regard to ids that repeat or are null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import _sketch
from tessella.llm._cluster import bound_batches, cut


def placed(docs: DataFrame) -> DataFrame:
    """``row, file, at``: each row of ``docs`` as a struct, and its place, which is the same whenever it is read.

    The place of a row of a table that is read from files is its file's hashed
    path and its number there; any other table is written first.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    try:
        return docs.select(row, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        return cut(docs.select(row, F.lit(0).cast("bigint").alias("file"), F.monotonically_increasing_id().alias("at")), "placed")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows behind ``rows``, a table of ``placed``, but for those in ``gone(file, at)``.

    A Bloom filter of fixed size lets rows that can't be meant pass without a
    shuffle; only the others meet ``gone`` in a join. If ``gone`` fills the
    filter, more rows do.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    key = F.xxhash64("file", "at")
    bits = spark.sparkContext.broadcast(_sketch.bloom(gone.select(key.alias("k"))))

    @F.pandas_udf("boolean")
    def may_hold(keys: pd.Series) -> pd.Series:
        return pd.Series(_sketch.may_hold(bits.value, keys.to_numpy().astype(np.int64).view(np.uint64)))

    marked = rows.withColumn("may", may_hold(key))
    clear = marked.where(~F.col("may")).select("row.*")
    return clear.unionByName(marked.where("may").join(gone.distinct(), ["file", "at"], "left_anti").select("row.*"))
