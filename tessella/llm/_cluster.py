"""Where intermediate tables live and how lineage is cut.

Driver and executors share only ``spark.checkpoint.dir``. Every intermediate
table is written there as Parquet and read back, so that a lost executor costs
one task's work and never a recomputation of the whole chain.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.scratch import session_folder, shared_folder

#: Rows that go to a Python worker at a time. Texts can be long, so it is well below Spark's default of 10,000.
BATCH_ROWS = 500
#: Bytes of such a batch, after which it is closed.
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds: Arrow batches of this session have ``BATCH_ROWS`` rows or about ``BATCH_BYTES`` at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(key, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/tessella/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, slim: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan starts anew.

    What isn't removed before lies there until ``tessella.sources.scratch.clear``.

    ``slim``: rows are few and short, so one file for each core will do.
    """
    spark = df.sparkSession
    path = f"{session_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"
    (df.coalesce(spark.sparkContext.defaultParallelism) if slim else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete the files behind tables that ``cut`` made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over: they go when the driver collects what refers to them, so its garbage is collected now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
