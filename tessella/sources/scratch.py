"""Tables between stages: written to the folder that all machines share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tessella-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def session_folder(spark: SparkSession) -> str:
    """Where this application's tables between stages lie."""
    return f"{shared_folder(spark)}/tessella-stages/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, so that what follows may read it more than once and a lost executor costs a task."""
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in tables:
        drop_folder(df.sparkSession, df._staged)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has staged: when its results have been read."""
    drop_folder(spark, session_folder(spark))


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one as a plain path; ValueError if that isn't mounted."""
    shared = shared_folder(spark)
    if not shared.startswith(("file:/", "/")):
        raise ValueError(f"{shared} isn't a mounted folder")
    path = "/" + shared.removeprefix("file:").lstrip("/")
    return f"{path}/tessella-trees/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder and all below it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path if ":" in path else f"file://{path}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
