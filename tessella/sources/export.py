"""A ledger as an export: all five tables as nested documents, and a manifest that is written last.

A scan's document lists its groups, a group's its files, an operation's its
items; long lists are cut into parts of bounded size. The manifest holds a count
and a digest of each table that doesn't depend on any order. A reader computes
both from what it reads and refuses an export that doesn't add up.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.rank import parts_for
from tessella.sources.scratch import stage
from tessella.sources.tree import LEDGER, checked_ledger

#: Children that a document lists, about.
PART_ROWS = 10_000
#: Parents, their children and by which column those name them.
_NESTED = (("scan_history", "hist_groups", "hist_id"), ("hist_groups", "hist_files", "group_id"), ("op_records", "op_items", "op_id"))


class Torn(ValueError):
    """An export whose tables aren't what its manifest says."""


def _numbered(children: DataFrame, key: str, order: str, part_rows: int) -> DataFrame:
    """Children with the ``part`` of their key's list; only keys with more than a part are sent to them, at most one for each ``part_rows`` rows."""
    long = children.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > part_rows)
    part = F.pmod(F.xxhash64(order), F.ceil(F.col("_n") / part_rows)).cast("int")
    return children.join(F.broadcast(long), key, "left").withColumn("part", F.coalesce(part, F.lit(0)))


def parted(children: DataFrame, key: str, order: str, part_rows: int = PART_ROWS) -> DataFrame:
    """``<key>, part, rows``: the children of each key in lists of ``part_rows`` or so, each in order."""
    held = _numbered(children, key, order, part_rows)
    rest = [order, *[c for c in children.columns if c not in (key, order)]]
    return held.groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows"))


def _documents(tables: dict[str, DataFrame], part_rows: int) -> DataFrame:
    """``kind, json``: a document for each parent and part of its children; children without a parent have one without its row."""
    out = None
    for parent, child, key in _NESTED:
        own = [c for c in LEDGER[parent] if parent != "hist_groups"] or ["id"]  # a group's own row is in its scan's list
        held = _numbered(tables[child].select(*LEDGER[child]), key, "id", part_rows)
        rest = ["id", *[c for c in LEDGER[child] if c not in (key, "id")]]
        heads = tables[parent].select(F.col("id").alias("_key"), F.lit(0).alias("part"), F.struct(*own).alias("row"))
        lines = held.select(F.col(key).alias("_key"), "part", F.struct(*rest).alias("child"))
        both = heads.unionByName(lines, allowMissingColumns=True)
        dealt = both.repartition(parts_for(both, tables[child].count() + tables[parent].count()), "_key", "part")
        both = dealt.groupBy("_key", "part").agg(F.first("row", ignorenulls=True).alias("row"), F.sort_array(F.collect_list("child")).alias("rows"))
        both = both.withColumn("rows", F.when(F.size("rows") > 0, F.col("rows")))
        docs = both.select(F.lit(parent).alias("kind"), F.to_json(F.struct(F.col("_key").alias("key"), "row", "rows")).alias("json"))
        out = docs if out is None else out.unionByName(docs)
    return out


def figures(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """Count and digest of each table."""
    found = {}
    for name, columns in LEDGER.items():
        own = F.sha2(F.to_json(F.struct(*columns)), 256)
        bits = F.conv(F.substring(own, 1, 15), 16, 10).cast("decimal(38,0)")
        r = tables[name].agg(F.count("*").alias("n"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("digest")).first()
        found[name] = {"rows": r["n"], "digest": r["digest"]}
    return found


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def write_export(tables: dict[str, DataFrame], folder: str, part_rows: int = PART_ROWS, compression: str = "none") -> dict[str, dict]:
    """Export a ledger to a new folder; its figures. Until the manifest is there, which comes last and at once, there is no export.

    ``compression``: of the documents' files, ``gzip`` or another that Spark's text files know.
    """
    checked_ledger(tables)
    spark = tables["scan_history"].sparkSession
    manifest, fs = _path(spark, f"{folder}/manifest.json")
    if fs.exists(manifest):
        raise FileExistsError(f"{folder} holds an export")
    data = f"data-{uuid.uuid4().hex}"
    _documents(tables, part_rows).write.partitionBy("kind").option("compression", compression).text(f"{folder}/{data}")
    found = figures(tables)
    kinds = {name: {c: tables[name].schema[c].dataType.simpleString() for c in columns} for name, columns in LEDGER.items()}
    part, _ = _path(spark, f"{folder}/manifest.json.part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps({"data": data, "columns": kinds, "figures": found}).encode()))
    out.close()
    fs.rename(part, manifest)
    return found


def read_export(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five tables of an export, read once and written; ``Torn`` if there is no manifest or a table isn't what it says."""
    manifest, fs = _path(spark, f"{folder}/manifest.json")
    if not fs.exists(manifest):
        raise Torn(f"{folder} holds no whole export")
    told = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()["value"])
    docs = spark.read.schema("value string, kind string").text(f"{folder}/{told['data']}")
    ddl = lambda name, less=(): ", ".join(f"`{c}`: {k}" for c, k in told["columns"][name].items() if c not in less)
    tables = {}
    for parent, child, key in _NESTED:
        row = "struct<id: bigint>" if parent == "hist_groups" else f"struct<{ddl(parent)}>"
        doc = F.from_json("value", f"struct<key: bigint, row: {row}, rows: array<struct<{ddl(child, (key,))}>>>")
        mine = docs.where(F.col("kind") == parent).select(doc.alias("d"))
        if parent != "hist_groups":
            tables[parent] = stage(mine.where("d.row is not null").select("d.row.*"), "export-read")
        held = mine.select(F.col("d.key").alias(key), F.explode("d.rows").alias("r")).select(key, "r.*")
        tables[child] = stage(held.select(*LEDGER[child]), "export-read")
    found = figures(tables)
    wrong = [name for name in LEDGER if found[name] != told["figures"][name]]
    if wrong:
        raise Torn(f"{folder}: not what the manifest says: {', '.join(wrong)}")
    return tables
