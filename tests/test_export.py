"""Exports that add up or are refused, and pages from the files that hold them."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import policy
from tessella.operators.pages import PageStore
from tessella.plans.action_queries import _ledgers
from tessella.sources import export
from tessella.sources.tree import LEDGER


def rows(df, name):
    return sorted(map(str, df.select(*LEDGER[name]).collect()))


def small(spark, sf):
    tables = dict(_ledgers(spark, sf)[1])
    keep = tables["op_items"].where("op_id < 300").withColumn("err", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise("a \"b\"\n{c}"))
    stray = keep.limit(1).withColumn("id", F.lit(-1).cast("bigint")).withColumn("op_id", F.lit(-7).cast("bigint"))
    tables["op_items"] = keep.unionByName(stray)
    return {n: export.stage(t, "small") for n, t in tables.items()}


def test_export_import_export(spark, sf, tmp_path):
    tables = small(spark, sf)
    first = export.write_export(tables, f"file://{tmp_path}/a", part_rows=2)
    back = export.read_export(spark, f"file://{tmp_path}/a")
    assert all(rows(back[n], n) == rows(tables[n], n) for n in LEDGER)
    assert export.write_export(back, f"file://{tmp_path}/b", part_rows=1000) == first
    longest = max(len(json.loads(r["value"]).get("rows", [])) for r in spark.read.text(f"file://{tmp_path}/a/data-*").collect())
    assert 2 <= longest < 12
    with pytest.raises(FileExistsError):
        export.write_export(tables, f"file://{tmp_path}/a")


def test_torn_exports_are_refused(spark, sf, tmp_path):
    export.write_export(small(spark, sf), f"file://{tmp_path}/a")
    parts = sorted((tmp_path / "a").glob("data-*/kind=op_records/part-*.txt"), key=lambda p: -p.stat().st_size)
    whole = parts[0].read_text()
    for broken in (whole.replace('"state":"done"', '"state":"undone"', 1), "".join(whole.splitlines(True)[1:]), whole + whole.splitlines(True)[0]):
        for crc in parts[0].parent.glob(".*.crc"):
            crc.unlink()
        parts[0].write_text(broken)
        with pytest.raises(export.Torn, match="op_"):
            export.read_export(spark, f"file://{tmp_path}/a")
    parts[0].write_text(whole)
    assert export.read_export(spark, f"file://{tmp_path}/a")["op_items"].count() > 0
    (tmp_path / "a/manifest.json").unlink()
    with pytest.raises(export.Torn, match="no whole export"):
        export.read_export(spark, f"file://{tmp_path}/a")


def test_a_page_is_read_from_its_file(spark, tmp_path):
    g = spark.range(1, 5001).select(F.col("id").alias("group_id"), (F.col("id") % 7).alias("n_files"), (F.col("id") * 31 % 997).alias("size"), (F.col("id") % 13).alias("reclaimable"))
    for sort in ("count", "reclaimable"):
        store = PageStore.opened(spark, PageStore.write(g, f"file://{tmp_path}/pages", sort, 400).manifest())
        assert store.rows == 5000 and len(store.starts) > 5
        for number, size in ((0, 10), (37, 100), (49, 100), (50, 100), (9, 500), (0, 0), (-3, 9999), (3, 399)):
            page = store.page(number, size)
            assert page.collect() == policy.page(g, sort, number, size).collect()
            assert len(page.inputFiles()) <= 3
        assert len(store.page(40, 10).inputFiles()) == 1
    empty = PageStore.write(g.limit(0), f"file://{tmp_path}/none")
    assert empty.page(0, 10).collect() == [] and empty.page(0, 10).schema == g.schema
