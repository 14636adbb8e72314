"""Texts, dumps and figures at sizes where they once took too long or failed."""

import time

import duckdb
from pyspark.sql import functions as F

from tessella.functions import formats
from tessella.plans.catalog import ORACLES, QUERIES


def test_text_is_judged_by_every_byte(spark):
    bad = [*range(9), 11, 12, *range(14, 32), 127]
    df = spark.range(256).select("id", F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("one"))
    found = {r["id"]: r["t"] for r in df.select("id", formats.likely_text(F.col("one")).alias("t")).collect()}
    assert [b for b, t in found.items() if not t] == bad
    edge = spark.createDataFrame([(b"a" * 17 + b"\0" * 3, False), (b"a" * 18 + b"\0" * 3, True), (b"", True), (b"\n\r\t\xff" * 5, True), (None, None)], "data binary, want boolean")
    assert all(r["t"] is r["want"] for r in edge.select("want", formats.likely_text(F.col("data")).alias("t")).collect())


def test_text_and_dump_take_time_in_proportion(spark):
    data = F.encode(F.repeat(F.concat(F.lit("café "), F.col("id").cast("string")), 1000), "UTF-8")
    df = spark.range(4000, numPartitions=4).select(F.substring(data, 1, formats.JUDGED).alias("data")).cache()
    df.count()
    start = time.time()
    assert df.where(formats.likely_text(F.col("data"))).count() == 4000
    assert df.select(F.explode(formats.hex_rows(F.substring("data", 1, formats.DUMPED)))).count() == 64_000
    df.unpersist()
    assert time.time() - start < 20  # 57 s for as many before


def test_dump_of_all_bytes(spark):
    data = bytes(range(256)) + b"end"
    lines = spark.createDataFrame([(data,)], "d binary").select(F.explode(formats.hex_rows(F.col("d"))).alias("x")).collect()
    for k, r in enumerate(lines):
        own = data[16 * k : 16 * k + 16]
        assert r["x"] == f"{16 * k:08x}  " + "".join(f"{b:02x} " for b in own).ljust(48) + " |" + "".join(chr(b) if 32 <= b < 127 else "." for b in own) + "|"
    assert len(lines) == 17


def dumped(data):
    own = [data[k : k + 16] for k in range(0, len(data), 16)]
    return [f"{16 * k:08x}  " + "".join(f"{b:02x} " for b in x).ljust(48) + " |" + "".join(chr(b) if 32 <= b < 127 else "." for b in x) + "|" for k, x in enumerate(own)]


def test_whole_texts_are_dumped(spark, tmp_path, monkeypatch):
    texts = ["", None, "a", "x" * 256, "x" * 256 + "end", "café \n" * 100, "x" * 47 + "é🎈\0\x7f" * 33, "y" * 96]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(d, k): line for d, t in enumerate(texts) for k, line in enumerate(dumped((t or "").encode()))}
    assert max(k for _, k in want) > 16  # 16 lines at most before
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert {(d, k): line for d, k, line in duck.execute(ORACLES["content_hex_dump"]).fetchall()} == want
    for size in (formats.PIECE, 48):
        monkeypatch.setattr(formats, "PIECE", size)
        rows = QUERIES["content_hex_dump"](spark, str(tmp_path)).collect()
        assert len(rows) == len(want) and {(r["doc_id"], r["line_no"]): r["line"] for r in rows} == want


def test_a_long_text_is_dumped_in_time_in_proportion(spark, tmp_path):
    text = "".join(f"{k} naïve\t" for k in range(400_000))
    spark.createDataFrame([(7, text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = time.time()
    rows = QUERIES["content_hex_dump"](spark, str(tmp_path)).orderBy("line_no").collect()
    assert time.time() - start < 60
    assert [r["line"] for r in rows] == dumped(text.encode()) and [r["line_no"] for r in rows] == list(range(len(rows)))


def test_figures_beyond_64_bits(spark, tmp_path):
    keys = [4, 1, 8_388_604, 8_388_609, 8_999_999]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r["id"]: tuple(r)[1:] for r in QUERIES["fmt_human_bytes"](spark, str(tmp_path)).collect()}
    assert found == {
        4: ("4.0TiB", "4.0 TiB", "4.00 TiB"), 1: ("1.0KiB", "1.0 KiB", "1.0 KiB"), 8_388_604: ("8.0EiB", "8.0 EiB", "8388604.00 TiB"),
        8_388_609: ("8.0EiB", "8.0 EiB", "8388609.00 TiB"), 8_999_999: ("8.6EiB", "8.6 EiB", "8999999.00 TiB"),
    }
