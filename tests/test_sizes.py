"""Tasks that stay small when tables grow."""

import pyarrow as pa

from tessella.functions import treehash
from tessella.llm import _sketch, ngram_jaccard, substring_dedup
from tessella.operators import rank
from tessella.plans.action_queries import _journal, _ledgers
from tessella.sources import contents, export
from tessella.sources.walk import lay_out


def test_journal_joins_are_dealt_by_rows(spark, sf, monkeypatch):
    whole = [sorted(map(str, t.collect())) for t in _journal(spark, sf)]
    monkeypatch.setattr(rank, "TASK_ROWS", 200)
    items, strays = _journal(spark, sf)
    assert len(whole[0]) > 5000 and min(items.rdd.getNumPartitions(), strays.rdd.getNumPartitions()) >= len(whole[0]) // 200  # 4 at most before
    assert [sorted(map(str, t.collect())) for t in (items, strays)] == whole


def test_an_export_is_compressed_and_dealt_by_rows(spark, sf, tmp_path, monkeypatch):
    tables = dict(_ledgers(spark, sf)[1])
    monkeypatch.setattr(rank, "TASK_ROWS", 500)
    export.write_export(tables, f"file://{tmp_path}/a", compression="gzip")
    files = list((tmp_path / "a").glob("data-*/kind=op_records/part-*"))
    assert len(files) > 8 and all(f.name.endswith(".txt.gz") for f in files)  # 4 files of plain text at most before
    back = export.read_export(spark, f"file://{tmp_path}/a")
    assert all(back[n].count() == tables[n].count() for n in back)


def test_contents_are_laid_out_in_small_batches(spark, tmp_path):
    def checked(batches):
        for batch in batches:
            assert batch.num_rows <= 500 and batch.nbytes < 8 << 20  # 2,000 rows of 40 MB before
            yield batch

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(2000, numPartitions=1).selectExpr("concat('/d/', id) as path", "cast(repeat('x', 20000) as binary) as content")
    spark.conf.set(key, "10000")
    try:
        assert lay_out(rows.mapInArrow(checked, rows.schema), f"{tmp_path}/t") == 2000 and spark.conf.get(key) == "10000"
    finally:
        spark.conf.set(key, before)
    assert len(list((tmp_path / "t/d").iterdir())) == 2000


def test_filters_are_filled_by_one_worker_a_task(spark, monkeypatch):
    names = spark.createDataFrame([(bytes([k]) * 16,) for k in range(50)], "c binary")
    plans, whole = [], _sketch.gathered

    def seen(pieces, *rest):
        plans.append(pieces._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
        return whole(pieces, *rest)

    monkeypatch.setattr(_sketch, "gathered", seen)
    bits = substring_dedup._filter_of(names).value
    assert _sketch.may_hold(bits, substring_dedup._seq64([bytes([k]) * 16 for k in range(50)])).all() and bits.any()
    docs = spark.createDataFrame([("a b c",), ("d e f",), (None,)], "text string")
    wanted = spark.createDataFrame([(ngram_jaccard.class_of(next(iter(ngram_jaccard.shingle_sets(pa.array(["a b c"]), 2)))),)], "c binary")
    assert ngram_jaccard._contents(docs, "text", 2, wanted).count() == 1
    assert plans == [1, 1]  # two workers a task before


def test_short_ranges_are_hashed_side_by_side(tmp_path, monkeypatch):
    files = [bytes(k % 251 for k in range(n, 5 * n)) for n in range(1025, 3000, 100)]
    asked = []
    for k, data in enumerate(files):
        (tmp_path / str(k)).write_bytes(data)
        asked += [(str(tmp_path / str(k)), len(data), at, min(4096, len(data) - at)) for at in range(0, len(data), 4096)]
    want, calls, whole = [treehash.digest(data) for data in files], [], treehash._compress
    monkeypatch.setattr(treehash, "_compress", lambda *x: calls.append(1) or whole(*x))
    found = contents.hash_ranges([*asked, (str(tmp_path / "none"), 9000, 0, 4096)], 4096)
    assert found.pop() == (None, "FileNotFoundError", 0) and all(p is None for _, p, _ in found)
    nodes = [[(n["level"], n["index"], n["value"]) for (path, *_), (own, _, _) in zip(asked, found, strict=True) if path == str(tmp_path / str(k)) for n in own] for k in range(len(files))]
    assert treehash.all_combined([(own, treehash.chunks_of(len(data))) for own, data in zip(nodes, files, strict=True)]) == want
    assert len(asked) > 40 and len(calls) < 40  # 17 for each range before
