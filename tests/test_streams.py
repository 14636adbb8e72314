"""Journals, progress and arriving files: streams against plain folds and tables."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators.store import CacheStore
from tessella.streaming import incremental, journal, progress, sink

STATES = [s for s in journal.STATES if s]
SCHEMA = "item bigint, seq bigint, state string, at timestamp"


def plain_fold(events):
    """``state, taken, rejected`` by item, one event after the other."""
    out = defaultdict(lambda: ["", 0, 0])
    for item, _, state, _ in sorted(events, key=lambda e: e[:2]):
        own = out[item]
        if state in journal.NEXT[own[0]]:
            own[0], own[1] = state, own[1] + 1
        else:
            own[2] += 1
    return {k: tuple(v) for k, v in out.items()}


def some_events(n=600, items=12):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    return [(rng.randrange(items), k, rng.choice([*STATES, "planned", "done", "undoing", "?"]), start + dt.timedelta(minutes=k)) for k in range(n)]


def test_folding_in_parts_is_folding(spark, monkeypatch):
    events = some_events()
    df = spark.createDataFrame(events, SCHEMA).repartition(5)
    for part in (1000, 7, 1):
        monkeypatch.setattr(journal, "PART_EVENTS", part)
        for end in (600, 37, 1):
            rows = df.where(F.col("seq") < end)
            got = {r["item"]: (r["state"], r["taken"], r["rejected"]) for r in journal.folded(rows.unionByName(rows)).collect()}
            assert got == plain_fold([e for e in events if e[1] < end])
    odd = spark.createDataFrame([(None, 1, "planned"), (1, None, "planned"), (2, 1, None), (2, 2, "planned")], "item bigint, seq bigint, state string")
    assert [tuple(r) for r in journal.folded(odd).collect()] == [(2, "planned", 1, 1)] and journal.folded(odd.limit(0)).count() == 0


def test_a_stream_equals_the_fold_of_what_has_arrived(spark, tmp_path):
    events = some_events()
    come, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    rows = spark.createDataFrame(events, SCHEMA)
    stream = lambda: journal.tracked(spark.readStream.schema(SCHEMA).parquet(come))
    for lo, hi in ((0, 200), (200, 390), (390, 600)):
        rows.where(F.col("seq").between(lo, hi - 1)).repartition(3).write.mode("append").parquet(come)
        sink.run_to_end(stream(), out, state)
        got = {r["item"]: (r["state"], r["taken"], r["rejected"]) for r in sink.latest(spark, out, ["item"]).collect()}
        assert got == plain_fold(events[:hi])
    rows.where(F.col("seq") % 3 == 0).write.mode("append").parquet(come)  # repeated and late ones
    sink.run_to_end(stream(), out, state)
    found = sink.latest(spark, out, ["item"]).collect()
    assert {r["item"]: (r["state"], r["taken"], r["rejected"]) for r in found} == plain_fold(events) and sum(r["stale"] for r in found) == 200


def test_what_stays_open_is_given_up(spark, tmp_path):
    come, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    at = lambda h: dt.datetime(2024, 1, 1, h)
    first = [(1, 1, "planned", at(0)), (2, 1, "planned", at(0)), (2, 2, "done", at(0)), (2, 3, "undoing", at(1)), (3, 1, "planned", at(0)), (3, 2, "done", at(0)), (4, 1, "planned", at(8))]
    stream = lambda: journal.tracked(spark.readStream.schema(SCHEMA).parquet(come).withWatermark("at", "1 hour"), "2 hours")
    for rows in (first, [(5, 1, "planned", at(9))], [(5, 2, "done", at(9))]):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(come)
        sink.run_to_end(stream(), out, state)
    assert {r["item"]: r["state"] for r in sink.latest(spark, out, ["item"]).collect()} == {1: "interrupted", 2: "undo_failed", 3: "done", 4: "planned", 5: "done"}


def test_late_events_are_dropped_by_rule(spark):
    at = dt.datetime(2024, 1, 1, 5, 30)
    rows = [("a", at, at, 1, 10), ("a", at, at + dt.timedelta(hours=1), 1, 20), ("a", at, at + dt.timedelta(minutes=61), 1, 40), ("b", at, None, 1, 80), ("b", None, at, 1, 80), ("a", at + dt.timedelta(hours=2), at, 1, 5)]
    df = spark.createDataFrame(rows, "stage string, at timestamp, arrived timestamp, files bigint, bytes bigint")
    found = progress.windows(df)
    assert sorted((r["stage"], r["start"].hour, r["files"], r["bytes"]) for r in found.collect()) == [("a", 5, 2, 30), ("a", 7, 1, 5)]
    total = spark.createDataFrame([("a", 70)], "stage string, total bigint")
    got = progress.speeds(found, total).first()
    assert (got["files"], got["bytes"], got["percent"], got["eta"]) == (1, 5, 50.0, 3 * 3600) and got["speed"] == round(35 / (3 * 3600), 6)
    assert progress.speeds(found, total.limit(0)).first()["eta"] == -1


def test_arriving_files_meet_the_store(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    (folder / "d").mkdir(parents=True)
    for k in range(3):
        (folder / f"d/{k}.bin").write_bytes(b"same")
    (folder / "large").write_bytes(b"x" * 200_000)
    store = CacheStore(spark, f"file://{tmp_path}/cache", buckets=2)
    run = lambda: incremental.run_once(incremental.arriving(spark, f"file://{folder}"), store, "s", f"file://{tmp_path}/state", 5)
    figures = lambda: sorted((r["size"], r["n_files"], r["reclaimable"]) for r in incremental.duplicates(store).collect())
    run()
    assert figures() == [(4, 3, 8)] and store.committed("s") == 0
    (folder / "copy").write_bytes(b"x" * 200_000)
    (folder / "d/3.bin").write_bytes(b"same")
    # the second batch fails after its rows are in: when it comes again nothing changes
    real = CacheStore.upsert

    def fails(self, *a, **b):
        real(self, *a, **b)
        raise KeyError("lost driver")

    monkeypatch.setattr(CacheStore, "upsert", fails)
    with pytest.raises(Exception, match="lost driver"):
        run()
    monkeypatch.undo()
    version = store.state["version"]
    store = CacheStore(spark, f"file://{tmp_path}/cache")
    assert store.state["version"] == version and store.committed("s") == 1
    run()
    assert figures() == [(4, 4, 12), (200_000, 2, 200_000)] and store.state["version"] == version


def test_known_files_are_not_read_again(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"same")
    store = CacheStore(spark, f"file://{tmp_path}/cache", buckets=2)
    batch = spark.createDataFrame([(f"{tmp_path}/f", 4, 1)], "path string, size bigint, mtime_ns bigint")
    assert incremental.take_in(store, batch, "s", 0, 1) == 1 and incremental.take_in(store, batch, "s", 0, 1) == 0
    (tmp_path / "f").write_bytes(b"newer")
    assert incremental.take_in(store, batch, "s", 1, 2) == 0
    assert incremental.take_in(store, batch.withColumn("size", F.lit(5).cast("bigint")), "s", 2, 3) == 1
    assert [(r["size"], r["last_hit"]) for r in store.read().collect()] == [(5, 3)]
