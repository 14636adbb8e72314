"""The cache as a store of versions against a plain dictionary."""

import random

import pytest

from tessella.operators import store as module
from tessella.operators.store import COLUMNS, CacheStore, Conflict

SCHEMA = ", ".join(f"{c} {k}" for c, k in COLUMNS.items())


def entry(path, size=10, mtime=1, sample=5, full=None, hit=1, dev=0):
    return (path, size, mtime, sample, sample, sample, sample, full, hit, dev, 7)


def plain_put(cache, e):
    old = cache.get(e[0])
    blank = not any(e[3:7])
    samples = old[3:7] if blank and old else e[3:7]
    full = e[7]
    if full is None and old and old[1:3] == e[1:3] and (blank or old[3:7] == e[3:7]):
        full = old[7]
    cache[e[0]] = (*e[:3], *samples, full, *e[8:])


def rows(spark, entries):
    return spark.createDataFrame(entries, SCHEMA)


def read(store):
    return {r["path"]: tuple(r[c] for c in COLUMNS) for r in store.read().collect()}


def files(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_any_sequence_equals_a_dictionary(spark, tmp_path):
    rng, want = random.Random(1), {}
    store = CacheStore(spark, f"file://{tmp_path}/cache", buckets=3, fanout=3)
    assert read(store) == {}
    for step in range(9):
        if step % 3 == 2:
            some = rng.sample(sorted(want), min(4, len(want))) + ["never there"]
            store.touch(spark.createDataFrame([(p,) for p in some * 2], "path string"), 100 + step)
            want |= {p: (*want[p][:8], 100 + step, *want[p][9:]) for p in some if p in want}
        else:
            batch = [entry(f"p{k}", rng.choice([10, 11]), rng.choice([1, 2]), rng.choice([0, 5, 6]), rng.choice([None, "f", "g"]), step) for k in rng.sample(range(20), 9)]
            store.upsert(rows(spark, batch).repartition(2))
            for e in batch:
                plain_put(want, e)
        assert read(store) == want
        assert len(store.state["deltas"]) <= 3
    assert store.state["base"] and read(CacheStore(spark, f"file://{tmp_path}/cache")) == want


def test_an_upsert_writes_its_own_rows_only(spark, tmp_path):
    store = CacheStore(spark, f"file://{tmp_path}/cache", buckets=8)
    store.upsert(rows(spark, [entry(f"p{k}") for k in range(500)]))
    store.compact()
    before = files(tmp_path)
    store.upsert(rows(spark, [entry("p7", size=3), entry("new"), entry("new", size=4)]))
    added = files(tmp_path) - before
    assert before <= files(tmp_path) and sum("manifest" in f for f in added) == 1
    assert spark.read.parquet(*{f"file://{tmp_path}/{f.rsplit('/', 1)[0]}" for f in added if "delta" in f}).count() == 2
    found = read(store)
    assert len(found) == 501 and found["p7"][1] == 3 and found["new"][1] == 10
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1  # of the deltas


def test_readers_keep_their_version_and_failed_writers_change_nothing(spark, tmp_path, monkeypatch):
    store = CacheStore(spark, f"file://{tmp_path}/cache", buckets=2)
    store.upsert(rows(spark, [entry("a"), entry("b")]))
    reader = CacheStore(spark, f"file://{tmp_path}/cache")
    held = reader.read()
    store.upsert(rows(spark, [entry("a", size=99), entry("c")]))
    store.compact()
    assert {r["path"]: r["size"] for r in held.collect()} == {"a": 10, "b": 10} and len(read(store)) == 3
    assert read(store.at(1)) == read(reader)
    with pytest.raises(Conflict):  # it began from version 1
        reader.upsert(rows(spark, [entry("z")]))
    assert len(read(CacheStore(spark, f"file://{tmp_path}/cache"))) == 3
    monkeypatch.setattr(CacheStore, "_commit", lambda self, **changed: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.upsert(rows(spark, [entry("lost")]))
    monkeypatch.undo()
    again = CacheStore(spark, f"file://{tmp_path}/cache")
    assert set(read(again)) == {"a", "b", "c"}
    gone = again.vacuum(keep=1)
    assert any(n.startswith("delta-") for n in gone) and set(read(again)) == {"a", "b", "c"}
    assert again.vacuum(keep=1) == []


def test_eviction_by_histograms(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(module, "_BINS", 4)
    for most, times in ((37, [rng.randrange(1000) for _ in range(120)]), (50, [5] * 120), (0, [1, 2, 3]), (119, list(range(120))), (200, [1] * 120)):
        store = CacheStore(spark, f"file://{tmp_path}/cache{most}", buckets=2)
        entries = [entry(f"p{k:03}", hit=t) for k, t in enumerate(times)]
        store.upsert(rows(spark, entries))
        kept = {e[0] for e in sorted(entries, key=lambda e: (e[8], e[0]), reverse=True)[:most]}
        assert store.evict(most) == len(entries) - len(kept)
        assert set(read(store)) == kept
        store.upsert(rows(spark, [entry("p000", hit=1)]))
        assert set(read(store)) == kept | {"p000"}


def test_batches_are_put_in_once(spark, tmp_path):
    store = CacheStore(spark, f"file://{tmp_path}/cache", buckets=2)
    assert store.upsert(rows(spark, [entry("a")]), ("s", 0)) and not store.upsert(rows(spark, [entry("b")]), ("s", 0))
    assert store.upsert(rows(spark, [entry("c")]), ("other", 0)) and CacheStore(spark, f"file://{tmp_path}/cache").committed("s") == 0
    assert set(read(store)) == {"a", "c"}
