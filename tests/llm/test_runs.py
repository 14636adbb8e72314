"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessella.llm.periodic_runs import find_runs, periodic_runs
from tessella.llm.queries import QUERIES, planted
from tests.llm import plain
from tests.llm.test_operators import SCHEMA, docs, none, odd_rows, sentence  # noqa: F401


def runs_of(words, least_length=6, least_exponent=4):
    """All runs of a list of words, by trying every period at every place."""
    best, n = {}, len(words)
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least_length, least_exponent * q):
                best.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def plant(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def digests(doc_id, text):
    words = plant(doc_id, plain.words(text, fold=False))
    runs = runs_of(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed(words, runs))))


def periodic(rng):
    """Words in which repeats of repeats are likely."""
    out = []
    for _ in range(rng.randrange(1, 8)):
        block = [str(rng.randrange(3)) for _ in range(rng.randrange(1, 6))]
        out += (block * rng.randrange(1, 9)) * rng.randrange(1, 4) + [str(rng.randrange(4)) for _ in range(rng.randrange(4))]
    return out


def test_runs_of_many_rows_at_once():
    rng = random.Random(5)
    texts = [periodic(rng) for _ in range(300)] + [["a"] * 500, [], ["x"], ["a", "b"] * 257 + ["c"], [str(rng.randrange(2)) for _ in range(2000)]]
    for length, exponent in ((6, 4), (1, 2), (9, 3)):
        ids = np.array([int(w) if w.isdigit() else ord(w) for t in texts for w in t], np.int64)
        splits = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        start, end, period = find_runs(ids, splits, length, exponent)
        row = np.searchsorted(splits, start, side="right") - 1
        got = [[] for _ in texts]
        for r, s, e, q in zip(row, start, end, period, strict=True):
            got[r].append((int(s - splits[r]), int(e - s), int(q)))
        assert got == [runs_of(t, length, exponent) for t in texts]


def test_operator_on_odd_rows(spark, docs, none):  # noqa: F811
    found = periodic_runs(docs)
    assert found.columns == ["row", "text", "n_words", "runs"]
    texts = {r[0]: r[1] for r in odd_rows()}
    for r in found.collect():
        words = plain.words(texts[r["row"]["doc_id"]], fold=False)
        runs = runs_of(words)
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == runs and r["text"] == collapsed(words, runs)
    assert periodic_runs(none).count() == 0


def test_repeats_null_ids_and_a_long_text(spark):
    long = "α " * 3 + " ".join(["one two three"] * 40_000) + "\tend"
    rows = [(None, long, "x"), (1, long, "x"), (1, long, "x"), (2, None, None), (2, "a a a a a a\n", None)]
    out = periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string, runs string")).collect()
    assert sorted((len(r["runs"]), r["n_words"], r["text"]) for r in out) == [(0, 0, ""), (1, 6, "a"), *[(1, 120_004, "α α α one two three end")] * 3]
    assert {tuple(r["runs"][0]) for r in out if r["n_words"] > 6} == {(3, 120_000, 3)}


def test_registered_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: digests(r["doc_id"], r["text"]) for r in rows}
    got = {r["doc_id"]: tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    assert got == want and any(v[0] for v in want.values())


def test_planting(spark):
    rng = random.Random(2)
    rows = [(k, sentence(rng, rng.randrange(40))) for k in range(200)] + [(None, "a b"), (17, None), (18, ""), (30, " \n")]
    out = planted(spark.createDataFrame(rows, "doc_id bigint, text string")).withColumn("text", F.coalesce("text", F.lit(""))).collect()
    assert sorted((str(r["doc_id"]), r["text"].split()) for r in out) == sorted((str(k), plant(k, (t or "").split())) for k, t in rows)
