"""Product quantisation against plain Lloyd rounds."""

import random

import numpy as np

from tessella.llm.vector_codes import Block, heapify, next_books, vector_codes, violated


def lloyd(rows, parts, entries, rounds, scale=1024):
    """``codes, errors, books`` of ``(id, vector)`` rows, by comparing everything in each round."""
    x = np.floor(scale * np.array([v for _, v in rows], np.float64)).astype(np.int64)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [b[order].copy() for b in np.split(x, parts, axis=1)]
    away = lambda p: ((np.split(x, parts, axis=1)[p][:, None, :] - books[p][None]) ** 2).sum(2)
    for _ in range(rounds):
        for p, part in enumerate(np.split(x, parts, axis=1)):
            own = away(p).argmin(1)
            for e in set(own.tolist()):
                books[p][e] = part[own == e].sum(0) // (own == e).sum()
    codes = np.array([away(p).argmin(1) for p in range(parts)]).T
    return codes.tolist(), sum(away(p).min(1) for p in range(parts)).tolist(), books


def test_heaps():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 40, 30)
    firsts, n = np.cumsum(counts) - counts, counts.sum()
    keys, order = rng.integers(0, 50, n).astype(float), rng.permutation(n)
    owner = np.repeat(np.arange(30), counts)
    of = {int(m): int(o) for m, o in zip(order, owner, strict=True)}
    heapify(order, keys, firsts, counts, np.arange(30))
    assert {int(m): int(o) for m, o in zip(order, owner, strict=True)} == of
    for e in range(30):
        heap = keys[order[firsts[e] : firsts[e] + counts[e]]]
        assert all(heap[(k - 1) // 2] <= heap[k] for k in range(1, len(heap)))
    drift = rng.integers(0, 50, 30).astype(float)
    assert sorted(violated(order, keys, firsts, counts, drift)) == [m for m in range(n) if keys[m] <= drift[of[m]]]


def test_rounds_scan_little_once_entries_rest():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = (centres[rng.integers(0, 16, 3000)] + rng.integers(-200, 200, (3000, 8))).astype(np.int32)
    block, books = Block(x, 2), [x[:16, :4].astype(np.int64), x[:16, 4:].astype(np.int64)]
    drifts, scans = [np.zeros(16)] * 2, []
    totals = [(np.zeros((16, 4), np.int64), np.zeros(16, np.int64)) for _ in range(2)]
    for k in range(8):
        block.scanned = 0
        for m in block.round(books, None if k == 0 else drifts):
            totals[m["part"]][0][m["entry"]] += np.array(m["sums"])
            totals[m["part"]][1][m["entry"]] += m["n"]
        scans.append(block.scanned)
        for p in range(2):
            away = ((block.part(p)[:, None, :] - books[p][None]) ** 2).sum(2)
            assert (block.codes[p] == away.argmin(1)).all()
            assert (totals[p][1] == np.bincount(block.codes[p], minlength=16)).all()
        books, drifts = next_books(books, totals, drifts)
    assert scans[0] == 6000 and scans[-1] < 3000


def test_operator(spark):
    rng = random.Random(6)
    rows = [(k % 90 if k % 13 else None, [rng.choice([0.0, 0.5, -0.25, rng.uniform(-2, 2)]) for _ in range(8)], k % 4 or None) for k in range(300)] + [(5, [0.1] * 8, 1)] * 40
    bad = [(-1, None, 1), (-2, [None, *[1.0] * 7], 1), (-3, [float("nan"), *[1.0] * 7], 1), (-4, [float("-inf"), *[1.0] * 7], 1), (-5, [], 1), (900, [1.0] * 4, 2), (901, [4e4] * 8, 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id bigint, embedding array<double>, label int, codes string").repartition(5)
    for parts, entries, rounds in ((4, 16, 4), (2, 1, 2), (1, 1000, 3)):
        made = vector_codes(df, parts=parts, entries=entries, rounds=rounds)
        codes, errors, books = lloyd([(i, v) for i, v, _ in rows], parts, entries, rounds)
        assert all((a == b).all() for a, b in zip(made.books, books, strict=True))
        got = made.table.collect()
        key = lambda i, label, c, e: (str(i), str(label), tuple(c), e)
        assert sorted(key(r["row"]["vec_id"], r["row"]["label"], r["codes"], r["error"]) for r in got) == sorted(key(i, label, c, e) for (i, _, label), c, e in zip(rows, codes, errors, strict=True))
        assert {r["row"]["codes"] for r in got} == {"x"}
    empty = vector_codes(df.where("vec_id < 0"))
    assert empty.table.count() == 0 and empty.books == []


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(k, [rng.uniform(-32000, 32000) for _ in range(4)]) for k in range(120)]
    made = vector_codes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), parts=2, entries=9)
    codes, errors, _ = lloyd(rows, 2, 9, 4)
    assert [(r["codes"], r["error"]) for r in made.table.orderBy("row.vec_id").collect()] == list(zip(codes, errors, strict=True))
