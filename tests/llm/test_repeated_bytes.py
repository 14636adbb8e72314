"""Repeated byte strings and their index against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import repeated_bytes as module
from tessella.llm.queries import QUERIES
from tessella.llm.repeated_bytes import END, RunLengthIndex, anchored, repeated_bytes
from tests.llm.test_operators import docs, none, odd_rows, sentence  # noqa: F401


def plain_kept(texts, window):
    """``kept, n_bytes, n_removed, n_spans`` of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + window] for d in data for k in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - window + 1):
            if seen[d[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((kept, len(d), sum(gone), len([p for p in bytes(gone).split(b"\0") if p])))
    return out


def segments(rng, n):
    base = "".join(rng.choice("ab") for _ in range(60)).encode()
    out = []
    for _ in range(n):
        k = rng.randrange(60)
        out.append(base[k:] + bytes(rng.choice(b"abc") for _ in range(rng.randrange(30))) + base[: rng.randrange(60)])
    return [*out, b"", b"a" * 90, b"a" * 90, "äöü漢\0".encode() * 9]


def test_index_is_the_run_length_transform():
    rng = random.Random(3)
    for n in (0, 1, 12):
        parts = segments(rng, n)
        index = RunLengthIndex(parts)
        text = [c if c != END else END + 1 + k for k, s in enumerate(parts) for c in s + bytes([END])]
        order = sorted(range(len(text)), key=lambda i: text[i:])
        before = [int(index.text[i - 1]) for i in order]
        assert np.repeat(index.chars, index.lengths).tolist() == before
        ends = np.cumsum(index.lengths)
        assert index.first.tolist() == [order[k] for k in ends - index.lengths] and index.last.tolist() == [order[k - 1] for k in ends]
        assert all(a != b or a == END for a, b in zip(index.chars[:-1], index.chars[1:], strict=True))


def test_matching_statistics():
    rng = random.Random(4)
    for _ in range(20):
        parts = segments(rng, rng.randrange(1, 15))
        text = b"".join(s + bytes([END]) for s in parts)
        for least in (9, 16, 23):
            found = RunLengthIndex(parts).matching_statistics(least)
            for i in range(len(text)):
                own = text[i : text.index(END, i)]
                best = 0
                for j in range(len(text)):
                    k = 0
                    while j != i and k < len(own) and text[j + k] == own[k]:
                        k += 1
                    best = max(best, k)
                assert found[i] == best if best >= least else found[i] < least


def test_runs_are_few_in_repetitive_text():
    rng = random.Random(5)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(300))
    one, many = RunLengthIndex([base]), RunLengthIndex([base[k % 50 :] for k in range(200)])
    assert len(many.chars) < len(many.text) / 20 and len(one.chars) > len(one.text) / 2


def test_windows_and_anchors(monkeypatch):
    rng = random.Random(6)
    data = np.frombuffer(sentence(rng, 900, 30).encode() + b"x" * 500, np.uint8)
    anchors, starts = anchored(data, 200)
    assert starts[0] == 0 and (np.diff(starts) > 0).all() and starts[-1] <= len(data) - 200
    at = dict(zip(starts.tolist(), anchors.tolist(), strict=True))
    again = anchored(np.concatenate([data[100:2000], data]), 200)
    inner = {s - 1900: a for s, a in zip(again[1].tolist(), again[0].tolist(), strict=True) if s > 1900}
    assert {s: a for s, a in at.items() if s > 0} == {s: a for s, a in inner.items() if s > 0}
    monkeypatch.setattr(module, "PIECE_BYTES", 700)
    assert set(at) <= set(anchored(data, 200)[1].tolist())


def test_cells_cover_all_windows_and_hold_their_core():
    for at, size in ((0, 1), (168, 169), (5, 3), (100, 30), (168, 1), (40, 41)):
        for width in (128, 64, 1):
            found = list(module.cells(at, size, width, 200))
            assert sorted(w for _, lo, n, *_ in found for w in range(lo, lo + n)) == list(range(size))
            for _, lo, n, core, end in found:
                assert lo + n - 1 <= core <= at < at + module.GRAM <= end <= lo + 200 and len({(at - w) // width for w in range(lo, lo + n)}) == 1


@pytest.mark.parametrize("most", [512, 1, 3])
def test_operator_on_odd_rows(spark, docs, none, most):  # noqa: F811
    rows = odd_rows()
    want = {r[0]: w for r, w in zip(rows, plain_kept([r[1] for r in rows], 200), strict=True)}
    found = repeated_bytes(docs, most_segments=most)
    assert found.columns == ["row", "kept", "n_bytes", "n_removed", "n_spans"]
    assert {r["row"]["doc_id"]: (bytes(r["kept"]), *r[2:]) for r in found.collect()} == want
    assert repeated_bytes(none).count() == 0


@pytest.mark.parametrize("most", [512, 2])
def test_shared_passages_within_and_across_rows(spark, most, monkeypatch):
    rng = random.Random(7)
    passage = sentence(rng, 60)
    texts = [sentence(rng, rng.randrange(90)) + passage + sentence(rng, rng.randrange(60)) for _ in range(12)]
    texts += [passage[k : k + 199 + k % 3] for k in range(9)] + ["ab" * 400 + "c" * 300, "é" * 150, "x" + "é" * 130, passage[:150] + "?" + passage[151:] + passage[:260]]
    texts += [texts[0], None, "", "z" * 199, "y" * 200, sentence(rng, 3000, 5)]
    rows = [(None if k % 5 == 0 else k % 7, t, k) for k, t in enumerate(texts)]
    got = repeated_bytes(spark.createDataFrame(rows, "doc_id bigint, text string, kept int").repartition(4), most_segments=most).collect()
    assert [(bytes(r["kept"]), *r[2:]) for r in sorted(got, key=lambda r: r["row"]["kept"])] == plain_kept(texts, 200)


def test_registered_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: (*w[1:], hashlib.sha256(w[0]).hexdigest()) for r, w in zip(rows, plain_kept([r["text"] for r in rows], 200), strict=True)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op13_repeated_bytes"](spark, sf).collect()} == want
