"""The operators against brute force on a small table of odd rows, and on empty tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import _sketch, lm, topk
from tessella.llm import substring_dedup as substring_dedup_module
from tessella.llm import ngram_jaccard as jaccard
from tessella.llm._graph import components
from tessella.llm._tokens import Encoder
from tessella.llm.decontaminate import HammingIndex, contamination
from tessella.llm.language import language_id
from tessella.llm.license_scan import NOTICES, license_scan
from tessella.llm.ngram_jaccard import ngram_jaccard, parity_bits, parity_distance
from tessella.llm.packing import BestFit, pack
from tessella.llm.queries import ORACLES, QUERIES
from tessella.llm.substring_dedup import FingerprintIndex, substring_dedup
from tessella.llm.token_files import TokenFile, pack_bits, read_range, read_token_files, to_file, unpack_bits, write_token_files
from tessella.llm.url_filter import rule_table, url_filter
from tests.conftest import same
from tests.llm import plain

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, cls string, row string, n int, words string, seq string"


def sentence(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def odd_rows():
    rng = random.Random(3)
    base, passage = sentence(rng, 150), sentence(rng, 70)
    texts = [None, "", " \n\t ", "One", "one two", "One TWO three", base, base, base.upper().replace("W", "w"), "é ß 漢字 \u00a0x", "<|endoftext|> a", "a  b   c", "!!! 123 ---"]
    for _ in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [sentence(rng, 40) + "\n" + passage + " " + sentence(rng, 60) for _ in range(8)]
    texts += [sentence(rng, 9000), "x " * 3000, passage, sentence(rng, 9000, 50)]
    texts += [f"The house and the river, {sentence(rng, 5)} the way of it is {k}" for k in range(6)] + [f"Der Fluss und das Haus, die {sentence(rng, 5)} ist nicht der Weg {k}" for k in range(6)]
    lang = lambda k, t: None if k % 9 == 0 else ("de" if t and "Haus" in t else "en")
    return [(k, t, lang(k, t), f"src{k % 3}", len(t or ""), 1, "c", "r", 2, "w", "s") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


TEXTS = {r[0]: r[1] for r in odd_rows()}
REPEATED = [(None, "null id text " * 30, "en", "s", 1, 1, "c", "r", 2, "w", "s"), (6, TEXTS[6], "en", "s", 1, 1, "c", "r", 2, "w", "s")]


def test_jaccard(spark, docs, none):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard(docs).collect()}
    assert found == plain.jaccard_groups(TEXTS)
    more = ngram_jaccard(docs.unionByName(spark.createDataFrame(REPEATED, SCHEMA)), width=5, num=80).collect()
    want = plain.jaccard_groups(TEXTS, 5, 80)
    assert len(more) == len(TEXTS) + 2 and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in more if r["doc_id"] is not None)
    assert ngram_jaccard(none).collect() == []


def test_jaccard_of_a_group_whose_members_are_far_from_its_centre(spark):
    rng = random.Random(5)
    base = sentence(rng, 60, 10**6).split()
    rows = []
    for k in range(120):
        w = list(base)
        for at in rng.sample(range(60), rng.randrange(5)):
            w[at] = f"e{rng.randrange(3)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard(df).collect()} == plain.jaccard_groups(dict(rows))


def test_jaccard_counts_every_link_in_a_component(spark, docs, monkeypatch):
    rng = random.Random(6)
    texts = dict(TEXTS)
    for group in range(3):
        base = sentence(rng, 80, 10**6).split()
        for k in range(40):
            w = list(base)
            for at in rng.sample(range(80), rng.randrange(4)):
                w[at] = f"e{rng.randrange(3)}"
            texts[10**6 + 100 * group + k] = " ".join(w[: 78 + k % 3])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = plain.jaccard_links(texts)
    assert max(want.values()) > 5
    groups = plain.jaccard_groups(texts)
    for grams, rows, each in ((1 << 18, 2048, 4), (500, 8, 1)):
        monkeypatch.setattr("tessella.llm.ngram_jaccard.BLOCK_GRAMS", grams)
        monkeypatch.setattr("tessella.llm.ngram_jaccard.BLOCK_ROWS", rows)
        monkeypatch.setattr("tessella.llm.ngram_jaccard.PAIRS_EACH", each)
        found = ngram_jaccard(df).collect()
        assert {r["doc_id"]: r["n_links"] for r in found} == want
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == groups


def test_blocks_join_what_links_join():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 64, 200, np.uint64)
    sets = sorted((np.unique(np.concatenate([base[rng.random(200) > 0.06], rng.integers(0, 1 << 64, rng.integers(6), np.uint64)])) for _ in range(60)), key=len)
    sizes, bits, label, sides = np.asarray([len(x) for x in sets]), [parity_bits(x, 80, 100) for x in sets], np.arange(60) % 50, np.arange(60) % 2

    def groups(pairs):
        top = label.copy()
        for a, b in pairs:
            top[top == top[b]] = top[a]
        return {frozenset(np.flatnonzero(top == t).tolist()) for t in top}

    def linked(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return both * 100 >= 80 * (len(sets[a]) + len(sets[b]) - both)

    near = lambda a, b: parity_distance(bits[a], bits[b]) * 180 <= (len(sets[a]) + len(sets[b])) * 20 and len(sets[b]) * 80 <= len(sets[a]) * 100
    for two in (sides, sides * 0):
        fresh = lambda: jaccard.Block(sizes, bits, two, 80, 100)  # noqa: B023, E731
        allowed = [(a, b) for a in range(60) for b in range(a + 1, 60) if label[a] != label[b] and (two is not sides or two[a] != two[b])]
        want = [x for x in allowed if near(*x)]
        found, cut_short = jaccard.near_pairs(fresh(), label, float("inf"))
        assert sorted(found) == want and not cut_short
        for most in (0, 5):
            forest, cut_short = jaccard.near_pairs(fresh(), label, most)
            assert cut_short and groups(forest) == groups(want) and len(forest) < 60
        assert set(np.flatnonzero(jaccard.marked(fresh(), label)).tolist()) == {x for pair in want for x in pair}
        forest = jaccard.linked_forest(fresh(), label, sets)
        assert groups(forest) == groups([x for x in allowed if linked(*x)]) and all(linked(*x) for x in forest) and len(forest) < 60


def test_components(spark):
    rng = random.Random(11)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(5, 5), (500, 501), (501, 500)]
    top = {x: x for pair in links for x in pair}
    for _ in links:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    assert {r["node"]: r["root"] for r in components(df).collect()} == {x: t for x, t in top.items() if sum(v == t for v in top.values()) > 1}
    assert components(df.where("a < 0")).collect() == []


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for n in (10, 600, 3000):
        a = rng.integers(0, 1 << 64, n, np.uint64)
        b = np.concatenate([a[5:], rng.integers(0, 1 << 64, n // 2, np.uint64)])
        for num in (50, 80, 90):
            assert parity_distance(parity_bits(a, num, 100), parity_bits(b, num, 100)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_substring_dedup(spark, docs, none):
    expected = plain.substring_dedup(TEXTS)
    for batches in (1, 4):
        found = substring_dedup(docs, batches=batches, joined=True).select("row.doc_id", "text", "n_words", "n_removed").collect()
        assert {r["doc_id"]: r["text"] for r in found} == {i: " ".join(w) for i, w in expected.items()}
        assert all(r["n_words"] - r["n_removed"] == len(expected[r["doc_id"]]) for r in found)
    more = substring_dedup(docs.unionByName(spark.createDataFrame(REPEATED, SCHEMA))).select("row.*", "text", "n_removed").collect()
    assert len(more) == len(TEXTS) + 2 and all(r["n_removed"] == 0 for r in more if r["doc_id"] in (None, 6))
    assert substring_dedup(none).collect() == []


def test_index_keeps_repeats_over_compactions(spark):
    batch = lambda part: spark.createDataFrame(part, "doc bigint, h bigint")
    rows = [[(1, 10), (1, 11)], [(2, 12), (3, 12)], [(4, 10)], [(5, 11), (5, 99)], [(6, 99), (6, 7)], [(7, 7), (8, 12)], [(9, 1)], [(10, 1), (10, 10)]]
    want = [[], [12], [10], [11], [99], [7, 12], [], [1, 10]]
    index = FingerprintIndex(spark, fanout=1)
    assert [sorted(r["h"] for r in index.add(batch(part)).collect()) for part in rows] == want
    levels = [r["level"] for r in index.runs]
    assert len(levels) == len(rows).bit_length() or max(levels) >= 2
    again = FingerprintIndex(spark, index.folder)
    assert again.runs == index.runs and again.buckets == index.buckets
    assert sorted(r["h"] for r in again.add(batch([(11, 12), (11, 55), (12, 11)])).collect()) == [11, 12]
    plan = index._table(index.runs[0]).select("h").join(index._table(index.runs[-1]).select("h").hint("merge"), "h")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    again.forget()


def test_index_is_dealt_into_more_buckets(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup_module, "BUCKET_ROWS", 20)
    rng, seen = random.Random(2), Counter()
    index = FingerprintIndex(spark, fanout=1)
    for k in range(5):
        rows = [(d, h) for d in range(k * 10, k * 10 + 10) for h in {rng.randrange(300) for _ in range(12)}]
        for _, h in rows:
            seen[h] += 1
        found = FingerprintIndex(spark, index.folder).add(spark.createDataFrame(rows, "doc bigint, h bigint"))
        assert {r["h"] for r in found.collect()} == {h for h in {h for _, h in rows} if seen[h] > 1}
    last = FingerprintIndex(spark, index.folder)
    assert last.buckets > index.buckets
    last.forget()


def test_dedup_of_three_batches_against_a_stored_index(spark, docs):
    """Batches one after another, each in a newly opened index, give what all documents at once do."""
    expected, index = plain.substring_dedup(TEXTS), FingerprintIndex(spark)
    edges = [-1, len(TEXTS) // 3, 2 * len(TEXTS) // 3, len(TEXTS)]
    found = {}
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        part, history = docs.where(F.col("doc_id").between(lo + 1, hi)), docs.where(F.col("doc_id") <= lo)
        rows = substring_dedup(part, batches=1, joined=True, index=FingerprintIndex(spark, index.folder), history=history)
        found |= {r["doc_id"]: r["text"] for r in rows.select("row.doc_id", "text").collect()}
    assert found == {i: " ".join(w) for i, w in expected.items()}
    named = docs.withColumn("doc_id", F.format_string("id%05d", "doc_id"))
    texts = {r["doc_id"]: r["text"] for r in substring_dedup(named, joined=True).select("row.doc_id", "text").collect()}
    assert texts == {f"id{i:05d}": " ".join(w) for i, w in expected.items()}
    index.forget()


def test_contamination(spark, docs, none):
    rng = random.Random(9)
    held, near = TEXTS[25].split()[45:75], TEXTS[25].split()[50:100]
    near[20] = "other"
    items = {1: " ".join(held).upper().replace("W", "w"), 2: " ".join(near), 3: sentence(rng, 30, 10**6), 4: "One", 5: "", 6: None, 7: TEXTS[25].split()[3] + " q q q q q q"}
    table = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    for shard in (10, 10**6):
        found = contamination(docs, table, shard_words=shard).select("row.doc_id", "item_id", "similarity").collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == plain.contaminated(TEXTS, items)
    assert contamination(none, table).collect() == [] and contamination(docs, table.where("false")).collect() == []


def test_hamming_index_is_exact():
    rng = np.random.default_rng(2)
    for count in (300, 3000):
        prints = rng.integers(0, 1 << 64, (count, 4), np.uint64)
        index = HammingIndex(prints, 63)
        asked = prints[:60].copy()
        for r, q in enumerate(asked):
            for bit in rng.choice(256, 55 + r % 12, replace=False).tolist():
                q[bit // 64] ^= np.uint64(1 << bit % 64)
        distance = np.bitwise_count(asked[:, None] ^ prints[None]).sum(axis=2)
        assert list(zip(*(x.tolist() for x in index.near(asked)), strict=True)) == list(zip(*(x.tolist() for x in np.nonzero(distance <= 63)), strict=True))
        strangers = rng.integers(0, 1 << 64, (200, 4), np.uint64)
        assert len(index.candidates(strangers)[0]) < 0.01 * 200 * count


def test_decontamination_finds_what_exact_similarity_does(spark):
    """Recall where windows are just as similar as they need be, also with repeated shingles."""
    rng = random.Random(12)
    items = {k: sentence(rng, 40 + 7 * (k % 5), 5000) for k in range(40)} | {k: "go " * (30 + k) + sentence(rng, 8, 5000) for k in range(40, 44)}
    texts = {}
    for k in range(400):
        w = items[k % 44].split()
        for _ in range(rng.randrange(4)):  # one word in the middle changes five shingles
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
        texts[k] = " ".join([sentence(rng, rng.randrange(30), 5000), *w[rng.randrange(3) :], sentence(rng, rng.randrange(30), 5000)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    want = plain.contaminated(texts, items)
    got = {(r["doc_id"], r["item_id"]) for r in contamination(docs, bench).select("row.doc_id", "item_id").collect()}
    assert got <= want and len(want) > 150 and len(got) >= 0.99 * len(want)
    odd = spark.createDataFrame([(None, texts[0]), (0, texts[0]), (0, texts[0]), (1, "")], "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS start", "'x' AS row")
    rows = contamination(odd, bench.unionByName(bench.where("item_id = 0"))).collect()
    one = [(i, j) for i, j in want if i == 0]
    assert len(rows) == 3 * sum(1 + (j == 0) for _, j in one) and {r["row"]["doc_id"] for r in rows} == ({None, 0} if one else set())
    tie = spark.createDataFrame([(1, f"{items[3]} {items[3]}")], "doc_id bigint, text string")
    assert [(r["item_id"], r["start"], r["similarity"]) for r in contamination(tie, bench).collect()] == [(3, 0, 1.0)]


def test_language(spark, docs, none):
    rows = {r["doc_id"]: r for r in language_id(docs).collect()}
    assert {i for i, r in rows.items() if r["held_out"]} == {i for i in TEXTS if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in rows.items() if r["lang_pred"] == "und"} == {i for i, t in TEXTS.items() if not any(c.isalpha() for c in t or "")}
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    labelled = [i for i, t in TEXTS.items() if t and ("Haus" in t or "house" in t)]
    assert sum(rows[i]["lang_pred"] == ("de" if "Haus" in TEXTS[i] else "en") for i in labelled) >= len(labelled) - 1
    assert language_id(none).collect() == []
    assert {r["lang_pred"] for r in language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_accuracy_on_held_out_documents(spark, sf):
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = QUERIES["op3_language_id"](spark, sf).where("held_out").join(truth, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_lm(spark, docs, none):
    """Against a plain suffix tree, whatever part of the tree is broadcast."""
    rng = random.Random(1)
    texts = TEXTS | {1000 + k: " ".join(rng.choice(["a b c", "a b d", "x y", "b A", "a a b c d"]) for _ in range(300)) for k in range(6)}
    tokens = {i: [*plain.words(t), None] for i, t in texts.items()}
    learned = [w for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    for depth, context, following, most in ((3, 12, 3, 40), (2, 30, 2, 0), (1, 8, 5, 10**6)):
        tree = plain.SuffixTree(learned, depth, context, following, 5.0)
        assert max(map(len, tree.states)) == depth
        for past in list(tree.states)[:40]:
            unseen = tree.probability(past, "no such word")
            assert math.isclose(sum(tree.probability(past, w) for w in tree.words) + unseen, 1, rel_tol=1e-9)
        for r in lm.lm_score(df, depth=depth, least_context=context, least_next=following, most_words=most, most_parts=most).collect():
            w = tokens[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in tree.words for x in w), tree.total)
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
            assert math.isclose(r["base_score"], sum(math.log10((tree.words[x] + 1) / (tree.total + tree.size + 1)) for x in w), rel_tol=1e-9)
            assert math.isclose(r["score"], tree.score(w, depth), rel_tol=1e-9)
    assert lm.lm_score(none).collect() == []
    odd = docs.unionByName(spark.createDataFrame(REPEATED, SCHEMA))
    rows = lm.lm_score(odd).collect()
    assert len(rows) == len(TEXTS) + 2 and {r["train_tokens"] for r in rows} == {sum(len(tokens[i]) for i in [*TEXTS, 6] if zlib.crc32(str(i).encode()) % 7 != 2)}
    assert len({(r["score"], r["base_score"]) for r in rows if r["doc_id"] == 6}) == 1 and all(r["n_tokens"] == 91 for r in rows if r["doc_id"] is None)
    unlearned = lm.lm_score(docs.withColumn("doc_id", F.lit(None).cast("bigint"))).collect()
    assert all(r["score"] == r["base_score"] and r["n_known"] == r["train_tokens"] == 0 for r in unlearned)


def test_key_filter_holds_no_key_back(spark):
    rng = np.random.default_rng(8)
    for count in (0, 10, 40_000):
        keys = rng.integers(-(1 << 63), (1 << 63) - 1, count)
        bits = _sketch.key_filter(spark.createDataFrame([(int(k),) for k in keys], "k bigint"), count)
        others = rng.integers(0, 1 << 64, 20_000, np.uint64)
        assert _sketch.passes(bits, keys.view(np.uint64)).all() and _sketch.passes(bits, others).mean() < 0.03


def test_registered_lm_equals_a_plain_tree(spark, sf):
    """``op7_lm_score`` itself, on all documents and with production parameters."""
    tokens = {r["doc_id"]: [*plain.words(r["text"]), None] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tree = plain.SuffixTree([w for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2], lm.DEPTH, lm.LEAST_CONTEXT, lm.LEAST_NEXT, lm.PRIOR)
    assert len(tree.states) > 50
    rows = QUERIES["op7_lm_score"](spark, sf).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        assert math.isclose(r["score"], tree.score(tokens[r["doc_id"]], lm.DEPTH), rel_tol=1e-9)


def test_lm_beats_single_words_on_held_out_documents(spark, sf):
    held = QUERIES["op7_lm_score"](spark, sf).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] >= held["b"]


def test_packing(spark, docs, none):
    rows = pack(docs, TOKENIZER, open_windows=4).collect()
    check_pieces(rows, TEXTS)
    assert len(pack(docs.unionByName(spark.createDataFrame(REPEATED, SCHEMA)), TOKENIZER).select("doc_id", "start").collect()) >= len(TEXTS) + 2
    assert pack(none, TOKENIZER).collect() == []


def check_pieces(rows, texts):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        ids = plain.ids(texts[i], 1)
        parts.sort(key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in parts) == np.asarray(ids, "<u4").tobytes() and all(r["doc_tokens"] == len(ids) for r in parts)
        assert [r["start"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist()
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist() and sum(r["length"] for r in parts) <= 2048


def test_best_fit_keeps_a_bounded_number_of_windows():
    rng, fit = random.Random(2), BestFit(100, 5)
    for _ in range(500):
        fit.place(rng.randrange(1, 100))
        assert len(fit.open) <= 5


def test_token_files(spark, docs, none):
    folder, manifest = write_token_files(docs, TOKENIZER, file_ids=5000)
    assert manifest.count() > 3
    at = 0
    for r in read_token_files(spark, folder, manifest).orderBy("doc_id").collect():
        ids = plain.ids(TEXTS[r["doc_id"]], 2)
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(ids), np.asarray(ids, "<u4").tobytes())
        at += len(ids)
    every = [x for i in sorted(TEXTS) for x in plain.ids(TEXTS[i], 2)]
    for lo, hi in ((0, at), (4990, 5010), (17, 18), (12_000, 40_000), (at, at + 5), (7, 7)):
        pieces = sorted(tuple(r) for r in read_range(spark, folder, manifest, lo, hi).collect())
        assert np.frombuffer(b"".join(bytes(x) for _, x in pieces), "<u4").tolist() == every[lo:hi]
    assert read_token_files(spark, *write_token_files(none, TOKENIZER)).collect() == []
    more = read_token_files(spark, *write_token_files(docs.unionByName(spark.createDataFrame(REPEATED, SCHEMA)), TOKENIZER))
    assert more.count() == len(TEXTS) + 2 and more.where("doc_id is null").first()["start"] == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype("<u4")
    assert (unpack_bits(pack_bits(ids, bits), bits, 1001) == ids).all() and len(pack_bits(ids, bits)) == -(-1001 * bits // 8)
    found = TokenFile(to_file([1, None, 3], [ids[:10].tobytes(), b"", ids[10:].tobytes()], bits, 64))
    assert found.docs == [1, None, 3] and (found.document(2) == ids[10:]).all() and (found.ids(60, 70) == ids[60:70]).all() and not len(found.document(1))


def test_encoder_equals_the_library():
    texts = ["a  b", " x", "a\n b ", "<|endoftext|> q", " \n z \n", "a \n b\n\n c ", "", "it's  été 漢字\u3000x", *(t or "" for t in TEXTS.values())]
    code = Encoder(TOKENIZER)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in code.encode(texts)] == [plain.ids(t, 0)[:-1] for t in texts]


def test_top_k(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(8)]) for k in range(300)]
    rows += [(300 + k, rows[7][1]) for k in range(60)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (450, [float("inf")] * 8), (None, rows[1][1]), (500, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    good = {i: [math.floor(256 * x) for x in np.asarray(v, np.float32).astype(float)] for i, v in rows if i is not None and i not in (400, 401, 402, 450)}
    expected = {}
    for q in (i for i in good if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v, strict=False)), i) for i, v in good.items() if i != q)
        expected[q] = [(i, -s) for s, i in scores[:5]]
    found = {}
    monkeypatch.setattr(topk, "GROUP_BYTES", 3 * 40 * 8 * 8)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, most_pivots=6, block_rows=40).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == expected
    clash = df.selectExpr("vec_id", "embedding", "1 AS id", "2 AS v", "3 AS asks", "4 AS cell")
    twice = clash.unionByName(clash.where("vec_id = 50"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(twice, F.col("vec_id") % 50 == 0).collect()}
    many = {q: sorted([(-sum(a * b for a, b in zip(good[q], v, strict=False)), i) for i, v in [*good.items(), (50, good[50])] if i != q])[:5] for q in expected}
    assert got == {(q, k + 1): (i, -s) for q, x in many.items() for k, (s, i) in enumerate(x)}
    assert topk.top_k(df.where("false"), F.lit(True)).collect() == []
    assert topk.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_blocks_are_taken_by_bound():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (600, 4))
    far = np.argsort(-x[:, 0], kind="stable")
    near = topk.Nearby(4)
    for b in range(6):
        own = far[b * 100 : b * 100 + 100]
        near.add(b, own.tolist(), [x[o].tobytes() for o in own])
    queries = np.array([[9, 0, 0, 0], [-9, 1, 0, 0], [1, 1, 1, 1]])
    bounds = [[float((queries[r] @ x[far[b * 100 : b * 100 + 100]].T).max()) for b in range(6)] for r in range(3)]
    found = near.solve(queries, [-1, -1, int(far[0])], [list(range(6))] * 3, bounds, 5)
    for q, own, best in zip(queries, (-1, -1, int(far[0])), found, strict=True):
        assert best == sorted((-int(s), i) for i, s in enumerate(x @ q) if i != own)[:5]
    assert near.compared < 3 * 600


def test_top_k_leaves_cells_out():
    """Vectors in clusters need few cells; without structure bounds exclude none. No needed cell is ever left out."""
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 200, (40, 16))
    clustered = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 15, (4000, 16))).astype(np.int64)
    flat = np.floor(rng.normal(0, 60, (4000, 16))).astype(np.int64)
    shares = []
    for x in (clustered, flat):
        chosen = topk.far_apart(x[:2000], 63)
        cells = topk.Cells(chosen, x[chosen], *[np.zeros(0)] * 4)
        cell, far = cells.nearest(x)
        low, high = (np.stack([f(x[cell == c], axis=0) for c in range(63)]) for f in (np.min, np.max))
        cells = topk.Cells(chosen, x[chosen], np.bincount(cell, minlength=63), np.asarray([far[cell == c].max() for c in range(63)]), low, high)
        q = np.arange(0, 4000, 20)
        need = cells.needed(x[q], q, 5)
        scores = x[q] @ x.T
        scores[np.arange(len(q)), q] = -(1 << 60)
        top = np.argsort(-scores, axis=1, kind="stable")[:, :5]
        assert need[np.arange(len(q))[:, None], cell[top]].all()
        shares.append(need.mean())
        blocks = topk.blocks_of(np.bincount(cell, minlength=63), x[chosen], 150)
        room = Counter()
        for c, (first, parts) in enumerate(blocks):
            room.update({b: (cell == c).sum() / parts for b in range(first, first + parts)})
        assert max(room.values()) <= 150 and set(room) == set(range(len(room)))
    assert shares[0] < 0.1


def test_url_filter(spark):
    rules = rule_table(spark, [("allow", "org", "/"), ("block", "Example.org", "/es/"), ("block", "example.org", "/en/1"), ("block", "a.b", ""), ("allow", "b", "/x"), ("block", None, "/")])
    cases = {
        "https://WWW.Example.org/es/x": ("www.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/12?q#f": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://myexample.org/es/": ("myexample.org", "/es/", "org/", "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "x://a.b/x#": ("a.b", "/x", "a.b", "block"),
        "x://c.b/x": ("c.b", "/x", "b/x", "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "http://" + "a." * 500 + "org/" + "p" * 5000: ("a." * 500 + "org", "/" + "p" * 5000, "org/", "allow"),
    }
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate([*cases, *cases])], "page_id bigint, url string, host string, verdict string")
    found = url_filter(pages, rules).collect()
    urls = [*cases, *cases]
    assert len(found) == len(urls) and all((r["host"], r["path"], r["rule"], r["verdict"]) == cases[urls[r["page_id"]]] for r in found)
    assert url_filter(pages.where("false"), rules).collect() == [] and {r["verdict"] for r in url_filter(pages, rules.where("false"), default="block").collect()} == {"block"}


def test_linked_sets_share_a_key():
    """Whatever is rare and however large the sets are; and a set has few keys for each n-gram that may miss."""
    rng = np.random.default_rng(1)
    for num, den in ((90, 100), (80, 100), (50, 100)):
        for _ in range(150):
            n = int(rng.integers(12, 300)) if rng.random() < 0.8 else int(rng.integers(300, 2500))
            both = rng.integers(0, 1 << 64, n, np.uint64)
            spare = (n * den // num - n) // 2
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 64, int(k), np.uint64)])) for k in (spare, spare))
            if n * den < num * (len(a) + len(b) - n):
                continue
            counts, every = np.zeros(_sketch.SKETCH_SLOTS, np.int64), np.union1d(a, b)
            counts[(every >> jaccard._SHIFT).astype(int)] = np.where(rng.random(len(every)) < rng.random(), rng.integers(65, 999, len(every)), rng.integers(1, 65, len(every)))
            keys = [jaccard.index_keys(x, counts, 64, num, den) for x in (a, b)]
            assert len(np.intersect1d(*keys)) and max(map(len, keys)) < 20 * (2 + len(a) * (den - num) // den)


def test_license_scan(spark):
    rows = [
        (1, "/a/LICENSE", "Released under the MIT License."), (2, "/a/x.py", "code\nmore"), (3, "/a/b/c.py", None), (4, "/a/b/d.py", "licensed under the apache license, version 2.0.\nx = 1"),
        (5, "/z.py", ""), (6, None, "All rights reserved."), (None, "/a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (3, "/a/b/c.py", None), (7, "/q/long.py", "license " * 5000),
    ]
    df = spark.createDataFrame(rows, "id bigint, path string, text string").withColumn("license", F.lit("clash"))
    found = {(r["id"], r["path"]): (r["license"], r["origin"], r["directory"]) for r in license_scan(df, "id", "path", "text").collect()}
    assert found[1, "/a/LICENSE"] == ("MIT", "file", None) and found[2, "/a/x.py"] == ("MIT", "inherited", "/a") and found[3, "/a/b/c.py"] == ("GPL-3.0", "inherited", "/a/b")
    assert found[4, "/a/b/d.py"][:2] == ("Apache-2.0", "header") and found[5, "/z.py"] == (None, None, None) and found[6, None][:2] == ("Proprietary", "header")
    assert license_scan(df, "id", "path", "text").count() == len(rows) and license_scan(df.where("false"), "id", "path", "text").collect() == []


MIT = """MIT License

Copyright (c) 2024 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

      "Licensor" shall mean the copyright owner or entity authorized by
      the copyright owner that is granting the License.

      "Legal Entity" shall mean the union of the acting entity and all
      other entities that control, are controlled by, or are under common
      control with that entity.
"""
GPL = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

  The licenses for most software and other practical works are designed
to take away your freedom to share and change the works.
"""
HEADER = """#!/bin/sh
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
echo done
"""


def test_license_texts_and_wrapped_headers(spark):
    code = "\n".join(f"x{k} = f(y{k}, z)  # the {k}th of them" for k in range(80))
    rows = [
        (1, "/m/LICENSE", MIT), (2, "/m/a/b.c", "int x;"), (3, "/p/LICENSE.txt", APACHE), (4, "/p/q/r.py", code), (5, "/g/COPYING", GPL), (6, "/g/x", None),
        (7, "/s/run.sh", HEADER + code), (8, "/s/other.sh", code), (9, "/s/gpl.c", "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
        " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version. */\n" + code), (10, "/t/LICENSE", "Permission is required here.\nThe rights are free of charge."),
        (11, "/b/LICENSE", "\n".join(NOTICES["BSD-2-Clause"])), (12, "/b/c/d", "x"),
    ]
    rows += [(100 + k, f"/z/{k}", f"the river and the house of {k} in software for any use\n" * 3) for k in range(40)]
    found = {r["id"]: (r["license"], r["origin"], r["directory"]) for r in license_scan(spark.createDataFrame(rows, "id bigint, path string, text string"), "id", "path", "text").collect()}
    assert found[1][0] == "MIT" and found[2] == ("MIT", "inherited", "/m")
    assert found[3][0] == "Apache-2.0" and found[4] == ("Apache-2.0", "inherited", "/p")
    assert found[5][0] == "GPL-3.0" and found[6] == ("GPL-3.0", "inherited", "/g")
    assert found[7] == ("Apache-2.0", "header", None) and found[8] == (None, None, None) and found[9][:2] == ("GPL-3.0", "header")
    assert found[10] == (None, None, None) and found[11][0] == "BSD-2-Clause" and found[12] == ("BSD-2-Clause", "inherited", "/b")
    assert all(found[100 + k] == (None, None, None) for k in range(40))
    both = [(1, "/d/LICENSE", "Released under the MIT License."), (2, "/d/COPYING", "Licensed under CC BY-NC 4.0."), (3, "/d/x", "")]
    tied = {r["id"]: r["license"] for r in license_scan(spark.createDataFrame(both, "id bigint, path string, text string"), "id", "path", "text").collect()}
    assert tied[3] == "CC-BY-NC-4.0"  # of notices that are equally near the longer one counts


def test_license_scan_weighs_terms_by_their_document_frequency(spark):
    lines = {100: "Released and licensed under the MIT License.", 101: "All rights in it are reserved.", 102: "Zq xw released vb under the MIT License."}
    texts = {k: f"x{k} and the river\nin it are" for k in range(60)} | {k: f"x{k}\n{t}\nrest {k}" for k, t in lines.items()} | {200: lines[100]}
    split = lambda t: Counter(re.findall("[a-z0-9]+", t.lower()))
    df = Counter(t for x in texts.values() for t in split(x))
    idf = {t: math.log((len(texts) + 1) / (df[t] + 1)) + 1 for t in {*df, *split(" ".join(t for texts in NOTICES.values() for t in texts))}}

    def cosine(a, b):
        a, b = ({t: k * idf[t] for t, k in split(x).items()} for x in (a, b))
        return sum(w * b.get(t, 0) for t, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))

    rows = [(k, f"/{k}/LICENSE" if k == 200 else f"/{k}/x.py", t) for k, t in texts.items()]
    found = {r["id"]: r for r in license_scan(spark.createDataFrame(rows, "id bigint, path string, text string"), "id", "path", "text").collect()}
    for k, line in {**lines, 200: lines[100]}.items():
        score, name = max((cosine(line, notice), name) for name, notices in NOTICES.items() for notice in notices)
        assert (found[k]["license"], found[k]["origin"]) == ((name, "file" if k == 200 else "header") if score >= 0.7 else (None, None))
        assert score < 0.7 or abs(found[k]["score"] - score) < 2e-6
    assert found[100]["license"] == "MIT" and found[101]["license"] == "Proprietary" and found[5]["license"] is None


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, duck, sf, name):
    same(QUERIES[name](spark, sf), duck.execute(ORACLES[name]))


def test_pipeline(spark, sf, tmp_path):
    """Each stage against a plain version of it on its own input."""
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in odd_rows()]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    leak = " ".join(TEXTS[26].split()[5:40])
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = [TEXTS]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
    lettered = {i for i, t in TEXTS.items() if any(c.isalpha() for c in t or "")}
    assert lettered - set(texts[1]) <= {9} and set(texts[1]) <= lettered  # 9 is in no language of the others
    groups = plain.jaccard_groups(texts[1], 5, 80)
    assert set(texts[2]) == {i for i, (_, c) in groups.items() if c == i}
    kept = plain.substring_dedup(texts[2])
    assert {i: plain.words(t, fold=False) for i, t in texts[3].items()} == {i: w for i, w in kept.items() if w}
    assert set(texts[4]) == set(texts[3]) - {i for i, _ in plain.contaminated(texts[3], {1: leak})} and 26 not in texts[4]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sum(r["length"] for r in pieces) == sum(len(plain.ids(t, 1)) for t in texts[4].values()) and len(corpus_pipeline.run(spark, folder).collect()) == len(pieces)


def stage_input(spark, folder, rows, schema, items):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Rows are dropped one by one: null, repeated and shared ids lose no text and keep no copy; names of columns don't matter."""
    rng, folder = random.Random(21), str(tmp_path / "a")
    one, two, three, leak = (sentence(rng, 90, 10**6) for _ in range(4))
    passage = sentence(rng, 60, 10**6)
    texts = [(1, one), (5, one), (5, two), (None, one), (None, three), (7, three), (7, three), (None, leak), (8, leak), (8, sentence(rng, 30, 10**6)), (9, None), (9, ""), (None, None)]
    ends = [sentence(rng, 25, 10**6) for _ in range(3)]
    texts += [(20, f"{passage} {ends[0]}"), (21, f"start {passage} {ends[1]}"), (None, f"{passage} {ends[2]}")]
    clash = "n_removed int, row string, file bigint, at bigint, k bigint, may boolean, key string, start int, n_words int, doc string, seq string, words string"
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {clash}"
    rows = [(i, t, "en", "s", len(t or ""), k, f"r{k}", 1, 2, 3, True, "x", 4, 5, "d", "q", "w") for k, (i, t) in enumerate(texts)]
    docs = stage_input(spark, folder, rows, schema, [(1, leak), (1, leak), (None, None)])
    of = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)

    near = stages["ngram_jaccard"](spark, docs, folder)
    assert near.columns == docs.columns
    gone = Counter([(5, one), (None, one), (None, three), (7, three), (None, leak)])
    assert of(near) == Counter(texts) - gone
    marks = {r["n_removed"]: (r["doc_id"], r["text"]) for r in near.collect()}
    assert all(texts[k] == x for k, x in marks.items())

    cut = stages["substring_dedup"](spark, docs.where("doc_id >= 20 or doc_id is null"), folder)
    assert cut.columns == docs.columns and cut.schema["n_chars"] == docs.schema["n_chars"]
    found = {r["n_removed"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert found[14] == (f"start {ends[1]}", 6 + len(ends[1])) and found[15][0] == texts[15][1] and found[13][0] == texts[13][1]

    clean = stages["decontamination"](spark, docs, folder)
    assert of(clean) == Counter(texts) - Counter([(None, leak), (8, leak)]) and clean.columns == docs.columns

    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä"
    house = "the house by the river is old and the way to the house is long and the people of the town go that way each day"
    odd = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(80)), " ".join(f"{rng.getrandbits(64):016x}" for _ in range(60)), finnish, "12 34 !!", "", None]
    learned = [(k, f"{house} {k} and {' '.join(rng.sample(house.split(), 12))}", "en", "s", 1) for k in range(40)]
    folder = str(tmp_path / "b")
    talk = stage_input(spark, folder, learned + [(None, house, None, "s", 1), (3, house, None, "s", 1)] + [(100 + k, t, None, "s", 1) for k, t in enumerate(odd)], "doc_id bigint, text string, lang string, source string, n_chars bigint", [(1, leak)])
    kept = of(stages["language_id"](spark, talk, folder))
    assert kept == Counter((r[0], r[1]) for r in learned) + Counter([(None, house), (3, house)])

    folder = str(tmp_path / "c")
    none = stage_input(spark, folder, [], schema, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.collect() == [] and (name == "packing" or out.columns == none.columns)
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_packing_leaves_little_padding(spark, sf):
    """Over several merging groups: whole sequences but for one in a hundred tokens, and no gap before a sequence's end."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(70)
    rows = pack(docs, TOKENIZER, open_windows=4).select("sequence_id", "length", "offset").collect()
    filled = Counter()
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    total = sum(filled.values())
    padded = sum(2048 - n for n in filled.values() if n & (n - 1))
    assert max(filled.values()) <= 2048 and padded <= 0.02 * total + 3 * 2048


def test_registered_queries_against_plain_versions(spark, sf):
    """Checksums and digests of the queries themselves, on all documents."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op9_substring_dedup"](spark, sf).collect():
        texts[r["doc_id"]] = (texts[r["doc_id"]], r["n_words"], r["n_removed"], r["kept_sha256"])
    kept = plain.substring_dedup({i: t[0] for i, t in texts.items()})
    for i, (text, n, removed, digest) in texts.items():
        assert (n, n - removed, digest) == (len(plain.words(text, fold=False)), len(kept[i]), plain.sha(kept[i]))
    groups, links = plain.jaccard_groups({i: t[0] for i, t in texts.items()}), plain.jaccard_links({i: t[0] for i, t in texts.items()})
    for r in QUERIES["op5_ngram_jaccard"](spark, sf).collect():
        assert (r["n_shingles"], r["component_id"], r["n_links"]) == (*groups[r["doc_id"]], links[r["doc_id"]])
    at = 0
    for r in QUERIES["op10_token_files"](spark, sf).orderBy("doc_id").collect():
        ids = plain.ids(texts[r["doc_id"]][0], 2)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), plain.crc(ids))
        at += len(ids)
    pieces = QUERIES["op6_packing"](spark, sf).collect()
    for r in pieces:
        ids = plain.ids(texts[r["doc_id"]][0], 1)
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == plain.crc(ids[r["start"] : r["start"] + r["length"]])
    assert sum(r["length"] for r in pieces) == sum(len(plain.ids(t[0], 1)) for t in texts.values())
