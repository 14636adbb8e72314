"""Tables of cases and invariants for the reference's own operators."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.functions import classify, paths
from tessella.operators import cache, dedup, policy, scan
from tessella.sources import corpus, tree

PATTERNS = [
    ("a/b/*", "a/b/c", True), ("a/b/*", "a/b/c/d", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/b", True), ("a/**/b", "a/x/y/b", True), ("a/**/b", "a/x", False),
    ("build/**", "build/x/y/f.o", True), ("build/**", "src/build/f.o", False), ("a/b", "a/b", True), ("a/b", "a/b/c/d", True), ("a/b", "a/bc/d", False), ("a/*", "a/x", True),
    ("a/*", "a/x/y", False), ("*.tmp", "x/y.tmp", True), ("node_modules", "p/node_modules/q.js", True), ("[z-", "[z-", False),
    ("[z-a]", "z", False), ("[^z-a]", "z", True), ("[[]x", "[x", True), ("a/[[]", "a/[", True), ("[&&a]", "&", True), ("[a-c&&b]", "c", True), ("[!]x", "!x", True), ("[^b]", "a", True), ("[^b]", "b", False),
    ("p[x-z]q", "pyq", True), ("a/[^x]/c", "a/b/c", True), ("[]a]", "a", False), ("[a-]", "a", False), ("[.]", "q", False), ("[^", "^", False),
]


def test_patterns(spark):
    for pattern, rel, expected in PATTERNS:
        found = spark.range(1).select(paths.excluded(pattern, F.lit(rel)).alias("x")).first()["x"]
        assert found is expected, (pattern, rel)


def test_bad_patterns():
    legal = ["[z-a]", "[[]x", "a/[[]", "[!]a]", "[^a-c]", "[a^]", "x[0-9a-f]y"]
    bad = ["[", "a/[/b", "*[", "x/**/[", "[]a]", "a[b/c]d", "[a-]", "[-a]", "[^]", "[a"]
    assert not [p for p in legal if paths.bad_pattern(p)] and all(map(paths.bad_pattern, bad))


def test_keep_policies(spark):
    rows = [(1, 1, "/a/.x/f", 5), (1, 2, "/a/long/f", 9), (1, 3, "/b/longer/f", 1), (2, 4, "/.h", 1), (2, 5, "/.hh", 1)]
    members = spark.createDataFrame(rows, "group_id bigint, id bigint, path string, mtime_ns bigint")
    kept = lambda kind: {r["group_id"]: r["keep_id"] for r in policy.keep(members, kind).collect()}
    assert kept("shortest") == kept("default") == kept("no such kind") == {1: 2, 2: 4}
    assert kept("newest") == {1: 2, 2: 4} and kept("oldest") == {1: 3, 2: 4} and kept("manual") == {}
    g = spark.createDataFrame([(1, 2), (2, 4), (3, 9)], "group_id bigint, keeper bigint")
    chosen = spark.createDataFrame([(1, 3), (1, 1), (2, 1), (3, None)], "group_id bigint, keep_id bigint")
    assert {r["group_id"]: r["keep_id"] for r in policy.keepers(g, chosen, members).collect()} == {1: 1, 2: 4, 3: 9}


def test_filters_bounds_are_inclusive_and_zero_is_off(spark):
    df = spark.createDataFrame([("a.txt", 10), ("b.TXT", 20), (".c.txt", 20), ("d", 30)], "name string, size bigint").withColumn("path", F.concat(F.lit("/r/"), "name")).withColumn("ext", paths.extension(F.col("name")))
    keep = lambda f: {r["name"] for r in df.where(f.column(F.col("name"), F.col("path"), F.col("name"), F.col("ext"), F.col("size"))).collect()}
    assert keep(scan.Filters(10, 20)) == {"a.txt", "b.TXT"}
    assert keep(scan.Filters(hidden=True)) == {"a.txt", "b.TXT", ".c.txt", "d"}
    assert keep(scan.Filters(include_ext=["Txt "])) == {"a.txt", "b.TXT"}
    assert scan.Filters(exclude=["ok", "[z-"]).rejects() == [("[z-", "exclude")]


def test_staged_detection_equals_direct_grouping(spark):
    files = corpus_files(spark)
    naive = defaultdict(list)
    for r in files.collect():
        if r["size"]:
            naive[hashlib.sha256(bytes(r["content"])).hexdigest()].append(r["path"])
    expected = {h: sorted(p) for h, p in naive.items() if len(p) > 1}
    found = defaultdict(list)
    for r in dedup.candidates(files, 64, 128).collect():
        found[r["hash"]].append(r["path"])
    assert {h: sorted(p) for h, p in found.items()} == expected


def corpus_files(spark):
    made = tree.corpus(spark, 200)
    return made.select(F.xxhash64("path").alias("id"), "path", F.octet_length("content").cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("mtime_ns"), F.lit(0).cast("bigint").alias("volume_id"), F.xxhash64("path").alias("file_index"), F.lit(True).alias("resolved"), F.octet_length("content").cast("bigint").alias("actual"), F.lit(True).alias("actual_known"), "content")


def test_partitions_do_not_change_the_result(spark, sf):
    g = dedup.groups(dedup.candidates(corpus.documents(spark, sf), 512, 1024))
    before = sorted(map(tuple, g.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(tuple, dedup.groups(dedup.candidates(corpus.documents(spark, sf).repartition(5), 512, 1024)).collect())) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rank_ties_go_to_the_first_path(spark):
    k = 300 * 1024
    rows = [(1, "/a1", k, "A"), (2, "/a2", k, "A"), (3, "/a3", k, "A"), (4, "/z-b1", 2 * k, "B"), (5, "/z-b2", 2 * k, "B"), (6, "/y-c1", 2 * k, "C"), (7, "/y-c2", 2 * k, "C")]
    df = spark.createDataFrame(rows, "id bigint, path string, size bigint, hash string").withColumn("actual", F.col("size")).withColumn("actual_known", F.lit(True))
    assert [(r["group_id"], r["hash"]) for r in dedup.groups(df).orderBy("group_id").collect()] == [(1, "A"), (2, "C"), (3, "B")]


def test_pages_clamp(spark):
    g = spark.createDataFrame([(i, 100, 2, 100) for i in range(1, 251)], "group_id bigint, size bigint, n_files bigint, reclaimable bigint")
    assert policy.page(g, "size", 0, 900).count() == 250 and policy.page(g, "size", 9, 100).count() == 0 and policy.page(g, "size", -1, 0).count() == 100


def test_blank_whitelist_excludes_all(spark):
    members = spark.createDataFrame([(1, "/a/x"), (2, "/b/y")], "id bigint, path string")
    chosen = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id bigint, ord int")
    none = spark.createDataFrame([], "id bigint")
    blank = spark.createDataFrame([(0, "  ")], "dir_ord int, dir string")
    assert {r["id"]: r["reason"] for r in policy.pending(chosen, members, none, blank).collect()} == {1: "outside", 2: "outside", 3: "gone"}
    assert {r["id"]: r["reason"] for r in policy.pending(chosen, members, none, None, blank).collect()} == {1: None, 2: None, 3: "gone"}


def test_upsert_arms(spark):
    schema = "path string, size bigint, mtime_ns bigint, head bigint, mid1 bigint, mid2 bigint, tail bigint, full string, last_hit bigint, dev bigint, ino bigint"
    row = lambda path, mtime, sample, full: (path, 10, mtime, sample, sample, sample, sample, full, 1, 0, 0)
    old = spark.createDataFrame([row("same", 1, 5, "f"), row("moved on", 1, 5, "f"), row("no sample", 1, 5, "f"), row("fresh", 1, 5, "f"), row("kept", 1, 5, "f")], schema)
    new = spark.createDataFrame([row("same", 1, 5, None), row("moved on", 2, 5, None), row("no sample", 1, 0, None), row("fresh", 2, 6, "g"), row("new", 1, 7, "h")], schema)
    found = {r["path"]: (r["head"], r["full"]) for r in cache.upsert(old, new).collect()}
    assert found == {"same": (5, "f"), "moved on": (5, None), "no sample": (5, "f"), "fresh": (6, "g"), "new": (7, "h"), "kept": (5, "f")}


def test_transition_matrix():
    assert sum(map(len, classify.TRANSITIONS.values())) == 20


def test_foreign_ledger(spark):
    with pytest.raises(ValueError, match="op_items.state"):
        tree.checked_ledger({k: spark.createDataFrame([], ", ".join(f"{c} string" for c in v if c != "state")) for k, v in tree.LEDGER.items()})
    for column in ("scan_history.orig_files", "scan_history.failed_json", "op_records.target_dir", "op_items.link_src"):
        table, lost = column.split(".")
        with pytest.raises(ValueError, match=column):
            tree.checked_ledger({k: spark.createDataFrame([], ", ".join(f"{c} string" for c in v if (k, c) != (table, lost))) for k, v in tree.LEDGER.items()})


def test_detail_holds_every_item(spark, sf):
    from tessella.plans.catalog import QUERIES

    assert QUERIES["ops_detail"](spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_ranks_are_those_of_one_sort(spark):
    from tessella.operators.rank import ranked, within

    rows = [(k, "big" if k % 3 else f"g{k % 40}", (k * 7919) % 50) for k in range(600)]
    df = spark.createDataFrame(rows, "id bigint, g string, v bigint").repartition(7)
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert {r["id"]: r["n"] for r in ranked(df, [F.col("v").desc(), F.col("id")], "n").collect()} == {r[0]: k + 1 for k, r in enumerate(order)}
    seen, want = defaultdict(int), {}
    for r in order:
        seen[r[1]] += 1
        want[r[0]] = seen[r[1]]
    assert {r["id"]: r["n"] for r in within(df, ["g"], [F.col("v").desc(), F.col("id")], "n").collect()} == want


def test_contents_are_asked_for_by_id(spark, sf):
    """Rows that aren't wanted are dropped by a broadcast bitmap before their content is hashed or shuffled."""
    files = corpus.documents(spark, sf)
    some = files.drop("content").where("id % 50 = 3")
    found = dedup.InTable(files)
    assert found._of(some).count() == some.count()
    for df in (found.samples(some, 512, 1024), found.hashes(some)):
        assert "content" not in "".join(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Left" in line)
    assert {r["id"]: r["hash"] for r in found.hashes(some).collect()} == {r["id"]: hashlib.sha256(bytes(r["content"])).hexdigest() for r in files.where("id % 50 = 3").collect()}


def test_deletion_records_of_both_layouts(spark):
    from tessella.functions import records

    def made(path, version=2, long=False, cut=None, extra=b""):
        text = path.encode("utf-16-le") + b"\0\0"
        head = version.to_bytes(8, "little") + (4096).to_bytes(8, "little") + (5).to_bytes(8, "little")
        return (head + (len(text) // 2).to_bytes(8 if long else 4, "little") + text + extra)[:cut]

    cases = [made("C:\\x\\é.txt"), made("C:\\long", 1, True), made("C:\\y", extra=b"\1\2\3"), made("C:\\y", version=3), made("C:\\y", cut=30), made("a\0b"), made(""), b""]
    rows = spark.createDataFrame(list(enumerate(map(bytearray, cases))), "id int, content binary").select("id", records.deletion_record(F.col("content")).alias("r")).collect()
    assert {r["id"]: r["r"] and tuple(r["r"]) for r in rows} == {0: ("C:\\x\\é.txt", 5), 1: ("C:\\long", 5), 2: ("C:\\y", 5), 3: None, 4: None, 5: None, 6: None, 7: None}


def test_importing_twice_adds_nothing_and_evidence_is_asked_for(spark, sf):
    from tessella.operators import ledger
    from tessella.plans.action_queries import _ledgers

    local, foreign = _ledgers(spark, sf)
    roots, known = spark.createDataFrame([("/v1",)], "root string"), spark.createDataFrame([], "path string")
    tables, first = ledger.merged_import(local, foreign, roots, known)
    assert first.first()["scans_added"] > 0 and first.first()["ops_added"] > 0
    again = {name: local[name].unionByName(tables[name]) for name in local}
    _, second = ledger.merged_import(again, foreign, roots, known)
    assert second.first()["scans_added"] == second.first()["ops_added"] == 0 and second.first()["ops_orphaned"] == 0
    with pytest.raises(ValueError, match="without a hash"):
        ledger.merged_import(local, foreign | {"op_items": foreign["op_items"].withColumn("hash", F.unhex(F.lit("00" * 32)))}, roots, known)


def test_json_is_one_value(spark):
    from tessella.operators import ledger

    cases = {"[]": True, '{"k": 1}': True, "1": True, '"x"': True, "null": True, '{"k": 1}}': False, "1]": False, "1}": False, "1, 2": False, '1, "b": 2': False, "": False, "[": False, "{": False, None: False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", ledger.json_valid(F.col("t")).alias("v")).collect()} == cases


def test_true_lengths(spark):
    from tessella.functions import records

    cases = [(1000, [100, 100, 100, 100], 1000), (1000, [100, 100, 40, 0], 790), (1000, [100, 0, 0, 0], 500), (1000, [30, 0, 0, 0], 30)]
    df = spark.createDataFrame([(k, s, r) for k, (s, r, _) in enumerate(cases)], "id int, size bigint, reads array<bigint>")
    assert [r["n"] for r in df.select("id", records.true_length(F.col("size"), F.col("reads"), 100).alias("n")).orderBy("id").collect()] == [x[2] for x in cases]
