"""Rows that must not be lost, names that must not collide, and directories that cover everything."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.operators import actions, dedup, ledger, policy, scan


def test_rows_without_a_volume_stay(spark):
    schema = "id int, volume_id bigint, size bigint, actual bigint, actual_known boolean"
    rows = [(1, None, 10, 0, True), (2, None, 10, 5, True), (3, 7, 10, 0, True), (4, 7, 10, 4, True), (5, 8, 10, 0, True), (6, 8, 10, None, None)]
    got = {r["id"]: r["disk_bytes"] for r in scan.with_actual_bytes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 10, 2: 5, 3: 0, 4: 4, 5: 10, 6: 10}


def test_files_of_unknown_resolution_stay(spark):
    rows = [(1, "/a", 5, 1, 1, True), (2, "/b", 5, 1, 1, True), (3, "/c", 5, 1, 1, None), (4, "/d", 5, None, None, False)]
    df = spark.createDataFrame(rows, "id int, path string, size bigint, volume_id bigint, file_index bigint, resolved boolean")
    assert {r["id"] for r in dedup.collapse_identity(df).collect()} == {1, 3, 4}


def test_operations_without_items_are_finalised(spark):
    ops = spark.createDataFrame([(1, "delete"), (2, "move"), (3, "trash")], "op_id bigint, op_kind string")
    items = spark.createDataFrame([(1, "done", 9, False), (1, "planned", 5, False), (2, "done", 7, True), (2, "done", 8, False)], "op_id bigint, state string, size bigint, cross_volume boolean")
    got = {r["op_id"]: tuple(r)[1:] for r in ledger.finalised(ops, items).collect()}
    assert got == {1: (1, 1, 9), 2: (2, 0, 7), 3: (0, 0, 0)}


def test_first_chosen_keeper_in_path_order(spark):
    members = spark.createDataFrame([(1, 5, "/b"), (1, 3, "/c"), (1, 9, "/a"), (2, 4, "/d")], "group_id bigint, id bigint, path string")
    g = spark.createDataFrame([(1, 9), (2, 4)], "group_id bigint, keeper bigint")
    chosen = spark.createDataFrame([(1, 5), (1, 3), (2, 5), (1, 5)], "group_id bigint, keep_id bigint")
    assert {r["group_id"]: r["keep_id"] for r in policy.keepers(g, chosen, members).collect()} == {1: 5, 2: 4}


def test_cleaned_paths(spark):
    cases = {"/a//b/./c/": "/a/b/c", "/": "/", "//": "/", "/a/../b": "/b", "/../x": "/x", "a/./b/..": "a", "../x/..": "..", "./": "", "/a/..": "/", "": "", "/...": "/..."}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r["p"]: r["c"] for r in df.select("p", paths.cleaned(F.col("p")).alias("c")).collect()} == cases


def test_the_root_holds_everything(spark):
    files = spark.createDataFrame([(1, "/a/x"), (2, "/b/c/y"), (3, "/z")], "id bigint, path string")
    dirs = lambda *d: spark.createDataFrame(list(enumerate(d)), "dir_ord int, dir string")
    held = lambda d: {r["id"]: r["dir"] for r in scan.in_dirs(files, scan.distinct_dirs(d)).collect()}
    assert held(dirs("/b//c/", " / ", "", "  ")) == {1: "/", 2: "/b/c", 3: "/"}
    assert held(dirs("/b/./c/../c", "/a/")) == {1: "/a", 2: "/b/c"}
    assert [(r["dir_ord"], r["dir"]) for r in scan.distinct_dirs(dirs("/x/", "/x//", "/x", "/X")).orderBy("dir_ord").collect()] == [(0, "/x"), (3, "/X")]
    targets = files.select("id", F.col("path").alias("landing"))
    granted = lambda *d: {r["id"] for r in actions.landings(targets, dirs(*d)).where("granted").collect()}
    assert granted("/") == {1, 2, 3} and granted("", " ") == set() and granted("/b/c/") == {2}
    roots = spark.createDataFrame([("/",), ("/a//",), ("/a/b",), ("/ab",)], "root string")
    covered = lambda df: {r["root"]: r["covered_by"] for r in scan.normal_roots(df).collect()}
    assert covered(roots) == {"/": None, "/a": "/", "/a/b": "/", "/ab": "/"}
    assert covered(roots.where("root <> '/'")) == {"/a": None, "/a/b": "/a", "/ab": None}


def test_case_by_directory_and_by_root(spark):
    files = spark.createDataFrame([(1, "/Mac/Photos/a"), (2, "/lin/Photos/a"), (3, "/mac/photos/b")], "id bigint, path string")
    dirs = spark.createDataFrame([(0, "/mac/PHOTOS", True), (1, "/MAC/photos/", True), (2, "/lin/photos", False), (3, "/Lin/photos", None)], "dir_ord int, dir string, fold boolean")
    clean = scan.distinct_dirs(dirs)
    assert sorted(r["dir_ord"] for r in clean.collect()) == [0, 2, 3]
    assert {r["id"]: r["dir"] for r in scan.in_dirs(files, clean).collect()} == {1: "/mac/PHOTOS", 3: "/mac/PHOTOS"}
    f = scan.Filters(exclude=["photos"], fold=[0])
    df = spark.createDataFrame([(1, 0, "Photos/a"), (2, 1, "Photos/a"), (3, 1, "photos/a")], "id int, root int, rel string").withColumns({"path": F.col("rel"), "name": F.lit("a"), "ext": F.lit(""), "size": F.lit(1)})
    keep = f.column(F.col("rel"), F.col("path"), F.col("name"), F.col("ext"), F.col("size"), F.col("root"))
    assert {r["id"] for r in df.where(keep).collect()} == {2}


def test_roots_of_an_import(spark):
    scans = spark.createDataFrame([(1, '["/home/", "D:\\\\data\\\\"]'), (2, "[broken"), (3, None), (4, "[]"), (5, '["", "/srv"]')], "id bigint, roots string")
    roots = ledger.local_roots(scans)
    assert {r["root"] for r in roots.collect()} == {"/home", "D:/data", "/srv"}
    files = spark.createDataFrame([("E:\\kept\\f",), (None,), ("",)], "path string")
    known = ledger.known_paths(files, spark.createDataFrame([("/opt/seen/",)], "orig_path string"))
    assert {r["path"] for r in known.collect()} == {"E:/kept/f", "/opt/seen"}
    cases = {1: "/home/me/x", 2: "/homestead/x", 3: "D:\\data\\y", 4: "E:/kept/f", 5: "/opt/seen", 6: "relative/x", 7: "D:data", 8: "/srv"}
    ops = spark.createDataFrame([(k, True) for k in cases], "op_id int, undoable boolean")
    items = spark.createDataFrame([(k, p, "done") for k, p in cases.items()], "op_id int, orig_path string, state string")
    assert {r["op_id"] for r in ledger.downgraded(ops, items, roots, known).where("undoable").collect()} == {1, 3, 4, 5, 8}
    assert ledger.downgraded(ops, items, spark.createDataFrame([("/home/",)], "root string"), known.limit(0)).where("undoable").count() == 1


def test_natural_keys_with_nulls(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "b", 1), (4, None, None), (5, "c", None)], "id bigint, x string, y int")
    known = spark.createDataFrame([("a", None), (None, None)], "x string, y int")
    assert {r["id"] for r in ledger.natural_keys(rows, ["x", "y"], known).collect()} == {3, 5}
    assert {r["id"] for r in ledger.natural_keys(rows, ["x", "y"], known.limit(0)).collect()} == {1, 2, 3, 5}


def plain_names(wanted, taken):
    by, out, shut = defaultdict(list), {}, defaultdict(set)
    for folder, name in taken:
        shut[folder].add(name)
    full = {f: shut[f] | {n for g, n, _ in wanted if g == f} for f in {w[0] for w in wanted}}
    for folder, name, k in sorted(wanted, key=lambda w: w[2]):
        by[folder, name].append(k)
    for (folder, name), ids in by.items():
        base, ext = re.sub(r"\.[^.]*$", "", name), (re.search(r"\.[^.]*$", name) or [""])[0]
        n = 0
        for i, k in enumerate(ids):
            if i == 0 and name not in shut[folder]:
                out[k] = name
                continue
            n += 1
            while f"{base}_{n}{ext}" in full[folder]:
                n += 1
            out[k] = f"{base}_{n}{ext}"
    return out


def test_free_names_never_collide(spark):
    rng = random.Random(4)
    names = ["a.txt", "a_1.txt", "a_2.txt", "a_1_1.txt", "a", "a_1", ".a", "a.", "a_01.txt", "a_0.txt", "b.tar.gz"]
    wanted = [(f"/f{rng.randrange(3)}", rng.choice(names), k) for k in range(120)] + [("/g", "a.txt", 500), ("/g", "a.txt", 501), ("/g", "a_1.txt", 502)]
    taken = [(f"/f{rng.randrange(4)}", rng.choice(names)) for _ in range(12)] + [("/f0", f"a_{k}.txt") for k in range(3, 9)]
    got = ledger.numbered_names(spark.createDataFrame(wanted, "folder string, name string, id bigint").repartition(5), spark.createDataFrame(taken, "folder string, name string")).collect()
    assert {r["id"]: r["free_name"] for r in got} == plain_names(wanted, taken)
    placed = [(r["folder"], r["free_name"]) for r in got]
    assert len(set(placed)) == len(wanted) and not set(placed) & set(taken)
    alone = ledger.numbered_names(spark.createDataFrame(wanted[-3:], "folder string, name string, id bigint")).collect()
    assert {r["id"]: r["free_name"] for r in alone} == {500: "a.txt", 501: "a_2.txt", 502: "a_1.txt"}


def test_keep_lists_lose_what_is_gone(spark):
    scans = spark.createDataFrame([(1, '["/a","/b","/c"]', "x"), (2, '["/a"]', "y"), (3, "broken", "z"), (4, None, "w"), (5, '["/b"]', "v")], "id bigint, keep_paths string, roots string")
    gone = spark.createDataFrame([(1, "/b"), (1, "/b"), (2, "/a"), (3, "/a"), (5, "/x")], "hist_id bigint, path string")
    got = {r["id"]: (r["keep_paths"], r["roots"]) for r in ledger.kept_paths(scans, gone).collect()}
    assert got == {1: ('["/a","/c"]', "x"), 2: ("[]", "y"), 3: ("broken", "z"), 4: (None, "w"), 5: ('["/b"]', "v")}


def test_deleting_scans_takes_their_rows_along(spark):
    tables = {
        "scan_history": spark.createDataFrame([(1,), (2,)], "id bigint"),
        "hist_groups": spark.createDataFrame([(10, 1), (20, 2)], "id bigint, hist_id bigint"),
        "hist_files": spark.createDataFrame([(100, 1), (200, 2), (201, 2)], "id bigint, hist_id bigint"),
        "op_records": spark.createDataFrame([(7, 1)], "id bigint, hist_id bigint"),
        "op_items": spark.createDataFrame([(70, 7)], "id bigint, op_id bigint"),
    }
    sizes = lambda t: [t[n].count() for n in ("scan_history", "hist_groups", "hist_files", "op_records", "op_items")]
    assert sizes(ledger.without_scans(tables, spark.createDataFrame([(1,), (1,), (9,)], "id bigint"))) == [1, 1, 2, 1, 1]
    assert sizes(ledger.without_scans(tables)) == [0, 0, 0, 1, 1] and sizes(ledger.without_operations(tables)) == [2, 2, 3, 0, 0]
