"""Walks, ranged reads, hashes of ranges and comparisons on real files."""

import hashlib
import os
import random
import socket
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.functions import treehash
from tessella.operators import dedup, run
from tessella.operators.scan import Filters
from tessella.sources import contents
from tessella.sources.contents import OnDisk
from tessella.sources.walk import entries, lay_out, walk

# Published vectors: the hash of n bytes 0, 1, ..., 250, 0, 1, ...
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
    31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}


def put(folder, files):
    for name, data in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def rows(spark, folder, **sizes):
    """Metadata of the files below a folder; ``sizes`` are declared in place of the true ones, for names without their dot."""
    found = walk(spark, [str(folder)], Filters(hidden=True)).files
    size = F.col("size")
    for name, n in sizes.items():
        size = F.when(F.col("name") == name, n).otherwise(size)
    return found.withColumn("size", size.cast("bigint")).select("id", "path", "name", "size", "mtime_ns", "volume_id", "file_index", "resolved", "actual", "actual_known")


def test_walk_equals_the_system_walk(spark, tmp_path):
    rng = random.Random(1)
    names = ["a", "_b", ".c", "d e", "ü", "x#y", "p%20q", "_SUCCESS", "w.TXT"]
    put(tmp_path, {"/".join(rng.choice(names) for _ in range(rng.randrange(1, 6))) + f"/{rng.choice(names)}{k}": bytes(k % 7) for k in range(150)})
    (tmp_path / "link").symlink_to(tmp_path / "a")
    (tmp_path / "empty folder").mkdir()
    with socket.socket(socket.AF_UNIX) as s:
        s.bind(str(tmp_path / "sock"))
        found = walk(spark, [str(tmp_path)], Filters(hidden=True))
        got = {r["path"]: r for r in found.files.collect()}
    want, folders = {}, 0
    for top, dirs, files in os.walk(tmp_path):
        folders += 1
        want |= {os.path.join(top, f): os.lstat(os.path.join(top, f)) for f in [*files, *(d for d in dirs if os.path.islink(os.path.join(top, d)))]}
    assert set(got) == set(want) and found.listed == folders and len({r["id"] for r in got.values()}) == len(got)
    for path, r in got.items():
        s = want[path]
        assert (r["size"], r["mtime_ns"], r["volume_id"], r["file_index"], r["actual"]) == (s.st_size, s.st_mtime_ns, s.st_dev, s.st_ino, s.st_blocks * 512)
        assert r["rel"] == os.path.relpath(path, tmp_path) and r["name"] == os.path.basename(path) and r["root_ord"] == 0
    assert {r["kind"] for r in got.values()} == {"file", "symlink", "other"} and found.rejects.count() == 0


def test_walk_prunes_while_it_lists(spark, tmp_path):
    put(tmp_path, {"keep/f": b"1", ".git/objects/f": b"1", "node_modules/x/y/f": b"1", "keep/node_modules/f": b"1", "build/out/f": b"1", "lost+found/f": b"1", "keep/.h/f": b"1", "far/f": b"1"})
    filters = Filters(exclude=["node_modules", "build/**", "*.x/[", "keep/*/f"], exclude_dirs=[f"{tmp_path}/far/"])
    found = walk(spark, [str(tmp_path)], filters)
    assert [r["rel"] for r in found.files.collect()] == ["keep/f"] and found.listed == 2
    assert {(os.path.relpath(r["path"], tmp_path), r["reason"]) for r in found.pruned.collect()} == {(".git", "hidden"), ("node_modules", "excluded"), ("keep/node_modules", "excluded"), ("build", "excluded"), ("lost+found", "protected"), ("keep/.h", "hidden"), ("far", "excluded")}
    # a named root is entered, whatever its name, and not met again from above
    both = walk(spark, [str(tmp_path), f"{tmp_path}/keep/.h", f"{tmp_path}/keep", f"{tmp_path}//keep/"], filters)
    assert sorted((r["root_ord"], r["rel"]) for r in both.files.collect()) == [(1, "f"), (2, "f")]


def test_walk_reports_what_it_cannot_read(spark, tmp_path, monkeypatch):
    put(tmp_path, {"a/f": b"1"})
    open(os.fsencode(tmp_path) + b"/bad\xff", "wb").close()
    found = walk(spark, [str(tmp_path), f"{tmp_path}/none", f"{tmp_path}/a/f"])
    assert {(os.path.basename(r["path"]), r["reason"]) for r in found.rejects.collect()} == {("none", "FileNotFoundError"), ("f", "NotADirectoryError"), ("bad�", "UnicodeEncodeError")}
    assert found.files.count() == 1

    def denied(path):
        raise PermissionError

    monkeypatch.setattr(os, "scandir", denied)
    assert list(entries("/x")) == [("/x", "problem", *[None] * 6, "PermissionError")]


def test_hash_of_ranges_is_the_hash():
    rng = random.Random(2)
    for n, want in VECTORS.items():
        assert treehash.digest(bytes(k % 251 for k in range(n))).hex() == want
    for n in (1, 5000, 65536, 100001, 131072):
        data, total = rng.randbytes(n), treehash.chunks_of(n)
        for _ in range(4):
            cuts = sorted({0, total, *(rng.randrange(total + 1) for _ in range(4))})
            nodes = [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in treehash.range_nodes(data[a * 1024 : b * 1024], a, total)]
            rng.shuffle(nodes)
            assert treehash.combined(nodes, total) == treehash.digest(data)


def test_large_files_are_hashed_in_ranges(spark, tmp_path):
    rng = random.Random(3)
    sizes = [0, 1, 4096, 4097, 8192, 70_000, 200_000]
    put(tmp_path, {f"f{n}": rng.randbytes(n) for n in sizes})
    found = OnDisk(4096).hashes(rows(spark, tmp_path)).collect()
    for r in found:
        data = open(r["path"], "rb").read()
        assert r["problem"] is None and r["read_bytes"] == len(data)
        assert r["hash"] == (hashlib.sha256(data).hexdigest() if len(data) <= 4096 else treehash.digest(data).hex())
    with pytest.raises(ValueError):
        OnDisk(1000)


def test_a_sparse_file_beyond_two_gigabytes(spark, tmp_path):
    for name, mark in (("a", b"1"), ("b", b"1"), ("c", b"2")):
        with open(tmp_path / name, "wb") as f:
            f.truncate(5 << 30)
            f.seek((4 << 30) + 5)
            f.write(mark)
    found = OnDisk().samples(rows(spark, tmp_path)).collect()
    assert all(r["length"] == 5 << 30 and r["problem"] is None and r["read_bytes"] == 4 * 65536 for r in found) and len({r["tail"] for r in found}) == 1
    proofs = {r["name"]: r["proof"] for r in OnDisk().proofs(rows(spark, tmp_path), F.lit(4 << 30), F.lit(64)).collect()}
    assert proofs["a"] == proofs["b"] != proofs["c"]
    assert all(r["actual"] < 1 << 20 for r in rows(spark, tmp_path).collect())


def test_samples_are_those_of_a_table(spark, tmp_path):
    rng = random.Random(4)
    put(tmp_path, {f"f{n}": rng.randbytes(n) for n in (1, 100, 256, 257, 300, 511, 1000, 5000)})
    meta = rows(spark, tmp_path)
    data = spark.createDataFrame([(r["id"], bytearray(open(r["path"], "rb").read())) for r in meta.collect()], "id bigint, content binary")
    columns = ["id", "head", "mid1", "mid2", "tail", "length", "problem"]
    disk, table = OnDisk().samples(meta, 128, 256).select(columns), contents.InTable(data).samples(meta, 128, 256).select(columns)
    assert sorted(map(tuple, disk.collect())) == sorted(map(tuple, table.collect()))


def test_short_grown_and_unreadable_files(spark, tmp_path):
    put(tmp_path, {"short": b"x" * 700, "grown": b"x" * 900, "tiny": b"x" * 10, "bad": b"x", "fine": b"x" * 800})
    declared = rows(spark, tmp_path, short=1000, grown=850, tiny=40, bad=-1)
    gone = declared.limit(1).select(F.lit(-5).cast("bigint").alias("id"), F.lit(f"{tmp_path}/gone").alias("path"), F.lit("gone").alias("name"), F.lit(5).cast("bigint").alias("size"), *declared.columns[4:])
    got = {r["name"]: (r["length"], r["problem"]) for r in OnDisk().samples(declared.unionByName(gone), 100, 200).collect()}
    assert got == {"short": (750, None), "grown": (None, "grown"), "tiny": (10, None), "bad": (None, "negative"), "fine": (800, None), "gone": (None, "FileNotFoundError")}
    hashed = {r["name"]: r["problem"] for r in OnDisk().hashes(declared.where("size > 0").unionByName(gone)).collect()}
    assert hashed == {"short": "short", "grown": "grown", "tiny": "short", "fine": None, "gone": "FileNotFoundError"}


def test_only_candidates_are_opened(spark, tmp_path):
    """Unique sizes, filtered files and single paths of one file stay closed; the result is that of reading everything."""
    rng = random.Random(5)
    big = rng.randbytes(3000)
    near = big[:1490] + b"?" + big[1491:]  # the same samples
    files = {"a/big": big, "b/big": big, "c/near": near, "a/small": b"s" * 50, "_b/small": b"s" * 50, "c/other": b"t" * 50, "c/alone": rng.randbytes(777), "skip/big": big, "c/.hid": big, "d/size": rng.randbytes(3000)}
    put(tmp_path, files)
    os.link(tmp_path / "c/alone", tmp_path / "c/again")
    config = run.Config([str(tmp_path)], Filters(exclude=["skip"]), exact=True, chunk=100, small=200)
    found = walk(spark, [str(tmp_path)], config.filters)
    result = run.run(found.files, config, OnDisk())
    members = defaultdict(set)
    for r in result.members.collect():
        members[r["group_id"]].add(os.path.relpath(r["path"], tmp_path))
    assert dict(members) == {1: {"a/big", "b/big"}, 2: {"a/small", "_b/small"}}
    reads = {r["stage"]: (r["files"], r["bytes"]) for r in result.reads.collect()}
    assert reads == {"prefilter": (7, 4 * 400 + 3 * 50), "hash": (3, 9000), "verify": (4, 2 * 3000 + 2 * 50)}
    assert result.rejects.where("stage <> 'scan'").count() == 0


def test_what_cannot_be_read_is_a_reject(spark, tmp_path):
    put(tmp_path, {"a": b"x" * 90, "b": b"x" * 90, "c": b"x" * 90, "d": b"y" * 500, "e": b"y" * 500})
    found = walk(spark, [str(tmp_path)]).files
    os.remove(tmp_path / "b")
    with open(tmp_path / "c", "ab") as f:
        f.write(b"more")
    result = run.run(found, run.Config([str(tmp_path)], chunk=100, small=200), OnDisk())
    assert {(os.path.basename(r["path"]), r["reason"], r["stage"]) for r in result.rejects.collect()} == {("b", "FileNotFoundError", "prefilter"), ("c", "grown", "prefilter")}
    assert [(r["size"], r["n_files"]) for r in result.groups.collect()] == [(500, 2)]


def test_null_contents_are_rejects(spark):
    rows = [(k, f"/r/{k}", f"{k}", "", 4, 1, 0, k, True, 4, True, "file", 0, bytearray(b"same") if k < 3 else None) for k in range(4)] + [(9, "/r/9", "9", "", None, 1, 0, 9, None, 0, False, "file", 0, None)]
    schema = "id bigint, path string, name string, ext string, size bigint, mtime_ns bigint, volume_id bigint, file_index bigint, resolved boolean, actual bigint, actual_known boolean, kind string, flags int, content binary"
    result = run.run(spark.createDataFrame(rows, schema), run.Config(["/r"]))
    assert {(r["id"], r["reason"], r["stage"]) for r in result.rejects.collect()} == {(3, "unreadable", "prefilter"), (9, "unreadable", "scan")}
    assert [r["n_files"] for r in result.groups.collect()] == [3]


def test_comparison_stops_at_the_first_difference(spark, tmp_path):
    rng = random.Random(6)
    base = rng.randbytes(20_000)
    files = {"same1": base, "same2": base, "late": base[:19_000] + b"?" + base[19_001:], "early": b"?" + base[1:], "two1": base[:5000] + b"!" + base[5001:], "two2": base[:5000] + b"!" + base[5001:]}
    put(tmp_path, files)
    members = rows(spark, tmp_path).withColumn("hash", F.lit("h"))
    for block, growth in ((1000, 1), (64, 4), (1 << 18, 4)):
        parts, rejects, reads = dedup.compared(members, OnDisk(), block, growth)
        got = defaultdict(set)
        for r in parts.collect():
            got[r["part"]].add(r["name"])
        assert sorted(map(sorted, got.values())) == [["early"], ["late"], ["same1", "same2"], ["two1", "two2"]] and rejects.count() == 0
        if growth == 1:
            # all read the first block, five a second to sixth, the pair that parted there and the rest go on to the end
            assert reads.first()["bytes"] == 6 * 1000 + 5 * 19 * 1000
    assert {r["name"] for r in dedup.detect(members.drop("hash"), OnDisk(), 100, 200, exact=True).members.collect()} == {"same1", "same2", "two1", "two2"}


def test_laid_out_files(spark, tmp_path):
    df = spark.createDataFrame([("/x/a", bytearray(b"1")), ("/x/_b/c", bytearray(b"")), ("/n", None)], "path string, content binary")
    assert lay_out(df, str(tmp_path)) == 3 and (tmp_path / "x/a").read_bytes() == b"1" and (tmp_path / "n").read_bytes() == b""
