"""Operations on real files: outcomes, claimed names, a task that runs again, and taking them back."""

import hashlib
import os

from pyspark.sql import functions as F

from tessella.operators.execute import Log, act, claimed, done, execute, undo

SCHEMA = "id bigint, kind string, path string, size bigint, volume_id bigint, file_index bigint, hash string, keeper string, target string"


def item(path, kind, keeper=None, target=None, k=1, **changed):
    s = os.lstat(path)
    base = {"id": k, "kind": kind, "path": str(path), "size": s.st_size, "volume_id": s.st_dev, "file_index": s.st_ino, "hash": hashlib.sha256(open(path, "rb").read()).hexdigest(), "keeper": keeper and str(keeper), "target": target and str(target)}
    return base | changed


def put(folder, name, data=b"same"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return path


def run(spark, tmp_path, items):
    df = spark.createDataFrame([tuple(i[c.split()[0]] for c in SCHEMA.split(", ")) for i in items], SCHEMA)
    out = execute(df, f"{tmp_path}/journal")
    return out, {r["id"]: (r["outcome"], r["dest"].removeprefix(str(tmp_path)), r["freed"]) for r in out.collect()}


def test_each_kind_and_back(spark, tmp_path):
    keep = put(tmp_path, "keep")
    kinds = ("delete", "trash", "move", "hardlink", "symlink")
    files = {k: put(tmp_path, f"d{k}/{kind}.txt") for k, kind in enumerate(kinds)}
    put(tmp_path, "moved/move.txt", b"other")
    items = [item(files[k], kind, keep, tmp_path / ("moved" if kind == "move" else "bin"), k) for k, kind in enumerate(kinds)]
    out, got = run(spark, tmp_path, items)
    assert got == {0: ("ok", "", 4), 1: ("ok", "/bin/files/trash.txt", 0), 2: ("ok", "/moved/move_1.txt", 0), 3: ("ok", "/keep", 4), 4: ("ok", "/keep", 4)}
    assert not any(files[k].exists() for k in (0, 1, 2)) and files[3].samefile(keep) and files[4].is_symlink() and files[4].read_bytes() == b"same"
    info = (tmp_path / "bin/info/trash.txt.trashinfo").read_text().splitlines()
    assert info[:2] == ["[Trash Info]", f"Path={files[1]}"] and (tmp_path / "moved/move.txt").read_bytes() == b"other"
    put(tmp_path, "d2/move.txt", b"somebody else's")
    back = {r["id"]: (r["outcome"], os.path.basename(r["dest"])) for r in undo(out, f"{tmp_path}/journal").collect()}
    assert back == {1: ("restored", "trash.txt"), 2: ("beside", "move_1.txt"), 3: ("restored", "hardlink.txt"), 4: ("restored", "symlink.txt")}
    assert not files[3].samefile(keep) and not files[4].is_symlink() and all(files[k].read_bytes() == b"same" for k in (1, 3, 4))
    assert sorted(p.name for p in (tmp_path / "d3").iterdir()) == ["hardlink.txt"]


def test_what_is_not_as_it_was_stays(spark, tmp_path):
    keep, other = put(tmp_path, "keep"), put(tmp_path, "other", b"else")
    paths = [put(tmp_path, f"f{k}") for k in range(9)]
    items = [item(p, kind, keep, tmp_path / "bin", k) for k, (p, kind) in enumerate(zip(paths, ["delete", "delete", "delete", "hardlink", "symlink", "hardlink", "trash", "delete", "burn"], strict=True))]
    os.remove(paths[0])  # gone
    paths[1].write_bytes(b"diff")  # other content
    items[2]["file_index"] += 1  # another file in its place
    items[3]["keeper"] = None
    items[4]["keeper"] = str(other)
    items[5]["keeper"] = str(tmp_path / "nowhere")
    os.remove(paths[6])
    paths[6].symlink_to(keep)
    items.append(items[7] | {"id": 20})  # the same file twice
    got = run(spark, tmp_path, items)[1]
    assert {k: v[0] for k, v in got.items()} == {0: "skipped", 1: "failed:verify", 2: "failed:verify", 3: "failed:keeper", 4: "failed:verify", 5: "failed:verify", 6: "failed:verify", 7: "ok", 20: "skipped", 8: "failed:act"}
    assert all(p.exists() for p in paths[1:7]) and not paths[7].exists() and paths[8].exists()


def test_a_task_that_runs_again_does_nothing_twice(tmp_path):
    keep = put(tmp_path, "keep")
    items = [item(put(tmp_path, f"f{k}"), kind, keep, tmp_path / "moved", k) for k, kind in enumerate(("delete", "move", "hardlink", "delete"))]
    first = Log(f"{tmp_path}/log")
    want = [done(i, first, "app") for i in items[:3]]
    first.put(id=3)
    act(items[3], "app")  # stopped before its end was written
    first.close()
    with open(tmp_path / "log", "a") as f:
        f.write('{"id": 9, "outc')  # a line that broke off
    again = Log(f"{tmp_path}/log")
    assert [done(i, again, "app") for i in items] == [*want, ("ok", "", 4)]
    again.close()
    third = Log(f"{tmp_path}/log")
    assert sorted(third.ended) == [0, 1, 2, 3] and [done(i, third, "app") for i in items] == [*want, ("ok", "", 4)]
    assert sorted(p.name for p in (tmp_path / "moved").iterdir()) == ["f1"]


def test_claimed_names(tmp_path):
    names = [os.path.basename(claimed(str(tmp_path), n)) for n in ("a.txt", "a.txt", "a_1.txt", ".hid", ".hid", "x", "x", "t.tar.gz", "t.tar.gz")]
    assert names == ["a.txt", "a_1.txt", "a_1_1.txt", ".hid", "_1.hid", "x", "x_1", "t.tar.gz", "t.tar_1.gz"] and len(set(names)) == len(names)


def test_no_items(spark, tmp_path):
    assert execute(spark.createDataFrame([], SCHEMA), f"{tmp_path}/j").select(F.count("*")).first()[0] == 0
