"""Clean-up operations on real files, in tasks, with a log that makes a second run of a task harmless.

Each item is checked as it is found (identity, content, keeper), then done, and
comes back with an outcome. Before a step its line is in the log of its part, and
after it another; a task that starts again reads its log first, so what was done
is told again and not done twice. Names are claimed before files are moved to
them, and links are made beside a file and put in its place at once.
"""

from __future__ import annotations

import errno
import hashlib
import json
import os
import shutil
import time
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.scratch import stage

#: Names that are tried for one file before a folder counts as full.
MOST_NAMES = 10_000
_IN = ("id", "kind", "path", "size", "volume_id", "file_index", "hash", "keeper", "target")
_OUT = "id bigint, kind string, path string, outcome string, dest string, freed bigint"


def _sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def claimed(folder: str, name: str, ending: str = "") -> str:
    """A path in ``folder`` that nobody has, taken by an empty file; a number goes before the extension. ``ending``: of the file that takes it."""
    base, ext = os.path.splitext(name) if not name.startswith(".") or "." in name[1:] else ("", name)
    for k in range(MOST_NAMES):
        path = os.path.join(folder, f"{base}_{k}{ext}" if k else name) + ending
        try:
            os.close(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o644))
            return path
        except FileExistsError:
            continue
    raise OSError(errno.EEXIST, "too many files of one name", name)


def verdict(item: dict) -> str | None:
    """Why an item isn't done: ``skipped`` or ``failed:<stage>``; null if it may be."""
    kind, keeper = item["kind"], item["keeper"]
    links = kind in ("hardlink", "symlink")
    if links and keeper is None:
        return "failed:keeper"
    try:
        now = os.lstat(item["path"])
    except FileNotFoundError:
        return "skipped"
    except OSError:
        return "failed:verify"
    if not os.path.isfile(item["path"]) or os.path.islink(item["path"]) or (now.st_dev, now.st_ino) != (item["volume_id"], item["file_index"]):
        return "failed:verify"
    if links or kind == "delete":
        try:
            if now.st_size != item["size"] or _sha256(item["path"]) != item["hash"]:
                return "failed:verify"
            if links and (os.path.islink(keeper) or _sha256(keeper) != item["hash"]):
                return "failed:verify"
        except OSError:
            return "failed:verify"
    return None


def act(item: dict, tag: str) -> tuple[str, int]:
    """Do an item: where its content is now (empty if nowhere else), and the bytes that this freed."""
    kind, path = item["kind"], item["path"]
    if kind == "delete":
        last = os.lstat(path).st_nlink == 1
        os.unlink(path)
        return "", item["size"] if last else 0
    if kind in ("hardlink", "symlink"):
        beside = f"{path}.{tag}-tmp"
        if os.path.lexists(beside):
            os.unlink(beside)
        if kind == "hardlink":
            os.link(item["keeper"], beside)
        else:
            os.symlink(item["keeper"], beside)
        os.replace(beside, path)
        return item["keeper"], item["size"]
    os.makedirs(item["target"], exist_ok=True)
    if kind == "move":
        dest = claimed(item["target"], os.path.basename(path))
    else:  # trash: the information first, then the file, as desktops expect it
        for part in ("info", "files"):
            os.makedirs(os.path.join(item["target"], part), exist_ok=True)
        info = claimed(os.path.join(item["target"], "info"), os.path.basename(path), ".trashinfo")
        with open(info, "w") as f:
            f.write(f"[Trash Info]\nPath={urllib.parse.quote(path)}\nDeletionDate={time.strftime('%Y-%m-%dT%H:%M:%S')}\n")
        dest = os.path.join(item["target"], "files", os.path.basename(info).removesuffix(".trashinfo"))
    try:
        os.replace(path, dest)
    except OSError:
        if kind == "move":
            os.unlink(dest)
        else:
            os.unlink(info)
        raise
    return dest, 0


class Log:
    """What a part has begun and ended, a line each, on disk before the next step."""

    def __init__(self, path: str):
        self.ended: dict[int, tuple] = {}
        self.begun: set[int] = set()
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if os.path.exists(path):
            with open(path) as f:
                for line in f.read().split("\n"):
                    try:
                        x = json.loads(line)
                    except ValueError:  # the end, or a line that broke off
                        continue
                    self.begun.add(x["id"])
                    if "outcome" in x:
                        self.ended[x["id"]] = (x["outcome"], x["dest"], x["freed"])
        self.file = open(path, "a")  # noqa: SIM115
        self.file.write("\n")

    def put(self, **line) -> None:
        self.file.write(json.dumps(line) + "\n")
        self.file.flush()
        os.fsync(self.file.fileno())

    def close(self) -> None:
        self.file.close()


def done(item: dict, log: Log, tag: str) -> tuple[str, str, int]:
    """``outcome, dest, freed`` of an item, from the log or by doing it."""
    if item["id"] in log.ended:
        return log.ended[item["id"]]
    again = item["id"] in log.begun
    why = verdict(item)
    if again and why == "skipped" and item["kind"] == "delete":
        out = ("ok", "", item["size"])  # this part deleted it before it was stopped
    elif why is not None:
        out = (why, "", 0)
    else:
        log.put(id=item["id"])
        try:
            out = ("ok", *act(item, tag))
        except FileNotFoundError:
            out = ("skipped", "", 0)
        except PermissionError:
            out = ("failed:privilege" if item["kind"] == "symlink" else "failed:act", "", 0)
        except OSError:
            out = ("failed:act", "", 0)
    log.put(id=item["id"], outcome=out[0], dest=out[1], freed=out[2])
    return out


def execute(plan: DataFrame, journal: str, tag: str = "app") -> DataFrame:
    """``id, kind, path, outcome, dest, freed`` of ``plan(id, kind, path, size, volume_id, file_index, hash, keeper, target)``, done once and written.

    ``kind``: ``delete``, ``trash``, ``move`` (into the folder ``target``),
    ``hardlink`` or ``symlink`` (to ``keeper``). ``journal`` is a new folder that all
    machines mount. Outcomes are ``ok``, ``skipped`` (it was gone) or
    ``failed:<stage>``; an unknown kind is ``failed:act``. Items are dealt by path, so
    repeated ones are done one after the other, and the second is skipped or fails.
    """
    held = stage(plan.select(*_IN), "plan")  # parts and their logs stay the same when a task runs again
    parts = held.repartition(4 * held.sparkSession.sparkContext.defaultParallelism, "path").sortWithinPartitions("path", "id")
    fixed = stage(parts.withColumn("part", F.spark_partition_id()), "plan-parts")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs: dict[int, Log] = {}
        names = [c.split()[0] for c in _OUT.split(", ")]
        try:
            for batch in batches:
                rows = []
                for item in batch.to_pylist():
                    part = item.pop("part")
                    if part not in logs:
                        logs[part] = Log(f"{journal}/{part}.log")
                    outcome = done(item, logs[part], tag) if item["kind"] in ("delete", "trash", "move", "hardlink", "symlink") else ("failed:act", "", 0)
                    rows.append((item["id"], item["kind"], item["path"], *outcome))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        finally:
            for log in logs.values():
                log.close()

    # a part is one task's: two tasks never write one log
    return stage(fixed.repartition(4 * held.sparkSession.sparkContext.defaultParallelism, "part").sortWithinPartitions("part", "path", "id").mapInArrow(one, _OUT), "executed")


def undo(done_items: DataFrame, journal: str) -> DataFrame:
    """``id, outcome, dest``: moved and trashed files back at their place, or beside it under a free name; links become copies of their own.

    ``restored``, ``beside``, ``gone`` (there is nothing to bring back) or ``failed``.
    Deleted files can't come back.
    """

    def back(item: dict) -> tuple[str, str]:
        kind, path, dest = item["kind"], item["path"], item["dest"]
        try:
            if kind in ("hardlink", "symlink"):
                if not os.path.lexists(path):
                    return "gone", ""
                beside = claimed(os.path.dirname(path), os.path.basename(path), ".undo")
                shutil.copyfile(path, beside)
                os.replace(beside, path)
                return "restored", path
            if not os.path.lexists(dest):
                return "gone", ""
            target = claimed(os.path.dirname(path), os.path.basename(path))
            os.replace(dest, target)
            return ("restored" if target == path else "beside"), target
        except OSError:
            return "failed", ""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            log = Log(f"{journal}/undo-{TaskContext.get().partitionId()}.log")
            rows = []
            for item in batch.to_pylist():
                if item["id"] in log.ended:
                    outcome, dest, _ = log.ended[item["id"]]
                else:
                    outcome, dest = back(item)
                    log.put(id=item["id"], outcome=outcome, dest=dest, freed=0)
                rows.append((item["id"], outcome, dest))
            log.close()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["id", "outcome", "dest"])

    kept = stage(done_items.where("outcome = 'ok' and kind <> 'delete'").select("id", "kind", "path", "dest"), "undo-plan")
    return stage(kept.mapInArrow(one, "id bigint, outcome string, dest string"), "undone")
