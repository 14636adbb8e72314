"""What operations come to: outcomes by kind from observed states, journal rows, guards and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import classify, paths
from tessella.operators import scan


def outcome(
    kind: Column, identity: Column, content: Column, keeper: Column, done: Column, vanished: Column, confirmed: Column, strict: Column,
) -> Column:
    """``ok``, ``skipped`` or ``failed:<stage>`` of one file by the kind of operation.

    * ``identity`` (``same``, ``replaced``, ``gone``, ``unknown``) comes first for all.
    * What destroys or links needs a ``content`` verdict of ``pass``; links need
      one of the ``keeper`` as well, null where there is none.
    * ``done``: null, or why the step itself failed; ``privilege`` is a stage of its own.
    * A file that ``vanished`` from its place is in the bin if that is ``confirmed``;
      if not, it is skipped, or a failure where the bin can be looked into (``strict``).
    """
    links = kind.isin("hardlink", "symlink")
    checked = links | (kind == "delete")
    return (
        F.when(links & keeper.isNull(), "failed:keeper")
        .when((kind == "trash") & vanished, F.when(confirmed, "ok").when(strict, "failed:trash").otherwise("skipped"))
        .when(identity == "gone", "skipped")
        .when(identity != "same", "failed:verify")
        .when(checked & (content == "skipped"), "skipped")
        .when(checked & (content != "pass"), "failed:verify")
        .when(links & (keeper != "pass"), "failed:verify")
        .when(done.isNull(), "ok")
        .when((kind == "delete") & (done == "missing"), "skipped")
        .when((kind == "symlink") & (done == "privilege"), "failed:privilege")
        .when(kind == "trash", "failed:trash")
        .otherwise("failed:act")
    )


def same_volume(a: Column, a_known: Column, b: Column, b_known: Column) -> Column:
    """Whether two files are surely on one volume."""
    return a_known & b_known & (a == b)


def one_stage_summed(failed: DataFrame, stage: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``failed(stage, path, err)`` with one text for a stage, every row kept, and ``stage, n`` of that stage if it occurs."""
    own = F.col("stage") == stage
    return failed.withColumn("err", F.when(own, F.lit(text)).otherwise(F.col("err"))), failed.where(own).groupBy("stage").agg(F.count("*").alias("n"))


def begun(ops: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Journal rows of operations before anything is done: records without figures, and planned items ``op_id, orig_path, size``."""
    zero = F.lit(0).cast("bigint")
    records = ops.withColumn("done_count", zero).withColumn("reclaimed", zero)
    empty = F.lit("")
    return records, plan.select("op_id", "orig_path", empty.alias("dest_path"), empty.alias("link_src"), "size", F.lit("planned").alias("state"), empty.alias("err"))


def finished(items: DataFrame, results: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Items after ``results(op_id, orig_path, dest_path, link_src, state, err)``, and results that no planned item has; ``parts``: of the join."""
    keys, changed = ["op_id", "orig_path"], ["dest_path", "link_src", "state", "err"]
    if parts:
        items, results = items.repartition(parts, *keys), results.repartition(parts, *keys)
    new = results.select(*keys, *[F.col(c).alias(f"_{c}") for c in changed], F.lit(True).alias("_met"))
    both = items.join(new, keys, "left")
    out = both.select(*[F.when(F.col("_met"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in items.columns])
    return out, results.join(items.select(*keys), keys, "left_anti")


def marked_undo(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items after an undo: ``results(item_id, state, err)`` by item."""
    new = results.select("item_id", F.col("state").alias("_state"), F.col("err").alias("_err"))
    both = items.join(new, "item_id", "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in ("state", "err") else F.col(c) for c in items.columns])


def enclosing_root(target: Column, roots: list[str]) -> Column:
    """The first of some roots that a report's path lies in, so that a scan never reads its own output; null if none does."""
    out = F.when(F.lit(False), F.lit(""))
    for root in roots:
        clean = root.rstrip("/") or "/"
        inside = paths.under(target, F.lit(clean)) if clean != "/" else F.startswith(target, F.lit("/"))
        out = out.when(inside & (target != ""), F.lit(root))
    return out


def landings(targets: DataFrame, allowed: DataFrame) -> DataFrame:
    """``id, landing, granted``: whether each resolved landing lies in an allowed directory; an unresolved one doesn't, ``/`` allows all.

    Met by an equi-join on a landing's own path and its ancestors.
    """
    above = targets.where("landing is not null").select("id", F.explode(paths.ancestors(paths.cleaned(F.col("landing")))["dir"]).alias("dir"))
    clean = allowed.where("trim(dir) <> ''").select(paths.dir_key(F.trim("dir")).alias("dir")).distinct()
    inside = above.join(clean, "dir", "left_semi").select("id").distinct().withColumn("granted", F.lit(True))
    return targets.join(inside, "id", "left").select("id", "landing", F.coalesce("granted", F.lit(False)).alias("granted"))


def warm_dirs(dirs: DataFrame, exclude_dirs: DataFrame) -> DataFrame:
    """``dir_ord, dir`` of both lists, those to look into before those to leave out."""
    last = dirs.agg(F.coalesce(F.max("dir_ord"), F.lit(-1)).alias("last"))
    return dirs.select("dir_ord", "dir").unionByName(exclude_dirs.crossJoin(F.broadcast(last)).select((F.col("last") + 1 + F.col("dir_ord")).alias("dir_ord"), "dir"))


def replayed(previous: DataFrame, members: DataFrame, keep_ids: DataFrame) -> DataFrame:
    """What of a selection ``id`` is still there and no keeper, each once."""
    return previous.select("id").distinct().join(members.select("id"), "id", "left_semi").join(keep_ids.select("id"), "id", "left_anti")


def group_view(members: DataFrame, keep_ids: DataFrame, pending: DataFrame) -> DataFrame:
    """``group_id, id, path, name, size, mtime_ns, volume, volume_resolved, is_keep, is_pending`` of each member."""
    kept = keep_ids.select("group_id", F.col("keep_id").alias("id"), F.lit(True).alias("is_keep"))
    waiting = pending.select("id").distinct().withColumn("is_pending", F.lit(True))
    out = members.join(kept, ["group_id", "id"], "left").join(waiting, "id", "left")
    volume = classify.volume_label(F.col("volume_id"), F.col("resolved"), F.col("path"))
    no = F.lit(False)
    return out.select("group_id", "id", "path", paths.base_name(F.col("path")).alias("name"), "size", "mtime_ns", volume.alias("volume"), F.col("resolved").alias("volume_resolved"), F.coalesce("is_keep", no).alias("is_keep"), F.coalesce("is_pending", no).alias("is_pending"))


#: What becomes of the bytes of an operation, by its kind.
FATES = {"hardlink": "linked", "move": "moved", "symlink": "one-copy", "trash": "in-bin", "delete": "freed"}


def fate(kind: Column) -> Column:
    """Only a deletion is said to free space; an unknown kind is said to be unknown."""
    out = F.when(F.lit(False), F.lit(""))
    for name, code in FATES.items():
        out = out.when(kind == name, F.lit(code))
    return out.otherwise(F.concat(F.lit("unknown:"), kind))


def wanted_records(wanted: DataFrame, records: DataFrame, not_before: Column) -> DataFrame:
    """``path, file``: for each wanted path the newest deletion record ``path, filetime, file`` of it, of that time or later.

    Paths are compared without case and with either slash. The file named is the
    one that holds the content: the same name with another second letter.
    """
    from tessella.functions import records as r

    keyed = wanted.where("path <> ''").groupBy(r.path_key(F.col("path")).alias("key")).agg(F.max("path").alias("path"))
    new = records.where(F.col("filetime") >= not_before).groupBy(r.path_key(F.col("path")).alias("key")).agg(F.max(F.struct("filetime", "file")).alias("m"))
    name = F.substring_index("m.file", "/", -1)
    folder = paths.folder(F.col("m.file"))
    return keyed.join(new, "key").select("path", F.concat(folder, F.lit("/$R"), F.substr(name, F.lit(3))).alias("file"))


def positions_in(listed: DataFrame, dirs: DataFrame) -> DataFrame:
    """The rows of ``listed(list, position, path)`` whose path lies in any of some directories; positions count from 0 in each list."""
    return scan.in_dirs(listed.withColumn("id", F.struct("list", "position")), scan.distinct_dirs(dirs)).select("list", "position", "path")


def in_scope(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """Ids of files in any of some directories."""
    return scan.in_dirs(files, scan.distinct_dirs(dirs)).select("id")
