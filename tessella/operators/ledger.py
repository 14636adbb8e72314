"""The ledger of scans and operations: listing, retention, pruning, import and export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.operators.rank import ranked, within
from tessella.sources import export, tree
from tessella.sources.scratch import stage

#: Scans that are retained.
RETAINED = 20
DONE = ("done", "undone", "undo_failed", "undoing")


def retained(scans: DataFrame, keep: int = RETAINED) -> DataFrame:
    """The newest scans by id: the limit is the feature, so no more than that many rows are ever ranked in one task."""
    return scans.orderBy(F.col("id").desc()).limit(keep)


def listed(rows: DataFrame, time: str) -> DataFrame:
    return rows.orderBy(F.col(time).desc(), F.col("id").desc())


def pruned(files: DataFrame, gone: DataFrame) -> DataFrame:
    """Files of a scan without the paths in ``gone``, and without groups that are left with one."""
    left = files.join(gone.select("path").distinct(), "path", "left_anti")
    whole = left.groupBy("hist_id", "group_id").agg(F.count("*").alias("_n")).where("_n >= 2").drop("_n")
    return left.join(whole, ["hist_id", "group_id"])


def group_figures(files: DataFrame) -> DataFrame:
    """``hist_id, group_id, size, n_files, reclaimable`` recomputed."""
    g = files.groupBy("hist_id", "group_id").agg(F.max("size").alias("size"), F.count("*").alias("n_files"))
    return g.withColumn("reclaimable", (F.col("n_files") - 1) * F.col("size"))


def header(scans: DataFrame, figures: DataFrame) -> DataFrame:
    """``id, groups_count, files_count, reclaimable`` of all scans, zeros where no group is left."""
    h = figures.groupBy(F.col("hist_id").alias("id")).agg(F.count("*").alias("g"), F.sum("n_files").alias("f"), F.sum("reclaimable").alias("r"))
    zero = F.lit(0).cast("bigint")
    return scans.select("id").join(h, "id", "left").select("id", F.coalesce("g", zero).alias("groups_count"), F.coalesce("f", zero).alias("files_count"), F.coalesce("r", zero).alias("reclaimable"))


def op_meta(ops: DataFrame, items: DataFrame) -> DataFrame:
    """Operations with counts of their items; ``done`` counts what was undone later as well."""
    state = F.col("state")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    per = items.groupBy("op_id").agg(F.count("*").alias("items"), count(state.isin(*DONE))("done"), count(state == "undone")("undone"), count(state.isin("failed", "undo_failed"))("failed"))
    zero = F.lit(0).cast("bigint")
    return ops.join(per, "op_id", "left").select(*ops.columns, *[F.coalesce(c, zero).alias(c) for c in ("items", "done", "undone", "failed")])


def undo_candidates(ops: DataFrame, items: DataFrame) -> DataFrame:
    return items.where(F.col("state").isin("done", "undo_failed")).join(ops.where("undoable").select("op_id"), "op_id")


def recovered(items: DataFrame) -> DataFrame:
    """What a crash left open: planned becomes interrupted, undoing an undo that failed."""
    return items.withColumn("state", F.when(F.col("state") == "planned", "interrupted").when(F.col("state") == "undoing", "undo_failed").otherwise(F.col("state")))


def finalised(ops: DataFrame, items: DataFrame) -> DataFrame:
    """Operations after their end: open items are cancelled, done ones counted with the bytes they really freed; zeros without items."""
    kinds = ops.select("op_id", "op_kind")
    joined = items.join(kinds, "op_id").withColumn("state", F.when(F.col("state") == "planned", "cancelled").otherwise(F.col("state")))
    done = F.col("state") == "done"
    freed = F.when(done & ((F.col("op_kind") == "delete") | ((F.col("op_kind") == "move") & F.col("cross_volume"))), F.col("size")).otherwise(0)
    per = joined.groupBy("op_id").agg(F.sum(F.when(done, 1).otherwise(0)).alias("done_count"), F.sum(F.when(F.col("state") == "cancelled", 1).otherwise(0)).alias("cancelled"), F.sum(freed).alias("reclaimed"))
    zero = F.lit(0).cast("bigint")
    return ops.select("op_id").join(per, "op_id", "left").select("op_id", *[F.coalesce(c, zero).alias(c) for c in ("done_count", "cancelled", "reclaimed")])


def natural_keys(rows: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """Rows that ``known`` has no equal of in all keys, each once, the one with the smallest id; nulls are equal to each other."""
    there = known.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    fresh = rows.join(there, same, "left_anti")
    rest = [c for c in rows.columns if c not in keys]
    first = fresh.groupBy(*keys).agg(F.min(F.struct("id", *[c for c in rest if c != "id"])).alias("m"))
    return first.select(*keys, "m.*")


def remapped(rows: DataFrame, foreign: str, mapping: DataFrame) -> DataFrame:
    """``rows`` with ``foreign`` replaced by ``mapping(old, new)``; ``orphan`` where there is no such id, 0 being none."""
    out = rows.join(mapping.select(F.col("old").alias(foreign), "new"), foreign, "left")
    return out.withColumn("orphan", F.col("new").isNull() & (F.col(foreign) != 0)).withColumn(foreign, F.coalesce("new", F.lit(0))).drop("new")


def _path_key(path: Column) -> Column:
    """What paths of ledgers of any system are compared by: slashes, none at the end."""
    return paths.trim_tail(paths.slash(path))


def local_roots(scans: DataFrame) -> DataFrame:
    """``root``: the roots of all scans of a ledger from their JSON lists; a list that can't be read adds none."""
    listed = F.from_json("roots", "array<string>")
    return scans.select(F.explode(listed).alias("root")).where("root is not null").select(_path_key(F.col("root")).alias("root")).where("root <> ''").distinct()


def known_paths(files: DataFrame, items: DataFrame) -> DataFrame:
    """``path``: what a ledger has seen, in scans or operations."""
    both = files.select("path").unionByName(items.select(F.col("orig_path").alias("path")))
    return both.where("path is not null").select(_path_key(F.col("path")).alias("path")).where("path <> ''").distinct()


def downgraded(ops: DataFrame, items: DataFrame, roots: DataFrame, known: DataFrame) -> DataFrame:
    """Foreign operations that must not be undone here: an undo path isn't absolute, or lies in no local root and isn't a known path.

    Paths are met with slashes and none at the end; roots by an equi-join on each
    distinct path's ancestors.
    """
    live = items.where(F.col("state").isin("done", "undo_failed")).join(ops.where("undoable").select("op_id"), "op_id").select("op_id", _path_key(F.col("orig_path")).alias("key"))
    distinct = live.select("key").distinct().where(F.col("key").rlike("^(/|[A-Za-z]:/)"))
    near = roots.select(_path_key(F.col("root")).alias("root")).where("root <> ''").distinct()
    inside = distinct.select("key", F.explode(paths.ancestors(F.col("key"))["dir"]).alias("root")).join(near, "root", "left_semi").select("key")
    seen = distinct.join(known.select(_path_key(F.col("path")).alias("key")), "key", "left_semi")
    bad = live.join(inside.unionByName(seen).distinct(), "key", "left_anti").select("op_id").distinct().withColumn("bad", F.lit(True))
    return ops.join(bad, "op_id", "left").withColumn("undoable", F.col("undoable") & F.col("bad").isNull()).drop("bad")


def lacking_evidence(ops: DataFrame, items: DataFrame, has_hash: Column) -> DataFrame:
    """``items, ops``: how many undoable done items lack a hash, in how many operations; an import with any is refused."""
    live = items.where(F.col("state").isin("done", "undo_failed") & ~has_hash).join(ops.where("undoable").select("op_id"), "op_id")
    per = live.groupBy("op_id").agg(F.count("*").alias("c"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("items"), F.count("*").alias("ops"))


def mirror(ops: DataFrame, items: DataFrame, part_rows: int = export.PART_ROWS) -> DataFrame:
    """Nested JSON documents ``op_id, part, json`` of operations with their items in order, in parts of bounded size."""
    inner = export.parted(items.select("op_id", "item_id", "orig_path", "size", "state"), "op_id", "item_id", part_rows)
    every = ops.join(inner, "op_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    return every.select("op_id", "part", F.to_json(F.struct("op_id", "op_kind", "undoable", F.coalesce("rows", F.array()).alias("items"))).alias("json"))


def json_or_empty(text: Column) -> Column:
    """A JSON column, ``[]`` where it is blank."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("[]"))


def json_valid(text: Column) -> Column:
    """Whether a text is one JSON value and nothing after it; a null isn't.

    The parser stops after a first value, so what follows must not close what is put around it.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.coalesce(alone & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull(), F.lit(False))


def newest(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Per key the row with the latest time, ties to the greater id."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(time, "id", *[c for c in rest if c not in (time, "id")])).alias("m"))
    return best.select(*keys, "m.*")


def numbered_names(names: DataFrame, taken: DataFrame | None = None, mark: str = "_") -> DataFrame:
    """``folder, name, id`` with ``free_name``: no two in a folder are equal, and none is in ``taken(folder, name)``.

    The first by id that wants a name gets it, if it isn't taken; others get a
    number before their extension: of those of one name the k-th gets the k-th
    number that is free, taken and wanted names being none. Numbers that aren't
    free are put among the ranks that have to pass them, so a number is a place in
    one order and no task holds a whole name.
    """
    ext = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    rows = within(names.select("folder", "name", "id"), ["folder", "name"], [F.col("id")], "_k")
    held = names.select("folder", "name").distinct()
    if taken is not None:
        taken = taken.select("folder", "name").distinct()
        held = held.unionByName(taken).distinct()
        rows = rows.join(taken.withColumn("_taken", F.lit(1)), ["folder", "name"], "left").withColumn("_k", F.col("_k") - F.when(F.col("_taken").isNull(), 1).otherwise(0)).drop("_taken")
    else:
        rows = rows.withColumn("_k", F.col("_k") - 1)
    rows = stage(rows.withColumn("_base", paths.drop_extension(F.col("name"))).withColumn("_ext", ext), "names")
    more = rows.where("_k > 0").select("folder", "_base", "_ext", F.col("_k").alias("_at"), F.lit(1).alias("_kind"), "id")
    number = F.regexp_extract(paths.drop_extension(F.col("name")), rf"^(.*){re.escape(mark)}([1-9][0-9]{{0,17}})$", 2)
    shut = held.select("folder", paths.drop_extension(F.col("name")).alias("_base"), ext.alias("_ext"), number.alias("_n")).where("_n <> ''")
    shut = shut.select("folder", F.expr(f"left(_base, length(_base) - length(_n) - {len(mark)})").alias("_base"), "_ext", F.col("_n").cast("bigint").alias("_n"))
    shut = shut.join(more.select("folder", "_base", "_ext").distinct(), ["folder", "_base", "_ext"], "left_semi")
    shut = within(shut, ["folder", "_base", "_ext"], [F.col("_n")], "_j").select("folder", "_base", "_ext", (F.col("_n") - F.col("_j") + 1).alias("_at"), F.lit(0).alias("_kind"), F.col("_n").alias("id"))
    placed = within(more.unionByName(shut), ["folder", "_base", "_ext"], [F.col("_at"), F.col("_kind"), F.col("id")], "_number").where("_kind = 1")
    free = placed.select("folder", "_base", "_ext", F.col("_at").alias("_k"), "id", "_number")
    out = rows.join(free, ["folder", "_base", "_ext", "_k", "id"], "left")
    return out.select("folder", "name", "id", F.when(F.col("_k") == 0, F.col("name")).otherwise(F.concat("_base", F.lit(mark), F.col("_number").cast("string"), "_ext")).alias("free_name"))


def kept_paths(scans: DataFrame, gone: DataFrame) -> DataFrame:
    """``scans`` whose JSON list ``keep_paths`` has lost the paths of ``gone(hist_id, path)``; a list that can't be read stays as it is.

    Only lists that lose a path are written anew, and their order stays.
    """
    listed = scans.select("id", F.posexplode(F.from_json("keep_paths", "array<string>")).alias("at", "path"))
    lost = gone.select(F.col("hist_id").alias("id"), "path", F.lit(1).alias("gone")).distinct()
    met = listed.join(lost, ["id", "path"], "left")
    hit = met.where("gone is not null").select("id").distinct()
    left = met.join(hit, "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("gone").isNull(), F.struct("at", "path")))).alias("kept"))
    out = scans.join(left, "id", "left")
    return out.withColumn("keep_paths", F.when(F.col("kept").isNull(), F.col("keep_paths")).otherwise(F.to_json(F.transform("kept", lambda x: x["path"])))).select(*scans.columns)


def without_scans(tables: dict[str, DataFrame], gone: DataFrame | None = None) -> dict[str, DataFrame]:
    """The ledger's tables without the scans in ``gone(id)``, or without any; their groups and files go with them, operations stay."""
    ids = tables["scan_history"].select("id") if gone is None else gone.select("id").distinct()
    out = dict(tables) | {"scan_history": tables["scan_history"].join(ids, "id", "left_anti")}
    for name in ("hist_groups", "hist_files"):
        out[name] = tables[name].join(ids.withColumnRenamed("id", "hist_id"), "hist_id", "left_anti")
    return out


def without_operations(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The ledger's tables without operations and their items; scans stay."""
    return dict(tables) | {name: tables[name].where(F.lit(False)) for name in ("op_records", "op_items")}


def loaded(groups: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of saved scans, and their groups without any file, which are left out and reported.

    ``groups(hist_id, id, ord, ...)``, ``files(hist_id, group_id, id, path, size, ...)``. Members come with
    their group's ``ord``; the order of a scan is ``ord``, then ``id``. The extension is
    derived anew, and bytes on disk, which aren't saved, count as the size and as unknown.
    """
    held = files.groupBy("hist_id", "group_id").agg(F.count("*").alias("n_files"))
    both = groups.withColumnRenamed("id", "group_id").join(held, ["hist_id", "group_id"], "left")
    empty = both.where("n_files is null").select("hist_id", "group_id")
    members = files.join(both.where("n_files is not null").select("hist_id", "group_id", "ord", "n_files"), ["hist_id", "group_id"])
    ext = paths.extension(paths.base_name(F.col("path")))
    return members.withColumn("ext", ext).withColumn("actual", F.col("size")).withColumn("actual_known", F.lit(False)), empty


def saved(local: dict[str, DataFrame], scan: DataFrame, groups: DataFrame, files: DataFrame, keep: int = RETAINED) -> dict[str, DataFrame]:
    """The ledger's three scan tables after a scan is appended and all but the newest ``keep`` are dropped, children too."""
    new = {"scan_history": scan, "hist_groups": groups, "hist_files": files}
    tables = {name: local[name].unionByName(new[name].select(*local[name].columns)) for name in new}
    kept = retained(tables["scan_history"], keep)
    ids = kept.select(F.col("id").alias("hist_id"))
    return {"scan_history": kept} | {name: tables[name].join(ids, "hist_id", "left_semi") for name in ("hist_groups", "hist_files")}


#: What makes two scans, and two operations, the same one in different ledgers: nothing that pruning changes.
SCAN_KEY = ("saved_at", "roots", "filters", "threads", "paranoid", "orig_files")
OP_KEY = ("created_at", "op_kind", "target_dir", "done_count", "reclaimed")


def _numbered_from(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """``rows`` with new ids ``name``, in the order of their own, above all ids of ``known``."""
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first()["n"]
    return ranked(rows, [F.col("id")], name).withColumn(name, F.col(name) + top)


def merged_import(
    local: dict[str, DataFrame], foreign: dict[str, DataFrame], roots: DataFrame, known_paths: DataFrame,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """New rows for each table of the ledger from a foreign one, and a row of counts; importing twice adds nothing.

    ValueError if the foreign tables lack a column, or if an item that could be
    undone has no hash. Scans and operations that are there by their natural key
    stay out with all their children; of equal ones in the foreign ledger the first
    is taken. Ids are given anew. An operation whose scan isn't there loses the link; one that
    would be undone outside of ``roots(root)`` and ``known_paths(path)`` becomes
    one that can't be undone.
    """
    tree.checked_ledger(foreign)
    ops, items = foreign["op_records"], foreign["op_items"]
    named = ops.withColumnRenamed("id", "op_id")
    hashed = (F.octet_length("hash") == 32) & (F.hex("hash") != "0" * 64)
    lacking = lacking_evidence(named, items, F.coalesce(hashed, F.lit(False))).first()
    if lacking["items"]:
        raise ValueError(f"{lacking['items']} items of {lacking['ops']} operations could be undone without a hash")

    scans = foreign["scan_history"]
    new_scans = _numbered_from(natural_keys(scans, list(SCAN_KEY), local["scan_history"]), local["scan_history"], "new")
    there = local["scan_history"].groupBy(*SCAN_KEY).agg(F.min("id").alias("new")).unionByName(new_scans.select(*SCAN_KEY, "new"))
    there = there.select("new", *[F.col(k).alias(f"_{k}") for k in SCAN_KEY])
    same = F.lit(True)
    for k in SCAN_KEY:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    mapping = scans.select(F.col("id").alias("old"), *SCAN_KEY).join(there, same).select("old", "new")
    taken = new_scans.select(F.col("id").alias("hist_id"), F.col("new").alias("new_hist"))
    groups = _numbered_from(foreign["hist_groups"].join(taken, "hist_id"), local["hist_groups"], "new")
    files = foreign["hist_files"].join(groups.select(F.col("id").alias("group_id"), F.col("new").alias("new_group"), "new_hist"), "group_id")
    files = _numbered_from(files, local["hist_files"], "new")

    linked = remapped(ops, "hist_id", mapping)
    new_ops = natural_keys(linked, list(OP_KEY), local["op_records"])
    judged = downgraded(new_ops.withColumnRenamed("id", "op_id"), items, roots, known_paths).withColumnRenamed("op_id", "id")
    judged = _numbered_from(judged.join(new_ops.select("id", F.col("undoable").alias("was")), "id"), local["op_records"], "new")
    new_items = _numbered_from(items.join(judged.select(F.col("id").alias("op_id"), F.col("new").alias("new_op")), "op_id"), local["op_items"], "new")

    as_new = lambda rows, **changed: rows.withColumns({"id": F.col("new")} | {c: F.col(x) for c, x in changed.items()})
    tables = {
        "scan_history": as_new(new_scans),
        "hist_groups": as_new(groups, hist_id="new_hist"),
        "hist_files": as_new(files, hist_id="new_hist", group_id="new_group"),
        "op_records": as_new(judged),
        "op_items": as_new(new_items, op_id="new_op"),
    }
    tables = {name: rows.select(*local[name].columns) for name, rows in tables.items()}
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    added, done = count(new_scans, "scans_added"), judged.agg(F.count("*").alias("ops_added"), F.count_if("orphan").alias("ops_orphaned"), F.count_if(F.col("was") & ~F.col("undoable")).alias("ops_downgraded"))
    one = lambda rows: rows.withColumn("_one", F.lit(1))
    summary = one(added).join(one(count(scans, "scans")), "_one").join(one(done), "_one").join(one(count(ops, "ops")), "_one")
    return tables, summary.select("scans_added", (F.col("scans") - F.col("scans_added")).alias("scans_skipped"), "ops_added", (F.col("ops") - F.col("ops_added")).alias("ops_skipped"), "ops_orphaned", "ops_downgraded")
