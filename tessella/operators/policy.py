"""Keep policies, process policies, selections and paged results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import dedup, scan
from tessella.operators.rank import within


#: The policy that decides nothing: the choice is the user's.
MANUAL = "manual"


def keep_order(kind: str) -> list[Column]:
    """The order whose first member of a group is kept; ties go to the first path. Any other kind is the default: shown, short."""
    if kind == "newest":
        return [-F.col("mtime_ns"), F.col("path")]
    if kind == "oldest":
        return [F.col("mtime_ns"), F.col("path")]
    return [dedup.keeper_order()]


def keep(members: DataFrame, kind: str) -> DataFrame:
    """``group_id, keep_id``: what a policy keeps of each group, by one aggregation; ``manual`` decides no group."""
    if kind == MANUAL:
        return members.limit(0).select("group_id", F.col("id").alias("keep_id"))
    order = keep_order(kind)
    return members.groupBy("group_id").agg(F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col("id").alias("id")))["id"].alias("keep_id"))


def keepers(g: DataFrame, chosen: DataFrame, members: DataFrame) -> DataFrame:
    """``group_id, keep_id``: the explicit keeper of ``chosen(group_id, keep_id)`` where it is a member of the group (of several the first path), else the default one."""
    valid = chosen.select("group_id", "keep_id").distinct().join(members.select("group_id", F.col("id").alias("keep_id"), "path"), ["group_id", "keep_id"]).groupBy("group_id").agg(F.min(F.struct("path", "keep_id"))["keep_id"].alias("explicit"))
    return g.join(valid, "group_id", "left").select("group_id", F.coalesce("explicit", "keeper").alias("keep_id"))


def keep_in_dirs(members: DataFrame, dirs: DataFrame) -> DataFrame:
    """``group_id, keep_id``: a member in the first directory that has one, the longest path in it, ties to the first path."""
    held = scan.in_dirs(members, scan.distinct_dirs(dirs))
    order = F.struct(F.col("dir_ord"), (-F.octet_length("path")).alias("n"), F.col("path"), F.col("id"))
    return held.groupBy("group_id").agg(F.min(order)["id"].alias("keep_id"))


def unmatched_groups(g: DataFrame, kept: DataFrame) -> DataFrame:
    """Groups that a directory policy keeps nothing of."""
    return g.join(kept, "group_id", "left_anti").select("group_id")


def decisions(members: DataFrame, kept: DataFrame) -> DataFrame:
    """``group_id, keep_id, part, remove_ids``: a row for each group and part of what goes."""
    away = F.sort_array(F.collect_list(F.when(F.col("id") != F.col("keep_id"), F.col("id"))))
    sizes = members.groupBy("group_id").agg(F.count("*").alias("n"))
    held = members.join(kept, "group_id").join(sizes, "group_id").withColumn("part", dedup.part_of(F.col("n"), F.col("id")))
    return held.groupBy("group_id", "keep_id", "part").agg(away.alias("remove_ids"))


def pending(
    selection: DataFrame, members: DataFrame, keep_ids: DataFrame, dirs: DataFrame | None = None, exclude_dirs: DataFrame | None = None,
) -> DataFrame:
    """``id, ord, reason``: what will happen to a selection ``id, ord``; null means it is processed.

    Reasons in order: ``gone`` (no such member), ``keep``, ``outside`` (in none
    of the directories; a list of nothing but blanks holds nothing),
    ``excluded``. A repeated choice counts where it first is.
    """
    chosen = selection.groupBy("id").agg(F.min("ord").alias("ord"))
    out = chosen.join(members.select("id", F.lit(True).alias("there")), "id", "left").join(keep_ids.select("id", F.lit(True).alias("kept")), "id", "left")
    reason = F.when(F.col("there").isNull(), "gone").when(F.col("kept"), "keep")
    if dirs is not None:
        inside = scan.in_dirs(members, scan.distinct_dirs(dirs)).select("id", F.lit(True).alias("inside"))
        out, reason = out.join(inside, "id", "left"), reason.when(F.col("inside").isNull(), "outside")
    if exclude_dirs is not None:
        shut = scan.in_dirs(members, scan.distinct_dirs(exclude_dirs)).select("id", F.lit(True).alias("shut"))
        out, reason = out.join(shut, "id", "left"), reason.when(F.col("shut"), "excluded")
    return out.select("id", "ord", reason.alias("reason"))


def unmatched_dirs(members: DataFrame, keep_ids: DataFrame, dirs: DataFrame) -> DataFrame:
    """Directories that no member but keepers is credited to; a member credits the first that holds it."""
    clean = scan.distinct_dirs(dirs)
    hit = scan.in_dirs(members.join(keep_ids.select("id"), "id", "left_anti"), clean).select("dir").distinct()
    return clean.join(hit, "dir", "left_anti").select("dir")


#: Sorts of results: all descending, ties to the smaller group number.
SORTS = {"reclaimable": "reclaimable", "size": "size", "count": "n_files"}
PAGE_DEFAULT, PAGE_MOST = 100, 500


def page(g: DataFrame, sort: str = "reclaimable", number: int = 0, size: int = PAGE_DEFAULT) -> DataFrame:
    """A page of groups. Sizes are clamped to 1..500, numbers to 0 and above; past the end it is empty."""
    size = PAGE_DEFAULT if size <= 0 else min(size, PAGE_MOST)
    ordered = g.orderBy(F.col(SORTS.get(sort, "reclaimable")).desc(), "group_id")
    return ordered.offset(max(0, number) * size).limit(size)


def reload_plan(shown: Column) -> dict[str, Column]:
    """``segment_size, segments, next_page``: how as many rows as are shown are read again in few pages, and which page of the usual size follows."""
    default, most, one = (F.lit(n).cast("bigint") for n in (PAGE_DEFAULT, PAGE_MOST, 1))
    few, segment = shown <= PAGE_DEFAULT, F.greatest(default, F.least(shown, most))
    return {"segment_size": F.when(few, default).otherwise(segment), "segments": F.when(few, one).otherwise(F.ceil(shown / segment)), "next_page": F.when(few, one).otherwise(F.ceil(shown / PAGE_DEFAULT))}


def first_excluded(rows: Column, pending: Column, before: Column) -> Column:
    """Where on a page of ``rows``, before which there are ``before``, the first excluded row is, when the first ``pending`` of all aren't; -1 if it isn't there."""
    at = pending - before
    return F.when(rows == 0, -1).when(at <= 0, 0).when(at < rows, at).otherwise(-1)


def with_extension(g: DataFrame, members: DataFrame, ext: str) -> DataFrame:
    """Groups with any member of an extension."""
    return g.join(members.where(F.lower("ext") == ext.lower()).select("group_id").distinct(), "group_id", "left_semi")


def pending_page(rows: DataFrame, members: DataFrame, g: DataFrame, sort: str, number: int, size: int) -> DataFrame:
    """Processed rows by ``size``, ``path`` or ``group``, then excluded ones in the order of selection."""
    out = rows.join(members.select("id", "path", "size", "group_id"), "id", "left").withColumn("later", F.col("reason").isNotNull())
    keys = {"size": [-F.col("size"), F.col("group_id"), F.col("id")], "path": [F.col("path"), F.col("id")], "group": [F.col("group_id"), F.col("path"), F.col("id")]}[sort]
    first = [F.when(~F.col("later"), k) for k in keys]
    return out.orderBy("later", *first, "ord").offset(max(0, number) * size).limit(size).select("id", "path", "size", "group_id", "reason")


def selection_state(members: DataFrame, keep_ids: DataFrame, selected: DataFrame) -> DataFrame:
    """``group_id, state, selectable``: none, some or all of a group's members but keepers."""
    free = members.join(keep_ids.select("id"), "id", "left_anti").join(selected.select("id", F.lit(1).alias("on")), "id", "left")
    counted = free.groupBy("group_id").agg(F.count("*").alias("selectable"), F.count("on").alias("on"))
    return counted.select("group_id", F.when(F.col("on") == 0, "none").when(F.col("on") == F.col("selectable"), "all").otherwise("some").alias("state"), "selectable")


def first_choice(selection: DataFrame) -> DataFrame:
    """A selection ``id, ord`` without repetitions, each where it was chosen first."""
    return selection.groupBy("id").agg(F.min("ord").alias("ord"))


def chunks(ids: DataFrame, size: int) -> DataFrame:
    """``batch`` numbers for a list ``ord`` that counts from 0."""
    return ids.withColumn("batch", F.floor(F.col("ord") / size).cast("bigint"))


def member_positions(members: DataFrame) -> DataFrame:
    """``position`` of each member in its group, by path."""
    return within(members, ["group_id"], [F.col("path"), F.col("id")], "position")
