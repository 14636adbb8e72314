"""Planning and accounting of clean-up operations. Observed states are input columns; nothing touches files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import dedup


def content_verdict(exists: Column, readable: Column, size: Column, hash_: Column, want_size: Column, want_hash: Column) -> Column:
    """``skipped`` (gone), ``unverifiable``, ``failed`` (changed) or ``pass``."""
    return F.when(~exists, "skipped").when(~readable, "unverifiable").when(size != want_size, "failed").when(hash_.isNull(), "unverifiable").when(hash_ == want_hash, "pass").otherwise("failed")


def identity_verdict(known: Column, exists: Column, resolved: Column, same: Column) -> Column:
    """``same``, ``replaced``, ``gone`` or ``unknown``; an identity that was never resolved passes."""
    return F.when(~known, "same").when(~exists, "gone").when(~resolved, "unknown").when(same, "same").otherwise("replaced")


def plan(requested: DataFrame, members: DataFrame, keep_ids: DataFrame) -> DataFrame:
    """``id, ord, outcome``: ``unknown`` and ``keeper`` fail, the content verdict decides the rest; repeats are ignored.

    ``members`` has the columns ``exists_now, readable, now_size, now_hash`` of what was observed.
    """
    once = requested.groupBy("id").agg(F.min("ord").alias("ord"))
    seen = once.join(members, "id", "left").join(keep_ids.select("id", F.lit(True).alias("kept")), "id", "left")
    verdict = content_verdict(F.col("exists_now"), F.col("readable"), F.col("now_size"), F.col("now_hash"), F.col("size"), F.col("hash"))
    return seen.select("id", "ord", F.when(F.col("path").isNull(), "unknown").when(F.col("kept"), "keeper").otherwise(verdict).alias("outcome"))


def accounting(items: DataFrame) -> DataFrame:
    """``op_kind`` sums of done items in four buckets; only deletions and moves to another volume free space."""
    kind, size = F.col("op_kind"), F.col("size")
    bucket = lambda c: F.coalesce(F.sum(F.when(c, size)), F.lit(0))
    frees = (kind == "delete") | ((kind == "move") & F.col("cross_volume"))
    return items.where("state = 'done'").groupBy("op_kind").agg(F.count("*").alias("items"), bucket(frees).alias("reclaimed"), bucket(kind == "hardlink").alias("linked"), bucket(kind == "symlink").alias("symlinked"), bucket(kind == "trash").alias("trashed"))


def regrouped(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Groups after operations: gone members leave, groups of one dissolve, figures are recomputed."""
    left = members.join(gone.select("id").distinct(), "id", "left_anti")
    return dedup.groups(left.select("id", "path", "size", "hash", "actual", "actual_known"))


def summed_failures(failed: DataFrame) -> DataFrame:
    """One line a stage instead of one a failure: ``stage, n, first_path``."""
    return failed.groupBy("stage").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


def undo_check(exists: Column, regular: Column, size: Column, hash_: Column, want_size: Column, want_hash: Column, restored: Column) -> Column:
    """``ready``, ``restored`` (nothing left to do), or why an undo is refused."""
    gone = F.when(restored, "restored").otherwise("gone")
    return F.when(~exists, gone).when(~regular, "irregular").when(size != want_size, "size").when(want_hash.isNotNull() & (hash_ != want_hash), "content").otherwise("ready")


def request_error(kind: Column, confirmed: Column, journal: Column, undoable: Column, selected: Column) -> Column:
    """Why a request is refused before anything is planned; null if it isn't."""
    return F.when((kind == "delete") & ~confirmed, "unconfirmed").when(undoable & ~journal, "no-journal").when(selected == 0, "empty")


def reconciled(before: DataFrame, after: DataFrame, expected: DataFrame) -> DataFrame:
    """``volume_id, before, expected, after, missing`` over all volumes any of the tables ``volume_id, n`` names."""
    zero = F.lit(0).cast("bigint")
    named = [t.select("volume_id", F.col("n").alias(c)) for t, c in ((before, "before"), (expected, "expected"), (after, "after"))]
    out = named[0].join(named[1], "volume_id", "full_outer").join(named[2], "volume_id", "full_outer")
    out = out.select("volume_id", *[F.coalesce(c, zero).alias(c) for c in ("before", "expected", "after")])
    return out.withColumn("missing", F.greatest(zero, F.col("before") + F.col("expected") - F.col("after")))
