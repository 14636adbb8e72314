"""Staged exact-duplicate detection.

Each stage removes what can't be a duplicate before the next, dearer one:
sizes, physical identity, four sample hashes, the full hash, a comparison. Contents
are asked for by the ids that are left. Counts are
aggregated before they are shuffled and joined back, so a size or a content
that very many files share is one row per task, not one partition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.rank import ranked
from tessella.sources.contents import CHUNK, SAMPLES, SMALL, InTable, OnDisk, sample_hashes
from tessella.sources.scratch import drop, stage

Contents = InTable | OnDisk
#: Files of a group that a row of a report or of a decision lists, about.
PART_FILES = 10_000


def shared(df: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Rows whose ``keys`` occur at least ``least`` times."""
    often = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return df.join(often, keys)


def size_candidates(files: DataFrame) -> DataFrame:
    """Files of a size that another has, empty ones left out."""
    return shared(files.where("size > 0"), ["size"])


def collapse_identity(files: DataFrame) -> DataFrame:
    """One row per physical file: the first of its paths gives all columns, but the shortest path is kept.

    Rows whose identity isn't resolved never merge. Afterwards sizes that
    became unique are dropped.
    """
    rest = [c for c in files.columns if c not in ("path", "volume_id", "file_index")]
    known = files.where("coalesce(resolved, false)")
    order = F.struct(F.octet_length("path").alias("n"), F.col("path").alias("path"))
    merged = known.groupBy("volume_id", "file_index").agg(F.min(order)["path"].alias("path"), F.min(F.struct("path", *rest)).alias("m"))
    merged = merged.select("volume_id", "file_index", "path", *[F.col(f"m.{c}").alias(c) for c in rest])
    return shared(merged.select(*files.columns).unionByName(files.where("not coalesce(resolved, false)")), ["size"])


def sampled(files: DataFrame, chunk: int = CHUNK, small: int = SMALL) -> DataFrame:
    """The four samples of each file in place of its content, taken where the content is read."""
    taken = [c.alias(n) for n, c in sample_hashes(F.col("content"), F.col("size"), chunk, small).items()]
    return files.select(*[c for c in files.columns if c != "content"], *taken)


def collapse_in_bucket(members: DataFrame) -> DataFrame:
    """One member per physical file within equal size and hash, for files whose identity was unknown before they were opened.

    ``members`` has ``handle(volume_id, file_index, resolved)``, the identity of the open file. The
    first path stays with the shortest one's name; groups left with one go.
    """
    known = members.where("coalesce(handle.resolved, false)")
    rest = [c for c in members.columns if c not in ("path", "handle", "size", "hash")]
    order = F.struct(F.octet_length("path").alias("n"), F.col("path").alias("path"))
    merged = known.groupBy("size", "hash", "handle").agg(F.min(order)["path"].alias("path"), F.min(F.struct("path", *rest)).alias("m"))
    merged = merged.select("size", "hash", "handle", "path", *[F.col(f"m.{c}").alias(c) for c in rest])
    return shared(merged.select(*members.columns).unionByName(members.where("not coalesce(handle.resolved, false)")), ["size", "hash"])


@dataclass(frozen=True)
class Found:
    """``members`` with their ``hash``; ``rejects(id, path, reason, stage)``; ``reads(stage, files, bytes)``: what was opened."""

    members: DataFrame
    rejects: DataFrame
    reads: DataFrame


def _read(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """What a stage rejected and what it read."""
    opened = rows.where("read_bytes is not null and coalesce(problem, '') <> 'negative'").agg(F.count("*").alias("files"), F.coalesce(F.sum("read_bytes"), F.lit(0)).alias("bytes"))
    return rows.where("problem is not null").select("id", "path", F.col("problem").alias("reason"), F.lit(name).alias("stage")), opened.select(F.lit(name).alias("stage"), "files", "bytes")


def detect(rows: DataFrame, contents: Contents, chunk: int = CHUNK, small: int = SMALL, exact: bool = False, known: Callable[[DataFrame], DataFrame] | None = None) -> Found:
    """Hashed members of all stages: size, identity, samples, full hash and, if ``exact``, a comparison of contents.

    ``rows`` are metadata. Samples are taken of files that share a size, full
    hashes of those that share all samples as well, so a file of a size of its own
    is never opened. A file that turns out shorter than declared goes on with its
    true length; one that can't be read or has grown is a reject. ``known`` may
    give rows with samples a ``cached`` hash, which is then not computed.
    """
    sized = stage(size_candidates(rows), "sized")
    alive = stage(collapse_identity(sized), "alive")
    drop(sized)
    taken = stage(contents.samples(alive, chunk, small), "samples")
    drop(alive)
    rejects, reads = _read(taken, "prefilter")
    fine = taken.where("problem is null and length > 0").withColumn("size", F.col("length")).drop("problem", "length", "read_bytes")
    if known is not None:
        fine = known(fine).withColumn("hash", F.coalesce("hash", "cached")).drop("cached")
    buckets = stage(shared(fine, ["size", *SAMPLES]).drop(*SAMPLES), "buckets")
    hashed = stage(contents.hashes(buckets.where("hash is null").drop("hash")), "hashed")
    bad, opened = _read(hashed, "hash")
    members = buckets.where("hash is not null").unionByName(hashed.where("problem is null").drop("problem", "read_bytes"))
    members = shared(members, ["size", "hash"])
    rejects, reads = rejects.unionByName(bad), reads.unionByName(opened)
    if exact:
        classes, bad, opened = compared(stage(members, "members"), contents)
        rejects, reads = rejects.unionByName(bad), reads.unionByName(opened)
        first = classes.groupBy("size", "hash").agg(F.min(F.struct("path", "part"))["part"].alias("part"))
        rejects = rejects.unionByName(classes.join(first, ["size", "hash", "part"], "left_anti").select("id", "path", F.lit("differs").alias("reason"), F.lit("verify").alias("stage")))
        members = shared(classes.join(first, ["size", "hash", "part"]).drop("part"), ["size", "hash"])
    return Found(members, rejects, reads)


def candidates(files: DataFrame, chunk: int = CHUNK, small: int = SMALL) -> DataFrame:
    """Hashed members of files whose contents are a column."""
    return detect(files.drop("content"), InTable(files), chunk, small).members


#: Bytes of the first block that members are compared by; each next one is ``GROWTH`` times as long.
BLOCK, GROWTH = 1 << 18, 4


def compared(members: DataFrame, contents: Contents, block: int = BLOCK, growth: int = GROWTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``members`` with ``part``, the same for equal contents within a ``size`` and ``hash``; rejects, and reads.

    Partition refinement: each round reads a block of all that are left, and
    parts split by its digest. A member that is alone in its part has met its
    first difference and is read no further, so blocks may grow without reading
    much in vain, and rounds are few for long files.
    """
    longest = members.agg(F.max("size").alias("n")).first()["n"] or 0
    state = members.withColumn("part", F.sha2(F.concat_ws("/", F.col("size").cast("string"), "hash"), 256))
    done, at, rejects, reads = None, 0, None, None
    while done is None or at < longest:
        n = F.least(F.lit(block), F.col("size") - at)
        read = stage(contents.proofs(state, F.lit(at).cast("bigint"), n.cast("bigint")), "compared")
        bad, opened = _read(read, "verify")
        rejects, reads = (bad, opened) if rejects is None else (rejects.unionByName(bad), reads.unionByName(opened))
        at, block = at + block, block * growth
        split = read.where("problem is null").withColumn("part", F.sha2(F.concat("part", "proof"), 256)).drop("proof", "problem", "read_bytes")
        often = split.groupBy("part").agg(F.count("*").alias("_n"))
        split = stage(split.join(often, "part"), "parts")
        over = split.where((F.col("_n") < 2) | (F.col("size") <= at)).drop("_n")
        done = over if done is None else done.unionByName(over)
        state = split.where((F.col("_n") > 1) & (F.col("size") > at)).drop("_n")
    reads = reads.groupBy("stage").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    return done.select(*members.columns, "part"), rejects, reads


def hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: F.startswith(s, F.lit(".")) & ~s.isin(".", ".."))


def disk_bytes(size: Column, actual: Column, known: Column) -> Column:
    return F.when(known | (actual > 0), actual).otherwise(size)


def keeper_order(path: str = "path") -> Column:
    """The default keeper is the least: not hidden, then short, then the path itself."""
    return F.struct(hidden(F.col(path)).alias("hidden"), F.octet_length(path).alias("n"), F.col(path).alias("path"))


def groups(members: DataFrame) -> DataFrame:
    """``group_id, hash, size, n_files, reclaimable, reclaimable_actual, actual_known, keeper, first_path``.

    Numbered by reclaimable bytes, then members, both descending, then the
    first path. What the keeper holds on disk doesn't count as reclaimable.
    """
    held = disk_bytes(F.col("size"), F.col("actual"), F.col("actual_known"))
    best = F.min(F.struct(keeper_order().alias("o"), F.col("id").alias("id"), held.alias("held"), F.col("actual_known").alias("known"))).alias("k")
    unknown = F.sum(F.when(F.col("actual_known"), 0).otherwise(1))
    g = members.groupBy("size", "hash").agg(F.count("*").alias("n_files"), F.sum(held).alias("held"), unknown.alias("unknown"), best, F.min("path").alias("first_path")).where("n_files > 1")
    others_unknown = F.col("unknown") - F.when(F.col("k.known"), 0).otherwise(1)
    return numbered(
        g.select(
            "hash",
            "size",
            "n_files",
            ((F.col("n_files") - 1) * F.col("size")).alias("reclaimable"),
            (F.col("held") - F.col("k.held")).alias("reclaimable_actual"),
            (others_unknown == 0).alias("actual_known"),
            F.col("k.id").alias("keeper"),
            "first_path",
        )
    )


def numbered(g: DataFrame) -> DataFrame:
    """``group_id`` 1..N by reclaimable bytes and members, both descending, then the first path."""
    out = ranked(g, [F.col("reclaimable").desc(), F.col("n_files").desc(), F.col("first_path")], "group_id")
    return out.select("group_id", *g.columns)


def members_of(members: DataFrame, g: DataFrame) -> DataFrame:
    """Members with their group's ``group_id`` and ``keeper``."""
    return members.join(g.select("group_id", "hash", "size", "keeper"), ["hash", "size"])


def totals(g: DataFrame) -> DataFrame:
    """``groups, reclaimable, duplicate_files`` (keepers among them)."""
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("duplicate_files"))


def cross_volume(members: DataFrame) -> DataFrame:
    """``group_id, cross_volume``: whether a group's files surely lie on several volumes; not if any one's volume isn't known."""
    return members.groupBy("group_id").agg(((F.min("volume_id") != F.max("volume_id")) & F.bool_and("resolved")).alias("cross_volume"))


def digest(members: DataFrame) -> DataFrame:
    """``digest, n``: a figure of all groups that doesn't depend on any order: the sum of 60 bits of each member's SHA-256 over size, hash and path."""
    own = F.sha2(F.concat_ws("\n", F.col("size").cast("string"), "hash", "path"), 256)
    bits = F.conv(F.substring(own, 1, 15), 16, 10).cast("decimal(38,0)")
    return members.agg(F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("digest"), F.count("*").alias("n"))


def fingerprint(g: DataFrame) -> DataFrame:
    """An exclusive-or over ``group_id`` and size of all groups, and their number."""
    return g.agg(F.coalesce(F.bit_xor(F.col("group_id") * 1000003 + F.col("n_files")), F.lit(0)).alias("fingerprint"), F.count("*").alias("groups"))


def part_of(n: Column, id_col: Column) -> Column:
    """The part, of ``PART_FILES`` or so, that a file falls into in a group of ``n``."""
    return F.pmod(F.xxhash64(id_col), F.ceil(n / PART_FILES)).cast("int")


def report(g: DataFrame, members: DataFrame, failed: int = 0) -> DataFrame:
    """Rows of JSON, one for each group and part of its files, in group order, and the exit status: 3 where something was rejected."""
    held = members.join(g.select("group_id", "hash", "size", "n_files"), ["hash", "size"]).withColumn("part", part_of(F.col("n_files"), F.col("id")))
    files = held.groupBy("group_id", "part").agg(F.sort_array(F.collect_list(F.struct("path", "id", "mtime_ns"))).alias("files"))
    whole = F.struct("group_id", "size", "n_files", "reclaimable", "hash", "files")
    return g.join(files, "group_id").select("group_id", "part", F.to_json(whole).alias("json"), F.lit(3 if failed else 0).alias("status"))
