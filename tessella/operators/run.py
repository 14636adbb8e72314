"""A whole scan in one call: gates, filters, evidence, detection, groups, rejects and counters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import dedup, scan
from tessella.sources.scratch import stage


@dataclass(frozen=True)
class Config:
    """What a scan looks at and how. ``exact``: members' contents are compared as well."""

    roots: Sequence[str]
    filters: scan.Filters = field(default_factory=scan.Filters)
    exact: bool = False
    platform: str = "linux"
    tag: str = "app"
    chunk: int = dedup.CHUNK
    small: int = dedup.SMALL


@dataclass(frozen=True)
class Result:
    """``groups``, their ``members``, ``rejects(id, path, reason, stage)``, ``counters(reason, n, bytes)`` and ``reads(stage, files, bytes)``."""

    groups: DataFrame
    members: DataFrame
    rejects: DataFrame
    counters: DataFrame
    reads: DataFrame


def run(files: DataFrame, config: Config, contents: dedup.Contents | None = None) -> Result:
    """Scan ``files``: metadata, ``kind`` and ``flags``, and ``rel`` and ``root_ord`` or else a path below a root of ``config``.

    ``contents``: where contents are read, by default from the column ``content``.
    They are asked for after gates, filters and the grouping by size.
    """
    contents = contents or dedup.InTable(files)
    seen = files.drop("content")
    if "rel" not in files.columns:
        rel, root = scan.relative(F.col("path"), config.roots)
        seen = seen.withColumn("rel", rel).withColumn("root_ord", root)
    below_root = ~F.col("rel").contains("/")
    gate = scan.reject_reason(F.col("path"), F.col("name"), F.col("kind"), F.col("flags"), F.col("size"), config.tag, config.platform, below_root)
    keep = config.filters.column(F.col("rel"), F.col("path"), F.col("name"), F.col("ext"), F.col("size"), F.col("root_ord"))
    reason = F.when(F.col("root_ord") < 0, "outside").otherwise(F.coalesce(gate, F.when(F.col("size").isNull(), "unreadable"), F.when(~keep, "filtered")))
    seen = stage(seen.withColumn("reason", reason), "seen")
    counters = seen.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    kept = scan.with_actual_bytes(seen.where("reason is null").drop("reason", "rel", "root_ord"))
    kept = kept.withColumn("actual", F.col("disk_bytes")).drop("disk_bytes", "trusts_zero")
    found = dedup.detect(kept, contents, config.chunk, config.small, config.exact)
    members = stage(found.members, "found")
    g = stage(dedup.groups(members), "groups")
    rejects = seen.where("reason is not null").select("id", "path", "reason", F.lit("scan").alias("stage")).unionByName(found.rejects)
    return Result(g, dedup.members_of(members, g), rejects, counters, found.reads)
