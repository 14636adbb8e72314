"""The filtered metadata scan: roots, gates, user filters, counters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import classify, paths


@dataclass(frozen=True)
class Filters:
    """What a user keeps of a scan. A size bound of 0 is off; ``fold``: whether, or below which roots (by number), case makes no difference to patterns."""

    min_size: int = 0
    max_size: int = 0
    include_ext: Sequence[str] = ()
    exclude_ext: Sequence[str] = ()
    exclude: Sequence[str] = ()
    exclude_dirs: Sequence[str] = ()
    hidden: bool = False
    fold: bool | Sequence[int] = False

    def excluded(self, pattern: str, rel: Column, root: Column | None = None) -> Column:
        """Whether a pattern excludes a path below the root of that number."""
        if isinstance(self.fold, bool):
            return paths.excluded(pattern, rel, self.fold)
        if root is None or not self.fold:
            return paths.excluded(pattern, rel)
        return F.when(root.isin(*self.fold), paths.excluded(pattern, rel, True)).otherwise(paths.excluded(pattern, rel))

    def column(self, rel: Column, path: Column, name: Column, ext: Column, size: Column, root: Column | None = None) -> Column:
        """One predicate, so that all of it reaches the scan."""
        keep = F.lit(True)
        if self.min_size > 0:
            keep &= size >= self.min_size
        if self.max_size > 0:
            keep &= size <= self.max_size
        if not self.hidden:
            keep &= ~paths.hidden_segment(rel)
        include, exclude = _extensions(self.include_ext), _extensions(self.exclude_ext)
        if include:
            keep &= ext.isin(*include)
        if exclude:
            keep &= ~ext.isin(*exclude)
        for pattern in self.exclude:
            keep &= ~self.excluded(pattern, rel, root)
        for folder in self.exclude_dirs:
            keep &= ~paths.under(path, paths.dir_key(F.lit(folder)))
        return keep

    def rejects(self) -> list[tuple[str, str]]:
        """``pattern, stage`` of patterns that can't be understood; they exclude nothing."""
        return [(p, "exclude") for p in self.exclude if paths.bad_pattern(p)]


def _extensions(names: Sequence[str]) -> list[str]:
    plain = [n.strip().lower() for n in names]
    return [n if n.startswith(".") else "." + n for n in plain if n]


def normal_roots(roots: DataFrame, root: str = "root") -> DataFrame:
    """``root, covered_by``: distinct cleaned roots; one below another names the topmost that covers it. ``/`` covers all absolute ones."""
    clean = roots.select(paths.cleaned(F.col(root)).alias("root")).distinct().withColumn("key", paths.dir_key(F.col("root")))
    above = clean.select("root", "key", F.explode(paths.ancestors(F.col("root"))).alias("x")).select("root", F.col("x.dir").alias("dir"), F.col("x.depth").alias("depth"), "key").where("dir <> key and root <> '/'").drop("key")
    top = above.join(clean.select(F.col("key").alias("dir"), F.col("root").alias("at")), "dir").groupBy("root").agg(F.min(F.struct("depth", "at"))["at"].alias("covered_by"))
    return clean.drop("key").join(top, "root", "left")


def relative(path: Column, roots: Sequence[str]) -> tuple[Column, Column]:
    """Relative path and number of the first root that holds a path; else its base name and -1."""
    rel, number = F.when(F.lit(False), ""), F.when(F.lit(False), 0)
    for k, root in enumerate(roots):
        inside = F.startswith(path, F.lit(root.rstrip("/") + "/"))
        rel, number = rel.when(inside, F.substr(path, F.lit(len(root.rstrip("/")) + 2))), number.when(inside, k)
    return rel.otherwise(paths.base_name(path)), number.otherwise(-1)


def reject_reason(
    path: Column, name: Column, kind: Column, flags: Column, size: Column, tag: str, platform: str, below_root: Column | None = None,
) -> Column:
    """The first gate that a file fails, in the scan's order; null if it passes all. ``below_root``: whether it is a root's own child."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    guarded = F.exists(folders, lambda x: classify.protected_dir(x, platform)) | classify.protected_path(paths.folder(path), platform)
    child = F.lit(False) if below_root is None else below_root
    reserved = classify.reserved_name(name) if platform == "windows" else F.lit(False)
    return (
        F.when(guarded, "protected")
        .when(reserved, "reserved")
        .when(child & classify.protected_root_file(name, platform), "protected-file")
        .when(classify.work_temp(name, tag), "temporary")
        .when(classify.cloud_placeholder(flags, platform), "cloud")
        .when(kind == "symlink", "symlink")
        .when(kind != "file", "irregular")
        .when(size == 0, "empty")
    )


#: Bytes that four samples of a file read at most.
SAMPLED = 4 * 65536


def byte_totals(files: DataFrame) -> DataFrame:
    """``files, bytes, prefilter_bytes`` of files that aren't empty: how much there is, and what taking samples reads at most."""
    return files.where("size > 0").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum(F.least("size", F.lit(SAMPLED))).alias("prefilter_bytes"))


def with_actual_bytes(files: DataFrame) -> DataFrame:
    """``disk_bytes``: a volume's zeros count once another of its files has reported more than zero; those of an unknown volume never do."""
    known = files.where("volume_id is not null").groupBy("volume_id").agg(F.max(F.coalesce(F.col("actual_known") & (F.col("actual") > 0), F.lit(False))).alias("trusts_zero"))
    out = files.join(known, "volume_id", "left").withColumn("trusts_zero", F.coalesce("trusts_zero", F.lit(False)))
    return out.withColumn("disk_bytes", classify.actual_bytes(F.col("size"), F.col("actual"), F.coalesce("actual_known", F.lit(False)), F.col("trusts_zero")))


def in_dirs(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """``files`` with ``dir_ord, dir``: the first of ``dirs(dir_ord, dir)`` that holds a file, by an equi-join on its ancestors.

    ``/`` holds every absolute path. Directories whose ``fold`` is true, if there
    is such a column, are met without regard to case.
    """
    above = files.select("id", F.explode(paths.ancestors(F.col("path"))["dir"]).alias("key"))
    keyed = dirs.withColumn("key", paths.dir_key(F.col("dir")))
    met = above.join(keyed, "key")
    if "fold" in dirs.columns:
        folded = keyed.where("fold").withColumn("key", F.lower("key"))
        met = above.join(keyed.where("not coalesce(fold, false)"), "key").unionByName(above.withColumn("key", F.lower("key")).join(folded, "key"))
    first = met.groupBy("id").agg(F.min(F.struct("dir_ord", "dir")).alias("m"))
    return files.join(first.select("id", "m.dir_ord", "m.dir"), "id")


def distinct_dirs(dirs: DataFrame) -> DataFrame:
    """``dir_ord, dir`` (and ``fold``, if it is there): cleaned, without blanks, the first spelling of each; spellings differ by case only where ``fold`` is false."""
    clean = dirs.select("dir_ord", F.when(F.trim("dir") != "", paths.cleaned(F.trim("dir"))).alias("dir"), *(["fold"] if "fold" in dirs.columns else [])).where("dir is not null")
    key = F.when(F.col("fold"), F.lower("dir")).otherwise(F.col("dir")) if "fold" in dirs.columns else F.col("dir")
    rest = [c for c in clean.columns if c not in ("dir_ord", "dir")]
    return clean.groupBy(key.alias("k")).agg(F.min(F.struct("dir_ord", "dir", *rest)).alias("m")).select("m.dir_ord", "m.dir", *[f"m.{c}" for c in rest])
