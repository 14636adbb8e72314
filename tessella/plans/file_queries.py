"""Walks and reads of real files: ``documents`` laid out as a tree in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.operators import dedup, execute, run, scan
from tessella.plans.dedup_queries import CHUNK, SMALL
from tessella.plans.registry import FILES, GROUPS, query
from tessella.sources import corpus
from tessella.sources.contents import OnDisk
from tessella.sources.scratch import drop_folder, mounted_folder, stage
from tessella.sources.walk import Listing, lay_out, walk

#: The same tree for the oracle: every thirteenth name begins with a low line; what a walk without hidden files sees of it.
_TREE = """{files}, tree AS (SELECT * REPLACE (CASE WHEN id % 13 = 5 THEN regexp_replace(path, '/([^/]*)$', '/_\\1') ELSE path END AS path, CASE WHEN id % 13 = 5 THEN '_' || name ELSE name END AS name) FROM files WHERE size IS NOT NULL),
walked AS (SELECT * FROM tree WHERE NOT contains(path, '/.h/') AND NOT starts_with(path, '/src1/de/') AND NOT contains(path, '/fr/'))"""
_WALKED = _TREE.format(files=FILES)


def _filters(folder: str) -> scan.Filters:
    return scan.Filters(exclude=["fr"], exclude_dirs=[f"{folder}/src1/de"])


def _with_tree(spark: SparkSession, sf_dir: str, use: Callable[[str, Listing], DataFrame]) -> DataFrame:
    """What ``use`` makes of the walked tree, written before the tree is deleted."""
    files = corpus.documents(spark, sf_dir)
    low = F.when(F.col("id") % 13 == 5, F.concat(paths.folder(F.col("path")), F.lit("/_"), paths.base_name(F.col("path")))).otherwise(F.col("path"))
    folder = mounted_folder(spark, "tree")
    lay_out(files.where("content is not null").select(low.alias("path"), "content"), folder)
    out = stage(use(folder, walk(spark, [folder], _filters(folder))), "tree-result")
    drop_folder(spark, folder)
    return out


@query(f"WITH {_WALKED} SELECT substr(path, 2) AS rel, name, ext, size, true AS takes_room FROM walked")
def files_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that isn't below a hidden, excluded or named directory, also those whose names begin with a low line."""
    return _with_tree(spark, sf_dir, lambda folder, found: found.files.select("rel", "name", "ext", "size", (F.col("actual_known") & (F.col("actual") >= 0)).alias("takes_room")))


@query(f"""WITH {_WALKED} SELECT '/' || d AS folder, reason, count(DISTINCT d) AS n FROM (SELECT unnest([
  {{'d': regexp_extract(substr(path, 2), '^[^/]*/\\.h'), 'reason': 'hidden'}}, {{'d': regexp_extract(substr(path, 2), '^src1/de'), 'reason': 'excluded'}},
  {{'d': CASE WHEN NOT contains(path, '/.h/') THEN regexp_extract(substr(path, 2), '^[^/]*/fr') ELSE '' END, 'reason': 'excluded'}}], recursive := true) FROM tree) WHERE d <> '' GROUP BY ALL""")
def files_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that a walk doesn't enter."""

    def use(folder: str, found: Listing) -> DataFrame:
        return found.pruned.select(F.substr("path", F.lit(len(folder) + 1)).alias("folder"), "reason").groupBy("folder", "reason").agg(F.count("*").alias("n"))

    return _with_tree(spark, sf_dir, use)


def _run(folder: str, found: Listing, exact: bool = False) -> run.Result:
    config = run.Config([folder], _filters(folder), exact, chunk=CHUNK, small=SMALL)
    return run.run(found.files, config, OnDisk())


_FOUND = GROUPS.replace(FILES, "@").replace("FROM files", "FROM walked").replace("@", _WALKED)


@query(f"WITH {_FOUND}, rel AS (SELECT size, hash, min(path) AS first_path FROM members0 GROUP BY ALL) SELECT hash, g.size, n_files, reclaimable, substr(r.first_path, 2) AS first_rel FROM grp g JOIN rel r USING (size, hash)")
def files_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate groups of files on disk, from the walk to the hash."""

    def use(folder: str, found: Listing) -> DataFrame:
        return _run(folder, found).groups.select("hash", "size", "n_files", "reclaimable", F.substr("first_path", F.lit(len(folder) + 2)).alias("first_rel"))

    return _with_tree(spark, sf_dir, use)


@query(f"""WITH {_WALKED}, s AS (SELECT * FROM walked WHERE size > 0 AND size IN (SELECT size FROM walked GROUP BY size HAVING count(*) > 1)),
h AS (SELECT *, CASE WHEN size <= {SMALL} THEN [hex(encode(text))] ELSE [substr(hex(encode(text)), 1, {2 * CHUNK}), substr(hex(encode(text)), 2 * least(size // 2, size - {CHUNK}) + 1, {2 * CHUNK}),
  substr(hex(encode(text)), 2 * least(size * 3 // 4, size - {CHUNK}) + 1, {2 * CHUNK}), substr(hex(encode(text)), 2 * (size - {CHUNK}) + 1, {2 * CHUNK})] END AS parts FROM s),
b AS (SELECT * FROM h WHERE size > {SMALL} QUALIFY count(*) OVER (PARTITION BY size, parts) > 1),
m AS (SELECT * FROM s WHERE (size, hash) IN (SELECT (size, hash) FROM s GROUP BY size, hash HAVING count(*) > 1))
SELECT 'prefilter' AS stage, count(*) AS files, coalesce(sum(CASE WHEN size <= {SMALL} THEN size ELSE 4 * {CHUNK} END), 0)::BIGINT AS bytes FROM s
UNION ALL SELECT 'hash', count(*), coalesce(sum(size), 0)::BIGINT FROM b UNION ALL SELECT 'verify', count(*), coalesce(sum(size), 0)::BIGINT FROM m""")
def files_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files each stage opened and how many bytes it read: sizes of their own are never opened, small files never twice before they are compared."""
    return _with_tree(spark, sf_dir, lambda folder, found: _run(folder, found, True).reads)


@query(f"WITH {_WALKED} SELECT substr(path, 2) AS rel, substr(min(path) OVER (PARTITION BY size, hash), 2) AS first_rel FROM walked WHERE size > 0")
def files_tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their hash, those over 4 KiB hashed in ranges of 4 KiB that are put together."""

    def use(folder: str, found: Listing) -> DataFrame:
        hashed = stage(OnDisk(4096).hashes(found.files.where("size > 0").select("id", "path", "rel", "size")), "tree-hashes")
        first = hashed.groupBy("size", "hash").agg(F.min("rel").alias("first_rel"))
        return hashed.join(first, ["size", "hash"]).select("rel", "first_rel")

    return _with_tree(spark, sf_dir, use)


@query(f"""WITH {_WALKED}, s AS (SELECT *, substr(min(path) OVER (PARTITION BY size, text), 2) AS first_rel FROM walked WHERE size > 0)
SELECT substr(path, 2) AS rel, first_rel FROM s WHERE size IN (SELECT size FROM s GROUP BY size HAVING count(*) > 1)""")
def files_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of a shared size compared with each other, block by block, with no hash of the whole."""

    def use(folder: str, found: Listing) -> DataFrame:
        sized = stage(dedup.shared(found.files.where("size > 0").select("id", "path", "rel", "size"), ["size"]).withColumn("hash", F.lit("")), "tree-sized")
        parts = stage(dedup.compared(sized, OnDisk(), block=256, growth=4)[0], "tree-parts")
        return parts.join(parts.groupBy("part").agg(F.min("rel").alias("first_rel")), "part").select("rel", "first_rel")

    return _with_tree(spark, sf_dir, use)


#: What is done with a duplicate, by its extension.
KINDS = {".txt": "delete", ".md": "hardlink", ".log": "symlink", ".tmp": "move"}
_KIND_SQL = "CASE ext WHEN '.txt' THEN 'delete' WHEN '.md' THEN 'hardlink' WHEN '.log' THEN 'symlink' WHEN '.tmp' THEN 'move' ELSE 'trash' END"
_LEFT = f"""WITH {_FOUND}, m AS (SELECT substr(path, 2) AS rel, size, {_KIND_SQL} AS kind, row_number() OVER (PARTITION BY size, hash ORDER BY octet_length(encode(path)), path) = 1 AS keeps FROM members0)"""


def _executed(spark: SparkSession, folder: str, found: Listing) -> tuple[DataFrame, DataFrame]:
    """The members of all groups, and what came of all but the keepers."""
    result = _run(folder, found)
    m = result.members.select("id", "path", "ext", "size", "volume_id", "file_index", "hash", "keeper")
    first = m.where("id = keeper").select(F.col("keeper"), F.col("path").alias("kept"))
    kind = F.lit("trash")
    for ext, name in KINDS.items():
        kind = F.when(F.col("ext") == ext, name).otherwise(kind)
    plan = m.where("id <> keeper").join(first, "keeper").select("id", kind.alias("kind"), "path", "size", "volume_id", "file_index", "hash", F.col("kept").alias("keeper"))
    plan = plan.withColumn("target", F.when(F.col("kind") == "move", f"{folder}/moved").otherwise(f"{folder}/bin"))
    return m, execute.execute(plan, f"{folder}-journal")


@query(f"""{_LEFT} SELECT kind, 'ok' AS outcome, count(*) AS items, sum(CASE WHEN kind IN ('delete', 'hardlink', 'symlink') THEN size ELSE 0 END)::BIGINT AS freed FROM m WHERE NOT keeps GROUP BY kind""")
def files_executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates deleted, linked, moved and put in a bin, each by its extension."""

    def use(folder: str, found: Listing) -> DataFrame:
        done = _executed(spark, folder, found)[1]
        drop_folder(spark, f"{folder}-journal")
        return done.groupBy("kind", "outcome").agg(F.count("*").alias("items"), F.sum("freed").alias("freed"))

    return _with_tree(spark, sf_dir, use)


@query(f"{_LEFT} SELECT rel, NOT keeps AND kind = 'symlink' AS symlink, NOT keeps AND kind = 'hardlink' AS linked FROM m WHERE keeps OR kind IN ('hardlink', 'symlink')")
def files_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second walk finds at the places of all members after the operations: keepers, and links to them."""

    def use(folder: str, found: Listing) -> DataFrame:
        m, done = _executed(spark, folder, found)
        kept = m.where("id = keeper").select(F.col("file_index").alias("kept_index"), "hash", "size")
        now = walk(spark, [folder], _filters(folder)).files.select("path", "rel", "kind", F.col("file_index").alias("now_index"))
        met = m.join(kept, ["hash", "size"]).join(now, "path")
        drop_folder(spark, f"{folder}-journal")
        return met.select("rel", (F.col("kind") == "symlink").alias("symlink"), ((F.col("now_index") == F.col("kept_index")) & (F.col("id") != F.col("keeper"))).alias("linked"))

    return _with_tree(spark, sf_dir, use)


@query(f"{_LEFT} SELECT 'restored' AS outcome, kind, count(*) AS items FROM m WHERE NOT keeps AND kind <> 'delete' GROUP BY kind")
def files_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations taken back: all files but deleted ones are at their places again with their contents."""

    def use(folder: str, found: Listing) -> DataFrame:
        m, done = _executed(spark, folder, found)
        back = execute.undo(done, f"{folder}-journal")
        again = OnDisk().hashes(m.join(back.where("outcome = 'restored'").select("id"), "id").select("id", "path", "size", F.col("hash").alias("was")))
        right = again.where("hash = was").select("id")
        drop_folder(spark, f"{folder}-journal")
        return back.join(right, "id").join(done.select("id", "kind"), "id").groupBy("outcome", "kind").agg(F.count("*").alias("items"))

    return _with_tree(spark, sf_dir, use)
