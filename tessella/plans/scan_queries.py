"""Scans, predicates and path rules over ``documents`` as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import classify, formats, paths
from tessella.operators import actions, scan
from tessella.operators.rank import within
from tessella.plans.registry import FILES, query
from tessella.sources import corpus

ROOTS = ["/src1", "/src2/en", "/src2", "/src10/"]
DIRS = [(0, "/src3/en"), (1, "/src3"), (2, " /src4/ "), (3, ""), (4, "/src3"), (5, "/src99"), (6, "/src0/de")]
_DIRS_SQL = "dirs(dir_ord, dir) AS (VALUES (0, '/src3/en'), (1, '/src3'), (2, '/src4'), (5, '/src99'), (6, '/src0/de'))"
_IN = "(f.path = d.dir OR starts_with(f.path, d.dir || '/'))"


def files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    return corpus.documents(spark, folder, content)


def dirs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIRS, "dir_ord int, dir string")


@query(f"WITH {FILES} SELECT DISTINCT path, name, ext, size FROM files WHERE size > 0")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("size > 0").select("path", "name", "ext", "size").dropDuplicates(["path"])


@query("""WITH r AS (SELECT DISTINCT '/' || source AS root FROM documents WHERE doc_id % 3 = 0 UNION SELECT DISTINCT '/' || source || '/' || lang FROM documents WHERE doc_id % 5 = 0)
SELECT r.root, (SELECT min_by(t.root, length(t.root)) FROM r t WHERE starts_with(r.root, t.root || '/')) AS covered_by FROM r""")
def scan_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents")
    some = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("/"), "source", F.lit("//")).alias("root"))
    return scan.normal_roots(some.unionByName(docs.where("doc_id % 5 = 0").select(F.concat_ws("/", F.lit(""), "source", "lang").alias("root"))))


@query(f"""WITH {FILES} SELECT id, CASE WHEN starts_with(path, '/src1/') THEN substr(path, 7) WHEN starts_with(path, '/src2/en/') THEN substr(path, 10)
  WHEN starts_with(path, '/src2/') THEN substr(path, 7) WHEN starts_with(path, '/src10/') THEN substr(path, 8) ELSE name END AS rel,
  CASE WHEN starts_with(path, '/src1/') THEN 0 WHEN starts_with(path, '/src2/en/') THEN 1 WHEN starts_with(path, '/src2/') THEN 2 WHEN starts_with(path, '/src10/') THEN 3 ELSE -1 END AS root_ord FROM files""")
def scan_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel, number = scan.relative(F.col("path"), ROOTS)
    return files(spark, sf_dir).select("id", rel.alias("rel"), number.alias("root_ord"))


_GATED = f"""WITH {FILES}, g AS (SELECT id, CASE WHEN id % 29 = 0 THEN '/vol/$Recycle.Bin' || path ELSE path END AS path,
  CASE WHEN id % 31 = 0 THEN 'con.txt' WHEN id % 23 = 0 THEN name || '.app-old.undo' ELSE name END AS name,
  CASE WHEN id % 17 = 0 THEN 'symlink' WHEN id % 41 = 0 THEN 'socket' ELSE 'file' END AS kind, CASE WHEN id % 19 = 0 THEN 4194304 ELSE 32 END AS flags, CASE WHEN id % 37 = 0 THEN 0 ELSE size END AS size FROM files),
r AS (SELECT *, CASE WHEN id % 29 = 0 THEN 'protected' WHEN id % 31 = 0 THEN 'reserved' WHEN id % 23 = 0 THEN 'temporary' WHEN id % 19 = 0 THEN 'cloud'
  WHEN kind = 'symlink' THEN 'symlink' WHEN kind <> 'file' THEN 'irregular' WHEN size = 0 THEN 'empty' END AS reason FROM g) """


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = lambda n: F.col("id") % n == 0
    out = files(spark, sf_dir).select(
        "id",
        F.when(every(29), F.concat(F.lit("/vol/$Recycle.Bin"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(every(31), "con.txt").when(every(23), F.concat("name", F.lit(".app-old.undo"))).otherwise(F.col("name")).alias("name"),
        F.when(every(17), "symlink").when(every(41), "socket").otherwise("file").alias("kind"),
        F.when(every(19), 0x00400000).otherwise(32).alias("flags"),
        F.when(every(37), 0).otherwise(F.col("size")).alias("size"),
    )
    return out.withColumn("reason", scan.reject_reason(F.col("path"), F.col("name"), F.col("kind"), F.col("flags"), F.col("size"), "app", "windows"))


@query(_GATED + "SELECT id, reason FROM r WHERE reason IS NOT NULL")
def scan_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).where("reason is not null").select("id", "reason")


@query(_GATED + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, sum(size)::BIGINT AS bytes FROM r GROUP BY ALL")
def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"""WITH {FILES}, z AS (SELECT id, size, volume_id, actual_known, CASE WHEN id % 9 = 0 OR volume_id = 3 THEN 0 ELSE actual END AS actual FROM files),
v AS (SELECT volume_id, bool_or(actual_known AND actual > 0) AS t FROM z GROUP BY volume_id)
SELECT id, v.t AS trusts_zero, CASE WHEN actual_known AND (actual > 0 OR v.t) THEN actual ELSE size END AS disk_bytes FROM z JOIN v USING (volume_id)""")
def scan_actual_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = files(spark, sf_dir).withColumn("actual", F.when((F.col("id") % 9 == 0) | (F.col("volume_id") == 3), 0).otherwise(F.col("actual")))
    return scan.with_actual_bytes(odd).select("id", "trusts_zero", "disk_bytes")


@query(f"WITH {FILES} SELECT count(*) AS files, sum(size)::BIGINT AS bytes, sum(least(size, 262144))::BIGINT AS prefilter_bytes FROM files WHERE size > 0")
def scan_byte_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.byte_totals(files(spark, sf_dir))


@query(f"""WITH {FILES} SELECT volume_id, ext, count(*) AS n, sum(size)::BIGINT AS bytes FROM files GROUP BY ALL""")
def scan_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy("volume_id", "ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("""SELECT page_id AS id, substr(hex(encode(html)), 1, 8192) AS head, octet_length(encode(html))::BIGINT AS size, sha256(html) AS digest FROM pages""")
def scan_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("id"), F.hex(formats.preview(F.encode("html", "UTF-8"))).alias("head"), F.octet_length("html").cast("bigint").alias("size"), F.sha2("html", 256).alias("digest"))


@query("""SELECT source, max(s) AS worst, CASE max(s) WHEN 3 THEN 2 WHEN 2 THEN 2 ELSE 8 END AS workers FROM (SELECT source, CASE doc_id % 40 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END AS s FROM documents) GROUP BY source""")
def scan_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 40
    media = F.when(m == 0, "network").when(m.isin(1, 2), "rotational").otherwise("ssd")
    worst = corpus.table(spark, sf_dir, "documents").groupBy("source").agg(F.max(classify.severity(media)).alias("worst"), F.max_by(media, classify.severity(media)).alias("class"))
    return worst.select("source", "worst", classify.media_workers(F.col("class"), F.lit(8)).alias("workers"))


def _filtered(spark: SparkSession, sf_dir: str, f: scan.Filters) -> DataFrame:
    rel = F.substr("path", F.lit(2))
    return files(spark, sf_dir).where(f.column(rel, F.col("path"), F.col("name"), F.col("ext"), F.col("size"))).select("id", "path")


def _kept(condition: str) -> str:
    return f"WITH {FILES} SELECT id, path FROM (SELECT *, substr(path, 2) AS rel FROM files) WHERE {condition}"


_SHOWN = "NOT regexp_matches(path, '/\\.[^./]')"


@query(_kept(f"size >= 500 AND size <= 5000 AND {_SHOWN} AND ext IN ('.txt', '.log') AND ext NOT IN ('.log')"))
def filter_size_ext_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, scan.Filters(500, 5000, [" TXT", "log "], [".LOG", ""]))


@query(_kept(f"{_SHOWN} AND len(list_filter(string_split(rel, '/'), lambda s: regexp_full_match(s, '[^/]*\\.tmp') OR s = 'de')) = 0"))
def filter_glob_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, scan.Filters(exclude=["*.tmp", "de", "[z-"]))


@query(_kept("NOT regexp_matches('/' || rel, '^/src1(?:/[^/]*)*/[^/]*\\.md$')"))
def filter_glob_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, scan.Filters(exclude=["src1/**/*.md"], hidden=True))


@query(_kept("rel <> 'src2/en' AND NOT starts_with(rel, 'src2/en/')"))
def filter_glob_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, scan.Filters(exclude=["src2\\en"], hidden=True))


@query(_kept("NOT regexp_matches('/' || rel, '^/src[0-4]/e[^/]/[^/]*$')"))
def filter_glob_single_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, scan.Filters(exclude=["src[0-4]/e?/*"], hidden=True))


@query("SELECT * FROM (VALUES ('[z-', 'exclude'), ('a/[]/b', 'exclude')) t(pattern, stage)")
def filter_bad_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(scan.Filters(exclude=["*.tmp", "[z-", "a/[]/b", "**/x"]).rejects(), "pattern string, stage string")


@query("SELECT * FROM (VALUES ('node_modules', true), ('a/b', true), ('a/b/**', true), ('a/*/b', false), ('*.tmp', true), ('**/x', false), ('a/**/b', false)) t(pattern, prunable)")
def filter_prunable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p, paths.prunable(p)) for p in ("node_modules", "a/b", "a/b/**", "a/*/b", "*.tmp", "**/x", "a/**/b")], "pattern string, prunable boolean")


@query(_kept("NOT (path = '/src3' OR starts_with(path, '/src3/') OR starts_with(path, '/src1/en/'))"))
def filter_exclude_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, scan.Filters(exclude_dirs=["/src3/", "/src1/en"], hidden=True))


@query(f"""WITH {FILES}, {_DIRS_SQL} SELECT f.id, min(d.dir_ord) AS dir_ord, min_by(d.dir, d.dir_ord) AS dir FROM files f JOIN dirs d ON {_IN} GROUP BY f.id""")
def filter_in_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.in_dirs(files(spark, sf_dir), scan.distinct_dirs(dirs(spark))).select("id", "dir_ord", "dir")


@query(f"""WITH {FILES}, {_DIRS_SQL}, l AS (SELECT volume_id AS list, path, row_number() OVER (PARTITION BY volume_id ORDER BY path) - 1 AS position FROM files)
SELECT DISTINCT f.list, f.position, f.path FROM l f JOIN dirs d ON {_IN}""")
def filter_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in each volume's list of paths, in path order, that lie in the chosen directories."""
    listed = within(files(spark, sf_dir).select(F.col("volume_id").alias("list"), "path"), ["list"], [F.col("path")], "k")
    return actions.positions_in(listed.select("list", (F.col("k") - 1).alias("position"), "path"), dirs(spark))


@query(f"""WITH {FILES} SELECT id, lower(path) AS folded, (lower(path) = '/src2' OR starts_with(lower(path), '/src2/')) AS inside FROM files WHERE path <> lower(path)""")
def filter_fold_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = F.lower("path")
    return files(spark, sf_dir).where(F.col("path") != folded).select("id", folded.alias("folded"), paths.under(folded, F.lit("/src2")).alias("inside"))


@query("""SELECT page_id AS id, rtrim(replace(regexp_replace(url, '^https?:/', ''), chr(92), '/'), '/') AS clean, regexp_matches(url, '^(/|[A-Za-z]:)') AS absolute,
  regexp_replace(regexp_replace(url, '^https?:/', ''), '/[^/]*$', '') AS parent FROM pages""")
def path_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_replace("url", "^https?:/", "")
    return corpus.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), paths.trim_tail(paths.slash(p)).alias("clean"), paths.absolute(F.col("url")).alias("absolute"), paths.folder(p).alias("parent"))


@query(f"""WITH {FILES} SELECT id, ext, name = ext AS all_extension, regexp_replace(name, '\\.[^.]*$', '') || '.app-restored' || regexp_extract(name, '(\\.[^.]*)$', 1) AS restored FROM files""")
def path_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("id", "ext", (F.col("name") == F.col("ext")).alias("all_extension"), F.concat(paths.drop_extension(F.col("name")), F.lit(".app-restored"), F.regexp_extract("name", r"(\.[^.]*)$", 1)).alias("restored"))


@query(f"""WITH {FILES} SELECT id, CASE WHEN resolved THEN 'vid:' || volume_id ELSE 'root:' || string_split(path, '/')[2] END AS volume FROM files""")
def path_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("id", classify.volume_label(F.col("volume_id"), F.col("resolved"), F.col("path")).alias("volume"))


@query("""SELECT conv_id, turn, length(text) + len(list_filter(string_split(text, ''), lambda c: unicode(c) > 65535)) AS units FROM conversations""")
def path_utf16_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", paths.utf16_units(F.col("text")).alias("units"))


@query("""SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9._~/-]$') THEN c
  ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END), '') AS encoded FROM documents""")
def path_percent_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select("doc_id", paths.percent_encode(F.col("text")).alias("encoded"))


@query("""SELECT doc_id, b, (length(h) / 2)::BIGINT AS n_bytes, CASE WHEN h = '' THEN true ELSE
  1 - len(list_filter(range(0, length(h) // 2), lambda k: regexp_matches(substr(h, (2 * k + 1)::BIGINT, 2), '^(0[0-8BCEF]|1.|7F)$'))) / (length(h) / 2) > 0.85 END AS is_text
FROM (SELECT doc_id, 0 AS b, left(hex(encode(text)), 8192) AS h FROM documents UNION ALL SELECT doc_id, 1, upper(sha256(text)) FROM documents)""")
def content_is_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, and 32 bytes that are none: the first ``formats.JUDGED`` bytes decide."""
    docs = corpus.table(spark, sf_dir, "documents")
    both = docs.select("doc_id", F.lit(0).alias("b"), F.substring(F.encode("text", "UTF-8"), 1, formats.JUDGED).alias("data")).unionByName(docs.select("doc_id", F.lit(1).alias("b"), F.unhex(F.sha2("text", 256)).alias("data")))
    return both.select("doc_id", "b", F.octet_length("data").cast("bigint").alias("n_bytes"), formats.likely_text(F.col("data")).alias("is_text"))


@query("""WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
r AS (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + 15) // 16)) AS k FROM h WHERE h <> ''),
c AS (SELECT doc_id, k, list_transform(range(0, least(16, length(h) // 2 - 16 * k)), lambda j: lower(substr(h, (2 * (16 * k + j) + 1)::BIGINT, 2))) AS c FROM r)
SELECT doc_id, k AS line_no, printf('%08x', k * 16) || '  ' || rpad(array_to_string(c, ' ') || ' ', 48, ' ') || ' |' ||
  array_to_string(list_transform(c, lambda x: CASE WHEN x >= '20' AND x < '7f' THEN chr(('0x' || x)::INTEGER) ELSE '.' END), '') || '|' AS line FROM c""")
def content_hex_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bytes of every text, by pieces, so a long text's lines are never all in memory."""
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    cut = docs.select("doc_id", F.posexplode(formats.pieces(F.col("data"))).alias("piece", "data")).withColumn("start", F.col("piece").cast("bigint") * formats.PIECE)
    lines = cut.select("doc_id", "start", F.posexplode(formats.hex_rows(F.col("data"), F.col("start"))).alias("k", "line"))
    return lines.select("doc_id", (F.shiftright("start", 4) + F.col("k")).alias("line_no"), "line")
