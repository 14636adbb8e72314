"""Composed scans, reads and records, outcomes, journal, loading and merging of ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import classify, formats, paths, records
from tessella.operators import actions, cache, dedup, ledger, policy, run, scan
from tessella.operators.rank import parts_for
from tessella.plans.dedup_queries import CHUNK, SMALL, cache_rows, grouped
from tessella.plans.registry import FILES, GROUPS, LEDGER, query
from tessella.plans.scan_queries import _DIRS_SQL, _IN, dirs
from tessella.sources import corpus, export
from tessella.sources.scratch import drop_folder, shared_folder, stage


def _every(n: int) -> Column:
    return F.col("id") % n == 0


# --- a composed scan ------------------------------------------------------------------------------

_HIDDEN = "regexp_matches(path, '/\\.[^./]')"
_SEEN = f"""{FILES}, seen AS (SELECT *, CASE WHEN NOT regexp_matches(path, '^/(src1|src2|src10)/') THEN 'outside' WHEN id % 19 = 0 THEN 'cloud' WHEN id % 17 = 0 THEN 'symlink' WHEN size = 0 THEN 'empty'
  WHEN size < 40 OR {_HIDDEN} OR ext = '.tmp' OR starts_with(path, '/src1/de/') THEN 'filtered' END AS reason FROM files)"""
_RUN = GROUPS.replace(FILES, _SEEN).replace("SELECT * FROM files WHERE size > 0 AND", "SELECT * FROM seen WHERE reason IS NULL AND").replace("FROM files WHERE size > 0 GROUP BY", "FROM seen WHERE reason IS NULL GROUP BY")


def _run(spark: SparkSession, folder: str, exact: bool = False) -> run.Result:
    files = corpus.documents(spark, folder).withColumn("kind", F.when(_every(17), "symlink").otherwise("file")).withColumn("flags", F.when(_every(19), 0x00400000).otherwise(32))
    filters = scan.Filters(min_size=40, exclude=["*.tmp"], exclude_dirs=["/src1/de"])
    return run.run(files, run.Config(["/src1", "/src2/en", "/src2", "/src10/"], filters, exact, "windows", "app", CHUNK, SMALL))


@query(f"WITH {_RUN} SELECT group_id, hash, size, n_files, reclaimable, keeper FROM grp")
def run_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).groups.select("group_id", "hash", "size", "n_files", "reclaimable", "keeper")


@query(f"WITH {_RUN} SELECT id, group_id, path FROM members")
def run_members_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, True).members.select("id", "group_id", "path")


@query(f"WITH {_SEEN} SELECT id, path, reason, 'scan' AS stage FROM seen WHERE reason IS NOT NULL")
def run_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).rejects


@query(f"WITH {_SEEN} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, sum(size)::BIGINT AS bytes FROM seen GROUP BY ALL")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).counters


@query(f"""WITH {GROUPS}, h AS (SELECT m.*, CASE WHEN id % 5 = 0 THEN min(id) OVER (PARTITION BY m.size, m.hash) ELSE id END AS handle, id % 7 <> 0 AS open FROM members m),
one AS (SELECT size, hash, arg_min(path, lpad(octet_length(encode(path))::VARCHAR, 9, '0') || path) AS path, arg_min(id, path) AS id FROM h WHERE open GROUP BY size, hash, handle
  UNION ALL SELECT size, hash, path, id FROM h WHERE NOT open)
SELECT id, path FROM one WHERE (size, hash) IN (SELECT (size, hash) FROM one GROUP BY size, hash HAVING count(*) > 1)""")
def dedup_bucket_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth member turns out, once open, to be the file with its group's smallest id."""
    m = grouped(spark, sf_dir)[1].select("id", "path", "size", "hash")
    least = m.groupBy("size", "hash").agg(F.min("id").alias("least"))
    handle = F.struct(F.lit(1).alias("volume_id"), F.when(_every(5), F.col("least")).otherwise(F.col("id")).alias("file_index"), (~_every(7)).alias("resolved"))
    return dedup.collapse_in_bucket(m.join(least, ["size", "hash"]).select("id", "path", "size", "hash", handle.alias("handle"))).select("id", "path")


# --- reads and records ----------------------------------------------------------------------------


@query(f"""WITH {FILES}, d AS (SELECT id, size AS there, size + (id % 4) * 700 AS declared FROM files WHERE size > 0), o AS (SELECT *, greatest(declared - 512, 0) AS last FROM d),
p AS (SELECT *, [0, least(declared // 2, last), least(declared * 3 // 4, last), last] AS spots FROM o),
r AS (SELECT *, list_transform(spots, lambda a: greatest(0, least(512, there - a))) AS n FROM p),
e AS (SELECT *, list_filter(list_transform(list_zip(spots, n), lambda z: CASE WHEN z[2] < 512 THEN z[1] + z[2] END), lambda x: x IS NOT NULL) AS ends FROM r)
SELECT id, declared, (CASE WHEN len(ends) = 0 THEN declared WHEN n[1] >= 512 THEN greatest(list_min(ends), 512) ELSE list_min(ends) END)::BIGINT AS length FROM e""")
def read_true_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are shorter than a listing said, read at the places that the listing gives."""
    d = corpus.documents(spark, sf_dir, False).where("size > 0").select("id", F.col("size").alias("there"), (F.col("size") + F.col("id") % 4 * 700).alias("declared"))
    zero = F.lit(0).cast("bigint")
    reads = F.transform(records.sample_offsets(F.col("declared"), CHUNK), lambda at: F.greatest(zero, F.least(F.lit(CHUNK).cast("bigint"), F.col("there") - at)))
    return d.select("id", "declared", records.true_length(F.col("declared"), reads, CHUNK).cast("bigint").alias("length"))


@query("SELECT o_orderkey AS id, CASE WHEN d < 0 THEN 'negative' WHEN t > d THEN 'grown' END AS problem FROM (SELECT o_orderkey, o_custkey % 200 - 5 AS d, o_custkey % 210 AS t FROM orders)")
def read_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), records.read_problem(F.col("o_custkey") % 200 - 5, F.col("o_custkey") % 210).alias("problem"))


def _record(path: Column, filetime: Column, version: Column, long: Column) -> Column:
    """A deletion record: the layouts differ in how wide the number of UTF-16 units is and where the path starts."""
    little = lambda n, width: F.substring(F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n.cast("bigint")), 16, "0"), F.lit("(..)"), F.lit(1))), "")), 1, width)
    text = F.concat(F.encode(path, "UTF-16LE"), F.unhex(F.lit("0000")))
    units = F.octet_length(text) / 2
    head = F.concat(little(version, 8), little(F.lit(4096), 8), little(filetime, 8))
    return F.concat(head, F.when(long, F.concat(little(units, 8), text)).otherwise(F.concat(little(units, 4), text)))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    pages = corpus.table(spark, folder, "pages").where("url is not null")
    path = F.concat(F.lit("C:\\"), F.translate("url", "/", "\\"))
    raw = _record(path, F.col("page_id") * 10_000_000 + records.CLOCK_START, F.when(F.col("page_id") % 5 == 0, 7).otherwise(F.col("page_id") % 2 + 1), F.lit(False))
    raw = F.when(F.col("page_id") % 3 == 0, F.substring(raw, 1, 40)).otherwise(raw)
    return pages.select(F.col("page_id").alias("id"), raw.alias("content"))


@query("""SELECT page_id AS id, CASE WHEN ok THEN 'C:\\' || replace(url, '/', '\\') END AS path, CASE WHEN ok THEN page_id * 10000000 + 116444736000000000 END AS filetime
FROM (SELECT page_id, url, page_id % 5 <> 0 AND page_id % 3 <> 0 AS ok FROM pages WHERE url IS NOT NULL)""")
def recycle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth record has a version that nobody knows, every third breaks off."""
    return _records(spark, sf_dir).select("id", records.deletion_record(F.col("content")).alias("r")).select("id", "r.path", "r.filetime")


@query("""WITH w AS (SELECT lower(replace('C:/' || url, '/', '\\')) AS key, max('C:/' || url) AS path FROM pages WHERE page_id % 4 <> 0 AND url IS NOT NULL GROUP BY 1),
e AS (SELECT lower('C:\\' || replace(url, '/', '\\')) AS key, page_id FROM pages WHERE url IS NOT NULL AND page_id % 5 <> 0 AND page_id % 3 <> 0 AND page_id > 7)
SELECT w.path, '/bin/s/$R' || max(page_id) || '.bin' AS file FROM w JOIN e USING (key) GROUP BY w.path""")
def recycle_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = corpus.table(spark, sf_dir, "pages").where("page_id % 4 <> 0 and url is not null").select(F.concat(F.lit("C:/"), "url").alias("path"))
    held = _records(spark, sf_dir).select("id", records.deletion_record(F.col("content")).alias("r")).where("r is not null")
    named = held.select("r.path", "r.filetime", F.concat(F.lit("/bin/s/$I"), F.col("id").cast("string"), F.lit(".bin")).alias("file"))
    return actions.wanted_records(wanted, named, F.lit(8 * 10_000_000 + records.CLOCK_START))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 'off' ELSE 'on' END WHEN 1 THEN 'unknown' WHEN 2 THEN 'off' WHEN 3 THEN 'off' ELSE 'unknown' END AS state,
  CASE event_id % 6 WHEN 0 THEN 'missing:2' WHEN 1 THEN 'path-missing:3' WHEN 2 THEN 'denied:5' WHEN 3 THEN 'in-use:32' WHEN 4 THEN 'full:112' ELSE 'other:124' END AS reason FROM events""")
def recycle_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    e = F.col("event_id")
    state = records.setting_state(pick([None, "wrong-type", "key-missing", "path-missing", "denied"], e), e % 2)
    return corpus.table(spark, sf_dir, "events").select("event_id", state.alias("state"), records.shell_reason(pick([2, 3, 5, 32, 112, 124], e)).alias("reason"))


_ODD_PATHS = "CASE id % 9 WHEN 0 THEN '/proc' || path WHEN 1 THEN '/process' || path WHEN 2 THEN '/run/x' || path WHEN 3 THEN '/a/WindowsApps' || path WHEN 4 THEN '/private/var/db' || path WHEN 5 THEN '/System' ELSE path END"


@query(f"""WITH {FILES}, p AS (SELECT id, {_ODD_PATHS} AS path, CASE WHEN id % 4 = 0 THEN 'PageFile.sys' ELSE name END AS name FROM files)
SELECT id, path, starts_with(path, '/proc/') OR starts_with(path, '/run/') AS linux, starts_with(path, '/private/var/db/') OR path = '/System' AS darwin,
  contains(path, '/WindowsApps/') AS windows, name = 'PageFile.sys' AS root_file FROM p""")
def scan_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, path = F.col("id") % 9, F.col("path")
    odd = F.when(k == 5, "/System")
    for n, top in ((0, "/proc"), (1, "/process"), (2, "/run/x"), (3, "/a/WindowsApps"), (4, "/private/var/db")):
        odd = odd.when(k == n, F.concat(F.lit(top), path))
    out = corpus.documents(spark, sf_dir, False).select("id", odd.otherwise(path).alias("path"), F.when(_every(4), "PageFile.sys").otherwise(F.col("name")).alias("name"))
    windows = F.exists(F.split("path", "/"), lambda s: classify.protected_dir(s, "windows"))
    sides = [classify.protected_path(F.col("path"), p).alias(p) for p in ("linux", "darwin")]
    return out.select("id", "path", *sides, windows.alias("windows"), classify.protected_root_file(F.col("name"), "windows").alias("root_file"))


# --- outcomes and journal -------------------------------------------------------------------------

_STATES = f"""{LEDGER}, s AS (SELECT item_id, op_id, orig_path, size, op_kind, CASE WHEN item_id % 11 = 0 THEN 'gone' WHEN item_id % 13 = 0 THEN 'replaced' WHEN item_id % 17 = 0 THEN 'unknown' ELSE 'same' END AS ident,
  CASE WHEN item_id % 7 = 0 THEN 'failed' WHEN item_id % 19 = 0 THEN 'skipped' WHEN item_id % 23 = 0 THEN 'unverifiable' ELSE 'pass' END AS content,
  CASE WHEN item_id % 29 = 0 THEN NULL WHEN item_id % 31 = 0 THEN 'failed' ELSE 'pass' END AS keeper, CASE WHEN item_id % 37 = 0 THEN 'privilege' WHEN item_id % 41 = 0 THEN 'missing' WHEN item_id % 43 = 0 THEN 'denied' END AS done,
  item_id % 5 = 0 AS vanished, item_id % 2 = 0 AS confirmed, item_id % 3 = 0 AS strict FROM items JOIN ops USING (op_id))"""
_OUTCOMES = f"""{_STATES}, o AS (SELECT *, CASE op_kind
  WHEN 'trash' THEN CASE WHEN vanished AND confirmed THEN 'ok' WHEN vanished AND strict THEN 'failed:trash' WHEN vanished OR ident = 'gone' THEN 'skipped' WHEN ident <> 'same' THEN 'failed:verify' WHEN done IS NOT NULL THEN 'failed:trash' ELSE 'ok' END
  WHEN 'move' THEN CASE WHEN ident = 'gone' THEN 'skipped' WHEN ident <> 'same' THEN 'failed:verify' WHEN done IS NOT NULL THEN 'failed:act' ELSE 'ok' END
  WHEN 'delete' THEN CASE WHEN ident = 'gone' THEN 'skipped' WHEN ident <> 'same' THEN 'failed:verify' WHEN content = 'skipped' THEN 'skipped' WHEN content <> 'pass' THEN 'failed:verify' WHEN done = 'missing' THEN 'skipped' WHEN done IS NOT NULL THEN 'failed:act' ELSE 'ok' END
  ELSE CASE WHEN keeper IS NULL THEN 'failed:keeper' WHEN ident = 'gone' THEN 'skipped' WHEN ident <> 'same' THEN 'failed:verify' WHEN content = 'skipped' THEN 'skipped' WHEN content <> 'pass' OR keeper <> 'pass' THEN 'failed:verify'
    WHEN op_kind = 'symlink' AND done = 'privilege' THEN 'failed:privilege' WHEN done IS NOT NULL THEN 'failed:act' ELSE 'ok' END END AS outcome FROM s)"""


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    o, items = corpus.operations(spark, folder)
    n = lambda k: F.col("item_id") % k == 0
    ident = F.when(n(11), "gone").when(n(13), "replaced").when(n(17), "unknown").otherwise("same")
    content = F.when(n(7), "failed").when(n(19), "skipped").when(n(23), "unverifiable").otherwise("pass")
    keeper = F.when(n(29), F.lit(None).cast("string")).when(n(31), "failed").otherwise("pass")
    done = F.when(n(37), "privilege").when(n(41), "missing").when(n(43), "denied")
    parts = parts_for(items, items.count())
    return items.repartition(parts, "op_id").join(o.select("op_id", "op_kind").repartition(parts, "op_id"), "op_id").withColumn("outcome", actions.outcome(F.col("op_kind"), ident, content, keeper, done, n(5), n(2), n(3)))


@query(f"WITH {_OUTCOMES} SELECT item_id, op_kind, outcome FROM o")
def ops_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("item_id", "op_kind", "outcome")


@query(f"WITH {_OUTCOMES} SELECT item_id, outcome AS stage, CASE WHEN outcome = 'failed:privilege' THEN 'needs privilege' ELSE 'item ' || item_id END AS err FROM o WHERE starts_with(outcome, 'failed')")
def ops_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _outcomes(spark, sf_dir).where("outcome like 'failed%'").select("item_id", F.col("outcome").alias("stage"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("err"))
    return actions.one_stage_summed(failed, "failed:privilege", "needs privilege")[0]


@query(f"WITH {_OUTCOMES} SELECT 'failed:privilege' AS stage, count(*) AS n FROM o WHERE outcome = 'failed:privilege' HAVING count(*) > 0")
def ops_failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _outcomes(spark, sf_dir).where("outcome like 'failed%'").select("item_id", F.col("outcome").alias("stage"), F.lit("").alias("err"))
    return actions.one_stage_summed(failed, "failed:privilege", "needs privilege")[1]


_JOURNAL = f"{_OUTCOMES}, p AS (SELECT DISTINCT op_id, orig_path || '#' || item_id || '#' || size AS orig_path, size, item_id, outcome FROM o)"


def _journal(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    made = _outcomes(spark, folder).select("op_id", F.concat_ws("#", "orig_path", F.col("item_id").cast("string"), F.col("size").cast("string")).alias("orig_path"), "size", "item_id", "outcome").distinct()
    made = stage(made, "journal")
    _, items = actions.begun(corpus.operations(spark, folder)[0], made)
    state = F.when(F.col("outcome") == "ok", "done").when(F.col("outcome") == "skipped", "skipped").otherwise("failed")
    results = made.where("item_id % 10 <> 0").select("op_id", "orig_path", F.concat(F.lit("/t"), "orig_path").alias("dest_path"), F.lit("").alias("link_src"), state.alias("state"), F.col("outcome").alias("err"))
    stray = results.where("state = 'skipped'").withColumn("orig_path", F.concat("orig_path", F.lit("?")))
    return actions.finished(items, results.unionByName(stray), parts_for(made, made.count()))


@query(f"""WITH {_JOURNAL} SELECT op_id, orig_path, CASE WHEN item_id % 10 = 0 THEN '' ELSE '/t' || orig_path END AS dest_path, '' AS link_src, size,
  CASE WHEN item_id % 10 = 0 THEN 'planned' WHEN outcome = 'ok' THEN 'done' WHEN outcome = 'skipped' THEN 'skipped' ELSE 'failed' END AS state, CASE WHEN item_id % 10 = 0 THEN '' ELSE outcome END AS err FROM p""")
def ops_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _journal(spark, sf_dir)[0]


@query(f"WITH {_JOURNAL} SELECT op_id, orig_path || '?' AS orig_path FROM p WHERE item_id % 10 <> 0 AND outcome = 'skipped'")
def ops_journal_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of which the journal knows nothing: here of skipped files under another name."""
    return _journal(spark, sf_dir)[1].select("op_id", "orig_path")


@query(f"WITH {LEDGER} SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'undone' WHEN item_id % 3 = 1 AND item_id % 2 = 0 THEN 'undo_failed' ELSE state END AS state FROM items")
def undo_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = corpus.operations(spark, sf_dir)[1].withColumn("err", F.lit(""))
    i = F.col("item_id")
    results = items.select("item_id", F.when(i % 3 == 0, "undone").when((i % 3 == 1) & (i % 2 == 0), "undo_failed").alias("state"), F.lit("").alias("err")).where("state is not null").distinct()
    return actions.marked_undo(items, results).select("item_id", "state")


@query(f"WITH {LEDGER} SELECT op_id, CASE op_kind WHEN 'trash' THEN 'in-bin' WHEN 'move' THEN 'moved' WHEN 'delete' THEN 'freed' WHEN 'hardlink' THEN 'linked' ELSE 'one-copy' END AS fate FROM ops")
def ops_fate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.operations(spark, sf_dir)[0].select("op_id", actions.fate(F.col("op_kind")).alias("fate"))


@query(f"WITH {LEDGER} SELECT op_id, op_kind, created_at FROM ops ORDER BY created_at DESC, op_id DESC")
def ops_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = corpus.operations(spark, sf_dir)[0].withColumnRenamed("op_id", "id")
    return ledger.listed(o, "created_at").select(F.col("id").alias("op_id"), "op_kind", "created_at")


# --- guards, selections, views --------------------------------------------------------------------


@query(f"""WITH {FILES} SELECT id, CASE WHEN starts_with(path, '/src2/en/') OR path = '/src2/en' THEN '/src2/en/' WHEN starts_with(path, '/src2/') THEN '/src2' WHEN starts_with(path, '/src1/') THEN '/src1' END AS root FROM files""")
def guard_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir, False).select("id", actions.enclosing_root(F.col("path"), ["/src2/en/", "/src2", "/src1"]).alias("root"))


@query(f"""WITH {FILES}, {_DIRS_SQL}, f AS (SELECT id, CASE WHEN id % 6 <> 0 THEN path END AS path FROM files)
SELECT f.id, f.path AS landing, count(d.dir) > 0 AS granted FROM f LEFT JOIN dirs d ON {_IN} GROUP BY f.id, f.path""")
def guard_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth landing can't be resolved."""
    targets = corpus.documents(spark, sf_dir, False).select("id", F.when(~_every(6), F.col("path")).alias("landing"))
    return actions.landings(targets, scan.distinct_dirs(dirs(spark)))


@query("SELECT * FROM (VALUES (0, '/a'), (3, '/b'), (4, '/a'), (5, ' ')) t(dir_ord, dir)")
def dirs_to_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda rows: spark.createDataFrame(rows, "dir_ord int, dir string")
    return actions.warm_dirs(made([(0, "/a"), (3, "/b")]), made([(0, "/a"), (1, " ")]))


@query(f"WITH {GROUPS} SELECT id FROM members WHERE id <> keeper AND id % 2 = 0")
def selection_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, m = grouped(spark, sf_dir)
    before = corpus.table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    return actions.replayed(before.unionByName(before), m, g.select(F.col("keeper").alias("id")))


@query(f"""WITH {GROUPS}, c AS (SELECT group_id, min_by(id, path) AS explicit FROM members WHERE id % 3 = 0 GROUP BY group_id)
SELECT m.group_id, m.id, m.path, m.name, m.size, m.mtime_ns, CASE WHEN m.resolved THEN 'vid:' || m.volume_id ELSE 'root:' || string_split(m.path, '/')[2] END AS volume, m.resolved AS volume_resolved,
  m.id = coalesce(c.explicit, m.keeper) AS is_keep, m.id % 2 = 0 AS is_pending FROM members m LEFT JOIN c USING (group_id)""")
def results_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, m = grouped(spark, sf_dir)
    kept = policy.keepers(g, m.where("id % 3 = 0").select("group_id", F.col("id").alias("keep_id")), m)
    files = corpus.documents(spark, sf_dir, False)
    whole = m.select("id", "group_id").join(files, "id")
    return actions.group_view(whole, kept, files.where("id % 2 = 0").select("id"))


@query(f"WITH {GROUPS} SELECT m.id, m.path, m.size, m.group_id, NULL::VARCHAR AS reason FROM members m ORDER BY m.group_id, m.path, m.id LIMIT 30 OFFSET 30")
def pending_page_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, m = grouped(spark, sf_dir)
    rows = m.select("id", F.col("id").alias("ord"), F.lit(None).cast("string").alias("reason"))
    return policy.pending_page(rows, m, g, "group", 1, 30)


@query("SELECT s.s_suppkey AS id, s.s_nationkey % 3 <> 0 AND c.c_custkey % 4 <> 0 AND s.s_nationkey = c.c_nationkey AS same FROM supplier s JOIN customer c ON s.s_suppkey = c.c_custkey")
def rule_same_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = corpus.table(spark, sf_dir, "supplier").join(corpus.table(spark, sf_dir, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    return both.select(F.col("s_suppkey").alias("id"), actions.same_volume(F.col("s_nationkey"), F.col("s_nationkey") % 3 != 0, F.col("c_nationkey"), F.col("c_custkey") % 4 != 0).alias("same"))


# --- loading and merging ledgers ------------------------------------------------------------------

_HIST = """hgroups AS (SELECT o_custkey AS hist_id, o_orderkey AS id, o_orderkey % 100 AS ord FROM orders),
hfiles AS (SELECT o_custkey AS hist_id, l_orderkey AS group_id, l_orderkey * 8 + l_linenumber AS id, '/v' || l_suppkey % 4 || '/p' || l_partkey || '.' || CASE l_linenumber % 3 WHEN 0 THEN 'TXT' WHEN 1 THEN 'md' ELSE '' END AS path, (l_quantity * 100)::BIGINT AS size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 30)"""


def _hist(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = corpus.table(spark, folder, "orders")
    groups = orders.select(F.col("o_custkey").alias("hist_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100).alias("ord"))
    lines = corpus.table(spark, folder, "lineitem").where("l_quantity > 30").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ending = F.when(F.col("l_linenumber") % 3 == 0, "TXT").when(F.col("l_linenumber") % 3 == 1, "md").otherwise("")
    path = F.concat(F.lit("/v"), (F.col("l_suppkey") % 4).cast("string"), F.lit("/p"), F.col("l_partkey").cast("string"), F.lit("."), ending)
    return groups, lines.select(F.col("o_custkey").alias("hist_id"), F.col("l_orderkey").alias("group_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), path.alias("path"), (F.col("l_quantity") * 100).cast("bigint").alias("size"))


@query(f"""WITH {_HIST}, n AS (SELECT hist_id, group_id, count(*) AS n_files FROM hfiles GROUP BY ALL)
SELECT f.hist_id, f.group_id, f.id, f.path, f.size, g.ord, n.n_files, CASE WHEN ends_with(f.path, 'TXT') THEN '.txt' WHEN ends_with(f.path, 'md') THEN '.md' ELSE '.' END AS ext, f.size AS actual, false AS actual_known
FROM hfiles f JOIN hgroups g ON f.group_id = g.id JOIN n ON n.group_id = f.group_id""")
def history_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.loaded(*_hist(spark, sf_dir))[0]


@query(f"WITH {_HIST} SELECT hist_id, id AS group_id FROM hgroups WHERE id NOT IN (SELECT group_id FROM hfiles)")
def history_load_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.loaded(*_hist(spark, sf_dir))[1]


@query(f"""WITH {_HIST}, s AS (SELECT id FROM (SELECT DISTINCT hist_id AS id FROM hgroups UNION ALL SELECT 99999999) ORDER BY id DESC LIMIT 20)
SELECT hist_id, count(*) AS n FROM (SELECT hist_id FROM hfiles UNION ALL SELECT 99999999 FROM range(3)) WHERE hist_id IN (SELECT id FROM s) GROUP BY hist_id""")
def history_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are left when a scan of three files is appended to the ledger."""
    groups, files = _hist(spark, sf_dir)
    local = {"scan_history": groups.select(F.col("hist_id").alias("id")).distinct(), "hist_groups": groups, "hist_files": files}
    new = spark.createDataFrame([(99999999,)], "id bigint")
    one = spark.createDataFrame([(99999999, 1, 0)], "hist_id bigint, id bigint, ord bigint")
    three = spark.createDataFrame([(99999999, 1, k, f"/n{k}", 5) for k in range(3)], "hist_id bigint, group_id bigint, id bigint, path string, size bigint")
    return ledger.saved(local, new, one, three)["hist_files"].groupBy("hist_id").agg(F.count("*").alias("n"))


#: Customers as scans and orders as operations of a foreign ledger; every fourth scan and every fifth operation is known here.
_FOREIGN = f"""{LEDGER}, fs AS (SELECT c_custkey AS id, c_custkey % 50 AS saved_at, c_mktsegment AS roots, c_nationkey::VARCHAR AS filters, c_custkey % 3 AS orig_files FROM customer),
ls AS (SELECT DISTINCT saved_at, roots, filters, orig_files FROM fs WHERE id % 4 = 0),
ns AS (SELECT saved_at, roots, filters, orig_files, min(id) AS id FROM fs WHERE (saved_at, roots, filters, orig_files) NOT IN (SELECT (saved_at, roots, filters, orig_files) FROM ls) GROUP BY ALL),
fo AS (SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS created_at, ops.op_kind, o_orderpriority AS target_dir, o_custkey % 5 AS reclaimed, undoable, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 10000000 WHEN o_custkey % 2 = 0 THEN 0 ELSE o_custkey END AS hist_id FROM orders JOIN ops ON o_orderkey = op_id),
lo AS (SELECT DISTINCT created_at, op_kind, target_dir, reclaimed FROM fo WHERE id % 5 = 0),
nk AS (SELECT min(id) AS id FROM fo WHERE (created_at, op_kind, target_dir, reclaimed) NOT IN (SELECT (created_at, op_kind, target_dir, reclaimed) FROM lo) GROUP BY created_at, op_kind, target_dir, reclaimed),
no AS (SELECT fo.* FROM fo JOIN nk USING (id)),
bad AS (SELECT DISTINCT op_id FROM items JOIN ops USING (op_id) WHERE undoable AND state IN ('done', 'undo_failed') AND NOT starts_with(orig_path, '/v1/') AND NOT starts_with(orig_path, '/v2/'))"""


def _ledgers(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    c = corpus.table(spark, folder, "customer")
    text = lambda x="": F.lit(x)
    zero = F.lit(0).cast("bigint")
    scans = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50).alias("saved_at"), F.col("c_mktsegment").alias("roots"), F.col("c_nationkey").cast("string").alias("filters"), F.lit(4).alias("threads"), F.lit(False).alias("paranoid"), zero.alias("groups_count"), zero.alias("files_count"), (F.col("c_custkey") % 3).alias("orig_files"), zero.alias("reclaimable"), text("[]").alias("failed_json"), text("[]").alias("keep_paths"))
    groups, files = _hist(spark, folder)
    groups = groups.withColumn("hash", F.unhex(F.sha2(F.col("id").cast("string"), 256))).withColumn("size", zero).withColumn("reclaimable", zero)
    files = files.withColumn("mtime_ns", zero)
    o, items = corpus.operations(spark, folder)
    orders = corpus.table(spark, folder, "orders").select(F.col("o_orderkey").alias("op_id"), "o_custkey", "o_orderpriority")
    link = F.when(F.col("op_id") % 10 == 0, F.col("o_custkey") + 10_000_000).when(F.col("o_custkey") % 2 == 0, 0).otherwise(F.col("o_custkey"))
    ops = o.join(orders, "op_id").select(F.col("op_id").alias("id"), "op_kind", "created_at", F.col("o_orderpriority").alias("target_dir"), link.alias("hist_id"), "undoable", zero.alias("done_count"), (F.col("o_custkey") % 5).alias("reclaimed"))
    items = items.select(F.col("item_id").alias("id"), "op_id", "orig_path", text().alias("dest_path"), text().alias("link_src"), F.unhex(F.sha2("orig_path", 256)).alias("hash"), "size", zero.alias("mtime_ns"), "state", text().alias("err"))
    foreign = {"scan_history": scans, "hist_groups": groups, "hist_files": files, "op_records": ops, "op_items": items}
    own = lambda name, n: foreign[name].where(F.col("id") % n == 0).withColumn("id", F.col("id") + 1_000_000_000)
    local = {"scan_history": own("scan_history", 4), "op_records": own("op_records", 5)} | {name: foreign[name].limit(0) for name in ("hist_groups", "hist_files", "op_items")}
    return local, foreign


def _merged(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    local, foreign = _ledgers(spark, folder)
    return ledger.merged_import(local, foreign, spark.createDataFrame([("/v1",), ("/v2",)], "root string"), spark.createDataFrame([], "path string"))


@query(f"""WITH {_FOREIGN} SELECT (SELECT count(*) FROM ns) AS scans_added, (SELECT count(*) FROM fs) - (SELECT count(*) FROM ns) AS scans_skipped, (SELECT count(*) FROM no) AS ops_added, (SELECT count(*) FROM fo) - (SELECT count(*) FROM no) AS ops_skipped,
  (SELECT count(*) FROM no WHERE hist_id <> 0 AND hist_id NOT IN (SELECT id FROM fs)) AS ops_orphaned, (SELECT count(*) FROM no WHERE undoable AND id IN (SELECT op_id FROM bad)) AS ops_downgraded""")
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[1]


@query(f"""WITH {_FOREIGN}, top AS (SELECT coalesce(max(id) + 1000000000, 0) AS n FROM fo WHERE id % 5 = 0)
SELECT (SELECT n FROM top) + row_number() OVER (ORDER BY id) AS id, op_kind, created_at, target_dir, reclaimed, undoable AND id NOT IN (SELECT op_id FROM bad) AS undoable FROM no""")
def import_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0]["op_records"].select("id", "op_kind", "created_at", "target_dir", "reclaimed", "undoable")


@query(f"""WITH {_FOREIGN}, {_HIST} SELECT count(*) AS files, count(DISTINCT f.group_id) AS groups, sum(f.size)::BIGINT AS bytes FROM hfiles f JOIN hgroups g ON f.group_id = g.id WHERE f.hist_id IN (SELECT id FROM ns)""")
def import_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _merged(spark, sf_dir)[0]["hist_files"]
    return files.agg(F.count("*").alias("files"), F.count_distinct("group_id").alias("groups"), F.sum("size").alias("bytes"))


@query(f"""WITH {LEDGER}, {_HIST}, h AS (SELECT op_id, item_id, orig_path, size, state FROM items)
SELECT 'scan_history' AS name, count(*) AS n, sum(c_custkey)::BIGINT AS ids, count(DISTINCT c_mktsegment) AS texts, 0::BIGINT AS bytes FROM customer
UNION ALL SELECT 'hist_groups', count(*), sum(id)::BIGINT, count(DISTINCT id), 0 FROM hgroups UNION ALL SELECT 'hist_files', count(*), sum(id)::BIGINT, count(DISTINCT path), sum(size)::BIGINT FROM hfiles
UNION ALL SELECT 'op_records', count(*), sum(op_id)::BIGINT, count(DISTINCT op_kind), 0 FROM ops UNION ALL SELECT 'op_items', count(*), sum(item_id)::BIGINT, count(DISTINCT orig_path), sum(size)::BIGINT FROM h""")
def export_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole ledger exported, and read again by its manifest."""
    import uuid

    folder = f"{shared_folder(spark)}/tessella-exports/{uuid.uuid4().hex}"
    joined = ("hist_files", "op_records")  # the others are columns of a table
    tables = {name: stage(t, "ledger") if name in joined else t for name, t in _ledgers(spark, sf_dir)[1].items()}
    export.write_export(tables, folder, compression="gzip")
    back = export.read_export(spark, folder)
    drop_folder(spark, folder)
    text = {"scan_history": "roots", "hist_groups": "id", "hist_files": "path", "op_records": "op_kind", "op_items": "orig_path"}
    out = None
    for name, t in back.items():
        size = F.sum("size") if name in ("hist_files", "op_items") else F.lit(0)
        one = t.agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.count_distinct(text[name]).alias("texts"), size.cast("bigint").alias("bytes")).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# --- texts of other programs ----------------------------------------------------------------------


@query(f"""WITH {FILES} SELECT id, '[Trash Info]' || chr(10) || 'Path=' || replace(path, ' ', '%20') || chr(10) || 'DeletionDate=' || strftime(to_timestamp(mtime_ns // 1000000000)::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') || chr(10) AS info FROM files""")
def trash_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.documents(spark, sf_dir, False)
    return files.select("id", paths.trash_info(F.col("path"), F.timestamp_seconds(F.floor(F.col("mtime_ns") / 1_000_000_000))).alias("info"))


@query("""SELECT event_id, json_valid(text) AS valid FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props || '}' WHEN 1 THEN '[' || event_id || ', "x"]' WHEN 2 THEN '{"a": ' ELSE props END AS text FROM events WHERE props IS NOT NULL)""")
def ledger_json_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, props = F.col("event_id") % 4, F.col("props")
    text = F.when(k == 0, F.concat(props, F.lit("}"))).when(k == 1, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(', "x"]'))).when(k == 2, '{"a": ').otherwise(props)
    return corpus.table(spark, sf_dir, "events").where("props is not null").select("event_id", ledger.json_valid(text).alias("valid"))


@query("""SELECT o_orderkey AS id, CASE WHEN n <= 0 THEN '-' WHEN n < 1024 THEN n || ' B/s' WHEN n < 1048576 THEN printf('%.1f', round(n / 1024, 1)) || ' KiB/s' ELSE printf('%.1f', round(n / 1048576, 1)) || ' MiB/s' END AS speed FROM (SELECT o_orderkey, o_custkey % 7 * o_orderkey * 3 - 100 AS n FROM orders)""")
def fmt_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_custkey") % 7 * F.col("o_orderkey") * 3 - 100
    return corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), formats.speed(n).alias("speed"))


@query("SELECT event_id, event_id % 5 IN (0, 3) AS busy FROM events")
def err_busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[F.lit(x) for x in ("Database is LOCKED (5)", "database disk image is malformed", "", "SQLITE_BUSY: retry", "locked door")])
    return corpus.table(spark, sf_dir, "events").select("event_id", classify.busy(F.element_at(texts, (F.col("event_id") % 5 + 1).cast("int"))).alias("busy"))


@query(f"WITH {FILES}, c AS (SELECT * FROM files WHERE id % 8 <> 0) SELECT 'cleared' AS cache, 0 AS entries, 0 AS with_full UNION ALL SELECT 'snapshot', count(*), count(*) FILTER (id % 3 = 0) FROM c")
def cache_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, kept = cache.cleared(cache_rows(spark, sf_dir))
    return cache.stats(now).select(F.lit("cleared").alias("cache"), "*").unionByName(cache.stats(kept).select(F.lit("snapshot").alias("cache"), "*"))


@query(f"WITH {GROUPS} SELECT group_id, 3 AS status FROM grp")
def report_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of a report of a scan that couldn't read a file."""
    g, m = grouped(spark, sf_dir)
    return dedup.report(g, m.drop("group_id", "keeper"), failed=1).select("group_id", "status")
