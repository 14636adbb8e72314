"""Ledger, import and operation planning over ``orders`` and ``lineitem`` as operations, and ``documents`` as scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import ledger, ops, policy
from tessella.plans.dedup_queries import grouped
from tessella.plans.registry import FILES, GROUPS, LEDGER, query
from tessella.sources import corpus

#: Customers as scans, documents' duplicate sizes aside: groups of a scan are its orders, files their lines.
_SCANS = """scans AS (SELECT c_custkey AS id, c_custkey % 97 AS saved_at, c_mktsegment AS roots FROM customer),
hfiles AS (SELECT o_custkey AS hist_id, l_orderkey AS group_id, '/v' || l_suppkey % 4 || '/p' || l_partkey || '/' || l_linenumber AS path, (l_quantity * 100)::BIGINT AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _ledger(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return corpus.operations(spark, folder)


def _scans(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 97).alias("saved_at"), F.col("c_mktsegment").alias("roots"))


def _hist_files(spark: SparkSession, folder: str) -> DataFrame:
    lines = corpus.table(spark, folder, "lineitem").join(corpus.table(spark, folder, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    path = F.concat(F.lit("/v"), (F.col("l_suppkey") % 4).cast("string"), F.lit("/p"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    return lines.select(F.col("o_custkey").alias("hist_id"), F.col("l_orderkey").alias("group_id"), path.alias("path"), (F.col("l_quantity") * 100).cast("bigint").alias("size"))


@query(f"WITH {_SCANS} SELECT id, saved_at, roots FROM scans ORDER BY saved_at DESC, id DESC")
def history_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.listed(_scans(spark, sf_dir), "saved_at")


@query(f"WITH {_SCANS} SELECT id, saved_at, roots FROM scans ORDER BY id DESC LIMIT 20")
def history_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.retained(_scans(spark, sf_dir))


_PRUNED = f"""{_SCANS}, gone AS (SELECT DISTINCT path FROM hfiles WHERE size % 300 = 0),
alive AS (SELECT * FROM hfiles WHERE path NOT IN (SELECT path FROM gone)),
kept AS (SELECT * FROM alive WHERE (hist_id, group_id) IN (SELECT (hist_id, group_id) FROM alive GROUP BY hist_id, group_id HAVING count(*) >= 2)),
fig AS (SELECT hist_id, group_id, max(size) AS size, count(*) AS n_files, ((count(*) - 1) * max(size))::BIGINT AS reclaimable FROM kept GROUP BY ALL)"""


def _figures(spark: SparkSession, folder: str) -> DataFrame:
    files = _hist_files(spark, folder)
    return ledger.group_figures(ledger.pruned(files, files.where("size % 300 = 0")))


@query(f"WITH {_PRUNED} SELECT * FROM fig")
def history_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _figures(spark, sf_dir)


@query(f"""WITH {_PRUNED} SELECT s.id, count(f.hist_id) AS groups_count, coalesce(sum(n_files), 0)::BIGINT AS files_count, coalesce(sum(reclaimable), 0)::BIGINT AS reclaimable FROM scans s LEFT JOIN fig f ON s.id = f.hist_id GROUP BY s.id""")
def history_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.header(_scans(spark, sf_dir), _figures(spark, sf_dir))


@query(f"WITH {GROUPS}, p AS (SELECT path FROM files WHERE id % 3 = 0) SELECT m.id, m.group_id FROM members m WHERE m.path IN (SELECT path FROM p)")
def history_keep_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m = grouped(spark, sf_dir)
    kept = corpus.documents(spark, sf_dir, False).where("id % 3 = 0").select("path")
    return m.join(kept, "path", "left_semi").select("id", "group_id")


@query(f"""WITH {LEDGER} SELECT o.op_id, o.op_kind, o.created_at, o.undoable, count(i.op_id) AS items, count(*) FILTER (state IN ('done', 'undone', 'undo_failed', 'undoing')) AS done,
  count(*) FILTER (state = 'undone') AS undone, count(*) FILTER (state IN ('failed', 'undo_failed')) AS failed FROM ops o LEFT JOIN items i USING (op_id) GROUP BY ALL""")
def ops_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.op_meta(*_ledger(spark, sf_dir))


@query(f"WITH {LEDGER} SELECT op_id, item_id, orig_path, size, state, cross_volume, op_kind FROM items JOIN ops USING (op_id)")
def ops_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = _ledger(spark, sf_dir)
    return i.join(o.select("op_id", "op_kind"), "op_id")


@query(f"""WITH {LEDGER}, d AS (SELECT * FROM items JOIN ops USING (op_id) WHERE state = 'done')
SELECT op_kind, count(*) AS items, coalesce(sum(size) FILTER (op_kind = 'delete' OR (op_kind = 'move' AND cross_volume)), 0)::BIGINT AS reclaimed, coalesce(sum(size) FILTER (op_kind = 'hardlink'), 0)::BIGINT AS linked,
  coalesce(sum(size) FILTER (op_kind = 'symlink'), 0)::BIGINT AS symlinked, coalesce(sum(size) FILTER (op_kind = 'trash'), 0)::BIGINT AS trashed FROM d GROUP BY op_kind""")
def ops_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = _ledger(spark, sf_dir)
    return ops.accounting(i.join(o.select("op_id", "op_kind"), "op_id"))


_OBSERVED = f"""{GROUPS}, obs AS (SELECT id, group_id, size, hash, keeper, id % 5 <> 1 AS exists_now, id % 7 <> 2 AS readable, CASE WHEN id % 11 = 3 THEN size + 1 ELSE size END AS now_size, CASE WHEN id % 13 = 4 THEN 'x' ELSE hash END AS now_hash FROM members),
verd AS (SELECT *, CASE WHEN NOT exists_now THEN 'skipped' WHEN NOT readable THEN 'unverifiable' WHEN now_size <> size OR now_hash <> hash THEN 'failed' ELSE 'pass' END AS verdict FROM obs)"""


def _observed(members: DataFrame) -> DataFrame:
    i = F.col("id")
    return members.select("id", "path", "size", "hash", (i % 5 != 1).alias("exists_now"), (i % 7 != 2).alias("readable"), F.when(i % 11 == 3, F.col("size") + 1).otherwise(F.col("size")).alias("now_size"), F.when(i % 13 == 4, "x").otherwise(F.col("hash")).alias("now_hash"))


@query(f"WITH {_OBSERVED} SELECT id, verdict FROM verd")
def ops_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _observed(grouped(spark, sf_dir)[1])
    return m.select("id", ops.content_verdict(F.col("exists_now"), F.col("readable"), F.col("now_size"), F.col("now_hash"), F.col("size"), F.col("hash")).alias("verdict"))


@query(f"""WITH {_OBSERVED} SELECT d.doc_id AS id, -d.doc_id AS ord, CASE WHEN v.id IS NULL THEN 'unknown' WHEN v.keeper = v.id THEN 'keeper' ELSE v.verdict END AS outcome FROM documents d LEFT JOIN verd v ON v.id = d.doc_id WHERE d.doc_id % 2 = 0""")
def ops_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, m = grouped(spark, sf_dir)
    some = corpus.table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    twice = some.select("id", (-F.col("id")).alias("ord")).unionByName(some.where("id % 3 = 0").select("id", F.col("id").alias("ord")))
    return ops.plan(twice, _observed(m), g.select(F.col("keeper").alias("id")))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'same' WHEN event_id % 7 = 0 THEN 'gone' WHEN event_id % 11 = 0 THEN 'unknown' WHEN event_id % 13 = 0 THEN 'replaced' ELSE 'same' END AS verdict FROM events""")
def ops_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda k: F.col("event_id") % k != 0
    return corpus.table(spark, sf_dir, "events").select("event_id", ops.identity_verdict(n(5), n(7), n(11), n(13)).alias("verdict"))


@query(f"WITH {LEDGER} SELECT item_id, CASE state WHEN 'planned' THEN 'interrupted' WHEN 'undoing' THEN 'undo_failed' ELSE state END AS state FROM items")
def ops_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.recovered(_ledger(spark, sf_dir)[1]).select("item_id", "state")


@query(f"""WITH {LEDGER} SELECT op_id, count(*) FILTER (state = 'done') AS done_count, count(*) FILTER (state IN ('planned', 'cancelled')) AS cancelled,
  coalesce(sum(size) FILTER (state = 'done' AND (op_kind = 'delete' OR (op_kind = 'move' AND cross_volume))), 0)::BIGINT AS reclaimed FROM ops LEFT JOIN items USING (op_id) GROUP BY op_id""")
def ops_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.finalised(*_ledger(spark, sf_dir))


@query(f"WITH {LEDGER} SELECT item_id, op_id, state FROM items JOIN ops USING (op_id) WHERE undoable AND state IN ('done', 'undo_failed')")
def undo_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.undo_candidates(*_ledger(spark, sf_dir)).select("item_id", "op_id", "state")


@query(f"""WITH {LEDGER} SELECT item_id, CASE WHEN item_id % 5 = 0 THEN CASE WHEN item_id % 2 = 0 THEN 'restored' ELSE 'gone' END WHEN item_id % 7 = 0 THEN 'irregular' WHEN item_id % 11 = 0 THEN 'size'
  WHEN item_id % 3 <> 0 AND item_id % 13 = 0 THEN 'content' ELSE 'ready' END AS outcome FROM items WHERE state = 'done'""")
def undo_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    size = F.when(i % 11 == 0, F.col("size") + 1).otherwise(F.col("size"))
    check = ops.undo_check(i % 5 != 0, i % 7 != 0, size, F.when(i % 13 == 0, "y").otherwise("x"), F.col("size"), F.when(i % 3 != 0, "x"), i % 2 == 0)
    return _ledger(spark, sf_dir)[1].where("state = 'done'").select("item_id", check.alias("outcome"))


@query(f"WITH {LEDGER} SELECT 'op-' || state AS stage, count(*) AS n, min(orig_path) AS first_path FROM items WHERE state IN ('failed', 'undo_failed', 'interrupted') GROUP BY state")
def ops_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _ledger(spark, sf_dir)[1].where(F.col("state").isin("failed", "undo_failed", "interrupted"))
    return ops.summed_failures(failed.select(F.concat(F.lit("op-"), "state").alias("stage"), F.col("orig_path").alias("path")))


@query(f"""WITH {LEDGER}, r AS (SELECT op_id, CASE WHEN op_kind = 'delete' AND op_id % 3 <> 0 THEN 'unconfirmed' WHEN undoable AND op_id % 7 = 0 THEN 'no-journal' WHEN op_id % 5 = 0 THEN 'empty' END AS error FROM ops) SELECT * FROM r WHERE error IS NOT NULL""")
def ops_request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("op_id")
    error = ops.request_error(F.col("op_kind"), n % 3 == 0, n % 7 != 0, F.col("undoable"), n % 5)
    return _ledger(spark, sf_dir)[0].select("op_id", error.alias("error")).where("error is not null")


@query(f"""WITH {LEDGER}, src AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority, o_orderstatus FROM orders),
loc AS (SELECT DISTINCT o_custkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 4 = 0)
SELECT s.o_custkey, s.o_orderpriority, s.o_orderstatus, min(s.id) AS id FROM src s LEFT JOIN loc l ON s.o_custkey = l.o_custkey AND s.o_orderpriority = l.o_orderpriority AND s.o_orderstatus = l.o_orderstatus WHERE l.o_custkey IS NULL GROUP BY ALL""")
def import_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority", "o_orderstatus")
    return ledger.natural_keys(rows, ["o_custkey", "o_orderpriority", "o_orderstatus"], rows.where("id % 4 = 0"))


@query("""WITH m AS (SELECT c_custkey AS old, c_custkey + 1000000 AS new FROM customer WHERE c_custkey % 3 <> 0)
SELECT o_orderkey AS op_id, coalesce(m.new, 0)::BIGINT AS hist_id, m.new IS NULL AND f <> 0 AS orphan FROM (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE o_custkey END AS f FROM orders) LEFT JOIN m ON f = m.old""")
def import_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = corpus.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))
    rows = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("op_id"), F.when(F.col("o_custkey") % 2 == 0, 0).otherwise(F.col("o_custkey")).alias("hist_id"))
    return ledger.remapped(rows, "hist_id", mapping).select("op_id", "hist_id", "orphan")


@query(f"""WITH {LEDGER}, known AS (SELECT DISTINCT '/v' || p_partkey % 4 || '/p' || p_partkey AS path FROM part WHERE p_size > 10),
bad AS (SELECT DISTINCT op_id FROM items JOIN ops USING (op_id) WHERE undoable AND state IN ('done', 'undo_failed') AND NOT starts_with(orig_path, '/v1/') AND orig_path NOT IN (SELECT path FROM known))
SELECT op_id, undoable AND op_id NOT IN (SELECT op_id FROM bad) AS undoable FROM ops""")
def import_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = corpus.table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("/v"), (F.col("p_partkey") % 4).cast("string"), F.lit("/p"), F.col("p_partkey").cast("string")).alias("path"))
    o, i = _ledger(spark, sf_dir)
    return ledger.downgraded(o, i, spark.createDataFrame([("/v1",), ("/w",)], "root string"), known).select("op_id", "undoable")


@query(f"WITH {LEDGER} SELECT count(*) AS items, count(DISTINCT op_id) AS ops FROM items JOIN ops USING (op_id) WHERE undoable AND state IN ('done', 'undo_failed') AND item_id % 17 = 0")
def import_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.lacking_evidence(*_ledger(spark, sf_dir), F.col("item_id") % 17 != 0)


@query(f"""WITH {LEDGER}, j AS (SELECT op_id, string_agg('{{"item_id":' || item_id || ',"orig_path":"' || orig_path || '","size":' || size || ',"state":"' || state || '"}}', ',' ORDER BY item_id, orig_path, size, state) AS s FROM items GROUP BY op_id)
SELECT o.op_id, 0 AS part, '{{"op_id":' || o.op_id || ',"op_kind":"' || op_kind || '","undoable":' || CASE WHEN undoable THEN 'true' ELSE 'false' END || ',"items":[' || coalesce(s, '') || ']}}' AS json FROM ops o LEFT JOIN j USING (op_id)""")
def export_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.mirror(*_ledger(spark, sf_dir))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '  ' ELSE props END AS props FROM events) SELECT event_id, coalesce(nullif(trim(props), ''), '[]') AS props FROM t""")
def ledger_json_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.col("props"))
    return corpus.table(spark, sf_dir, "events").select("event_id", ledger.json_or_empty(blank).alias("props"))


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS id, max(ts) AS ts FROM events GROUP BY user_id, event_type""")
def recycle_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.newest(corpus.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("id"), "ts"), ["user_id", "event_type"], "ts")


@query(f"""WITH {FILES}, b AS (SELECT volume_id, count(*) AS n FROM files WHERE id % 2 = 0 AND volume_id <> 1 GROUP BY 1), e AS (SELECT volume_id, count(*) AS n FROM files WHERE id % 3 = 0 AND volume_id <> 2 GROUP BY 1), a AS (SELECT volume_id, count(*) AS n FROM files WHERE id % 2 = 1 GROUP BY 1),
v AS (SELECT DISTINCT volume_id FROM (SELECT volume_id FROM b UNION ALL SELECT volume_id FROM e UNION ALL SELECT volume_id FROM a))
SELECT v.volume_id, coalesce(b.n, 0) AS before, coalesce(e.n, 0) AS expected, coalesce(a.n, 0) AS after, greatest(0, coalesce(b.n, 0) + coalesce(e.n, 0) - coalesce(a.n, 0)) AS missing FROM v LEFT JOIN b USING (volume_id) LEFT JOIN e USING (volume_id) LEFT JOIN a USING (volume_id)""")
def recycle_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.documents(spark, sf_dir, False)
    count = lambda c: files.where(c).groupBy("volume_id").agg(F.count("*").alias("n"))
    return ops.reconciled(count("id % 2 = 0 and volume_id <> 1"), count("id % 2 = 1"), count("id % 3 = 0 and volume_id <> 2"))


_NAMES = """n AS (SELECT source AS folder, lang || CASE WHEN doc_id % 5 = 0 THEN '_' || doc_id % 9 ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '' END AS name, doc_id AS id FROM documents),
held AS (SELECT DISTINCT source AS folder, lang || CASE WHEN doc_id % 6 = 0 THEN '' ELSE '_' || n_chars % 40 END || CASE WHEN doc_id % 4 = 0 THEN '.txt' ELSE '' END AS name FROM documents WHERE n_chars % 3 = 0)"""


@query(f"""WITH {_NAMES}, k AS (SELECT n.*, row_number() OVER (PARTITION BY folder, name ORDER BY id) - (held.name IS NULL)::INT AS k, regexp_replace(n.name, '\\.[^.]*$', '') AS base, regexp_extract(n.name, '(\\.[^.]*)$', 1) AS ext FROM n LEFT JOIN held USING (folder, name)),
f AS (SELECT folder, base, ext, max(k) AS m FROM k GROUP BY ALL), shut AS (SELECT folder, name FROM n UNION SELECT folder, name FROM held),
tried AS (SELECT folder, base, ext, unnest(range(1, m + 60)) AS i FROM f WHERE m > 0),
free AS (SELECT t.*, row_number() OVER (PARTITION BY folder, base, ext ORDER BY i) AS k FROM tried t ANTI JOIN shut s ON t.folder = s.folder AND t.base || '_' || i || t.ext = s.name)
SELECT k.folder, k.name, k.id, CASE WHEN k.k = 0 THEN k.name ELSE k.base || '_' || free.i || k.ext END AS free_name FROM k LEFT JOIN free USING (folder, base, ext, k)""")
def name_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many files that move to folders where others lie, some under names that numbering would give."""
    docs, text = corpus.table(spark, sf_dir, "documents"), lambda c: c.cast("string")
    end = lambda n: F.when(F.col("doc_id") % n == 0, ".txt").otherwise("")
    names = docs.select(F.col("source").alias("folder"), F.concat("lang", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("_"), text(F.col("doc_id") % 9))).otherwise(""), end(2)).alias("name"), F.col("doc_id").alias("id"))
    held = docs.where("n_chars % 3 = 0").select(F.col("source").alias("folder"), F.concat("lang", F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.concat(F.lit("_"), text(F.col("n_chars") % 40))), end(4)).alias("name"))
    return ledger.numbered_names(names, held)


@query("SELECT l_orderkey, l_linenumber, l_linenumber AS ord, (l_linenumber // 3)::BIGINT AS batch FROM lineitem")
def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("ord"))
    return policy.chunks(lines, 3)
