"""How queries and their oracle SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return put


#: ``documents`` as files, for the oracle: the same arithmetic as ``sources.corpus.documents``.
FILES = """files AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext,
  CASE WHEN actual_known THEN size + (4096 - size % 4096) % 4096 ELSE 0 END AS actual FROM (
  SELECT doc_id AS id, '/' || source || CASE WHEN doc_id % 11 = 0 THEN '/.h/' ELSE '/' END || lang || '/' || doc_id ||
    CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.TXT' WHEN 3 THEN '.log' WHEN 4 THEN '.tmp' ELSE '' END AS path,
  octet_length(encode(text))::BIGINT AS size, (1700000000 + doc_id * 7919 % 86400) * 1000000000 AS mtime_ns,
  substr(source, 4)::BIGINT % 4 AS volume_id, doc_id AS file_index, doc_id % 7 <> 0 AS resolved, doc_id % 13 <> 0 AS actual_known, text, sha256(text) AS hash
  FROM documents))"""

#: Members of duplicate groups and the groups, for the oracle; no two rows share a physical identity here.
GROUPS = (
    FILES
    + """,
members0 AS (SELECT * FROM files WHERE size > 0 AND (size, hash) IN (SELECT (size, hash) FROM files WHERE size > 0 GROUP BY size, hash HAVING count(*) > 1)),
ranked AS (SELECT *, len(list_filter(string_split(path, '/'), lambda s: starts_with(s, '.') AND s NOT IN ('.', '..'))) > 0 AS hid,
  CASE WHEN actual_known OR actual > 0 THEN actual ELSE size END AS held FROM members0),
kept AS (SELECT *, row_number() OVER (PARTITION BY size, hash ORDER BY hid, octet_length(encode(path)), path) AS k FROM ranked),
grp0 AS (SELECT hash, size, count(*) AS n_files, (count(*) - 1) * size AS reclaimable, sum(held) FILTER (k > 1) AS reclaimable_actual,
  bool_and(actual_known) FILTER (k > 1) AS actual_known, max(id) FILTER (k = 1) AS keeper, min(path) AS first_path FROM kept GROUP BY hash, size),
grp AS (SELECT row_number() OVER (ORDER BY reclaimable DESC, n_files DESC, first_path) AS group_id, hash, size::BIGINT AS size, n_files, reclaimable::BIGINT AS reclaimable,
  reclaimable_actual::BIGINT AS reclaimable_actual, actual_known, keeper, first_path FROM grp0),
members AS (SELECT m.*, g.group_id, g.keeper FROM members0 m JOIN grp g ON m.size = g.size AND m.hash = g.hash)"""
)

#: ``orders`` and ``lineitem`` as operations, for the oracle.
LEDGER = """ops AS (SELECT o_orderkey AS op_id, ['trash', 'move', 'delete', 'hardlink', 'symlink'][o_custkey % 5 + 1] AS op_kind, epoch(o_orderdate)::BIGINT AS created_at, o_custkey % 5 <> 2 AS undoable FROM orders),
items AS (SELECT l_orderkey * 8 + l_linenumber AS item_id, l_orderkey AS op_id, '/v' || l_suppkey % 4 || '/p' || l_partkey AS orig_path, (l_quantity * 100)::BIGINT AS size,
  ['planned', 'done', 'failed', 'skipped', 'cancelled', 'interrupted', 'undone', 'undo_failed', 'undoing'][(l_partkey + l_linenumber) % 9 + 1] AS state, l_suppkey % 3 = 0 AS cross_volume FROM lineitem)"""
