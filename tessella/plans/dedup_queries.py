"""Duplicate detection, policies, results and the hash cache over ``documents`` as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import cache, dedup, policy
from tessella.operators.pages import PageStore
from tessella.plans.registry import FILES, GROUPS, query
from tessella.plans.scan_queries import _DIRS_SQL, _IN, dirs
from tessella.sources import corpus
from tessella.sources.scratch import drop_folder, shared_folder, stage

#: Sample sizes fitting the test documents, of which none reaches the production threshold.
CHUNK, SMALL = 512, 1024
_SIZED = f"{FILES}, sized AS (SELECT * FROM files WHERE size > 0 AND size IN (SELECT size FROM files WHERE size > 0 GROUP BY size HAVING count(*) > 1))"


def files(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    return corpus.documents(spark, folder, content)


def members0(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.candidates(files(spark, folder), CHUNK, SMALL)


def grouped(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Groups, and members with their ``group_id`` and ``keeper``."""
    found = members0(spark, folder)
    g = dedup.groups(found)
    return g, dedup.members_of(found, g)


@query(f"WITH {_SIZED} SELECT size, count(*) AS n FROM sized GROUP BY size")
def dedup_size_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.size_candidates(files(spark, sf_dir, False)).groupBy("size").agg(F.count("*").alias("n"))


@query(f"""WITH {FILES}, f AS (SELECT * EXCLUDE (file_index), CASE WHEN id % 5 = 0 THEN min(id) OVER (PARTITION BY volume_id, text) ELSE id END AS file_index FROM files),
sized AS (SELECT * FROM f WHERE size > 0 AND size IN (SELECT size FROM f WHERE size > 0 GROUP BY size HAVING count(*) > 1)),
one AS (SELECT volume_id, file_index, arg_min(path, lpad(octet_length(encode(path))::VARCHAR, 9, '0') || path) AS path, arg_min(id, path) AS id, any_value(size) AS size FROM sized WHERE resolved GROUP BY ALL
  UNION ALL SELECT volume_id, file_index, path, id, size FROM sized WHERE NOT resolved)
SELECT id, path, size FROM one WHERE size IN (SELECT size FROM one GROUP BY size HAVING count(*) > 1)""")
def dedup_identity_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.collapse_identity(dedup.size_candidates(corpus.documents(spark, sf_dir, False, aliases=True))).select("id", "path", "size")


@query(f"""WITH {_SIZED}, h AS (SELECT id, size, CASE WHEN size <= 1024 THEN [hex(encode(text))] ELSE [substr(hex(encode(text)), 1, 1024), substr(hex(encode(text)), 2 * least(size // 2, size - 512) + 1, 1024),
  substr(hex(encode(text)), 2 * least(size * 3 // 4, size - 512) + 1, 1024), substr(hex(encode(text)), 2 * (size - 512) + 1, 1024)] END AS s FROM sized)
SELECT id, size, count(*) OVER (PARTITION BY size, s) AS bucket FROM h QUALIFY count(*) OVER (PARTITION BY size, s) > 1""")
def dedup_sample_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    found = dedup.InTable(rows).samples(dedup.size_candidates(rows.drop("content")), CHUNK, SMALL)
    keys = ["size", *dedup.SAMPLES]
    found = dedup.shared(found, keys)
    return found.join(found.groupBy(*keys).agg(F.count("*").alias("bucket")), keys).select("id", "size", "bucket")


@query(f"WITH {GROUPS} SELECT * FROM grp")
def dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.groups(members0(spark, sf_dir))


@query(f"WITH {GROUPS} SELECT id, group_id, path FROM members")
def dedup_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    same = dedup.detect(rows.drop("content"), dedup.InTable(rows), CHUNK, SMALL, exact=True).members
    return dedup.members_of(same, dedup.groups(same)).select("id", "group_id", "path")


@query(f"WITH {GROUPS} SELECT count(*) AS groups, coalesce(sum(reclaimable), 0)::BIGINT AS reclaimable, coalesce(sum(n_files), 0)::BIGINT AS duplicate_files FROM grp")
def dedup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.totals(dedup.groups(members0(spark, sf_dir)))


@query(f"""WITH {GROUPS}, j AS (SELECT group_id, string_agg('{{"path":"' || path || '","id":' || id || ',"mtime_ns":' || mtime_ns || '}}', ',' ORDER BY path) AS files FROM members GROUP BY group_id)
SELECT group_id, 0 AS part, 0 AS status, '{{"group_id":' || group_id || ',"size":' || size || ',"n_files":' || n_files || ',"reclaimable":' || reclaimable || ',"hash":"' || hash || '","files":[' || files || ']}}' AS json FROM grp JOIN j USING (group_id)""")
def dedup_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = members0(spark, sf_dir)
    return dedup.report(dedup.groups(found), found)


@query(f"WITH {GROUPS} SELECT ext, count(DISTINCT group_id) AS groups, count(*) AS files, sum(size)::BIGINT AS bytes FROM members GROUP BY ext")
def dedup_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m = grouped(spark, sf_dir)
    per = m.groupBy("ext", "group_id").agg(F.count("*").alias("c"), F.sum("size").alias("b"))
    return per.groupBy("ext").agg(F.count("*").alias("groups"), F.sum("c").alias("files"), F.sum("b").alias("bytes"))


@query(f"WITH {GROUPS} SELECT group_id, count(DISTINCT volume_id) > 1 AND bool_and(resolved) AS cross_volume FROM members GROUP BY group_id")
def dedup_cross_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.cross_volume(grouped(spark, sf_dir)[1])


@query(f"""WITH {GROUPS} SELECT coalesce(sum(('0x' || left(sha256(size || chr(10) || hash || chr(10) || path), 15))::BIGINT), 0)::VARCHAR AS digest, count(*) AS n FROM members""")
def dedup_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.digest(members0(spark, sf_dir))


@query(f"WITH {GROUPS} SELECT coalesce(bit_xor(group_id * 1000003 + n_files), 0)::BIGINT AS fingerprint, count(*) AS groups FROM grp")
def dedup_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.fingerprint(dedup.groups(members0(spark, sf_dir)))


@query(f"""WITH {GROUPS}, gone AS (SELECT id FROM files WHERE id % 4 = 1), m AS (SELECT * FROM kept WHERE id NOT IN (SELECT id FROM gone)), g AS (SELECT size, hash, count(*) AS n_files, min(path) AS first_path FROM m GROUP BY ALL HAVING count(*) > 1)
SELECT row_number() OVER (ORDER BY (n_files - 1) * size DESC, n_files DESC, first_path) AS group_id, hash, n_files, ((n_files - 1) * size)::BIGINT AS reclaimable FROM g""")
def dedup_after_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.operators import ops

    found = members0(spark, sf_dir)
    return ops.regrouped(found, found.where("id % 4 = 1")).select("group_id", "hash", "n_files", "reclaimable")


def _keep_sql(order: str) -> str:
    return f"WITH {GROUPS} SELECT group_id, id AS keep_id FROM members QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {order}) = 1"


@query(_keep_sql("len(list_filter(string_split(path, '/'), lambda s: starts_with(s, '.'))) > 0, octet_length(encode(path)), path"))
def keep_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.keep(grouped(spark, sf_dir)[1], "default")


@query(_keep_sql("mtime_ns DESC, path"))
def keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.keep(grouped(spark, sf_dir)[1], "newest")


@query(_keep_sql("mtime_ns, path"))
def keep_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.keep(grouped(spark, sf_dir)[1], "oldest")


@query(_keep_sql("regexp_matches(path, '(^|/)\\.([^./]|\\.[^/]|\\.\\.)'), strlen(path), path"))
def keep_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.keep(grouped(spark, sf_dir)[1], "shortest")


@query(f"""WITH {GROUPS}, c AS (SELECT group_id, min_by(id, path) AS explicit FROM members WHERE id % 3 = 0 GROUP BY group_id)
SELECT g.group_id, coalesce(c.explicit, g.keeper) AS keep_id FROM grp g LEFT JOIN c USING (group_id)""")
def keep_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice of every third file, some of them not in the group they are chosen for."""
    g, m = grouped(spark, sf_dir)
    wrong = m.where("id % 5 = 0").select((F.col("group_id") + 1).alias("group_id"), F.col("id").alias("keep_id"))
    chosen = m.where("id % 3 = 0").select("group_id", F.col("id").alias("keep_id")).unionByName(wrong)
    return policy.keepers(g, chosen, m)


_BY_DIR = f"{GROUPS}, {_DIRS_SQL}, hit AS (SELECT f.id, f.group_id, f.path, f.keeper, min(d.dir_ord) AS dir_ord, min_by(d.dir, d.dir_ord) AS dir FROM members f JOIN dirs d ON {_IN} GROUP BY ALL)"


@query(f"WITH {_BY_DIR} SELECT group_id, id AS keep_id FROM hit QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY dir_ord, octet_length(encode(path)) DESC, path) = 1")
def keep_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.keep_in_dirs(grouped(spark, sf_dir)[1], dirs(spark))


@query(f"WITH {_BY_DIR} SELECT group_id FROM grp WHERE group_id NOT IN (SELECT group_id FROM hit)")
def keep_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, m = grouped(spark, sf_dir)
    return policy.unmatched_groups(g, policy.keep_in_dirs(m, dirs(spark)))


@query(f"WITH {GROUPS} SELECT group_id, keeper AS keep_id, 0 AS part, to_json(list(id ORDER BY id) FILTER (id <> keeper))::VARCHAR AS remove_ids FROM members GROUP BY ALL")
def keep_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, m = grouped(spark, sf_dir)
    return policy.decisions(m, g.select("group_id", F.col("keeper").alias("keep_id"))).withColumn("remove_ids", F.to_json("remove_ids"))


def _selection(spark: SparkSession, folder: str) -> DataFrame:
    """Every second file, in descending order, and each of a third of them again."""
    some = corpus.table(spark, folder, "documents").select(F.col("doc_id").alias("id")).where("id % 2 = 0")
    return some.select("id", (-F.col("id")).alias("ord")).unionByName(some.where("id % 3 = 0").select("id", F.col("id").alias("ord")))


_PENDING = f"""{_BY_DIR}, sel AS (SELECT doc_id AS id, -doc_id AS ord FROM documents WHERE doc_id % 2 = 0),
shut AS (SELECT id FROM members WHERE starts_with(path, '/src3/en/')),
pend AS (SELECT s.id, s.ord, CASE WHEN m.id IS NULL THEN 'gone' WHEN m.keeper = m.id THEN 'keep' WHEN h.id IS NULL THEN 'outside' WHEN s.id IN (SELECT id FROM shut) THEN 'excluded' END AS reason
  FROM sel s LEFT JOIN members m USING (id) LEFT JOIN hit h ON s.id = h.id)"""


def _pending(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    g, m = grouped(spark, folder)
    shut = spark.createDataFrame([(0, "/src3/en")], "dir_ord int, dir string")
    return policy.pending(_selection(spark, folder), m, g.select(F.col("keeper").alias("id")), dirs(spark), shut), m, g


@query(f"WITH {_PENDING} SELECT * FROM pend")
def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pending(spark, sf_dir)[0]


@query(f"WITH {_PENDING} SELECT coalesce(reason, 'pending') AS reason, count(*) AS n FROM pend GROUP BY ALL")
def pending_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pending(spark, sf_dir)[0].groupBy(F.coalesce("reason", F.lit("pending")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_BY_DIR} SELECT dir FROM dirs WHERE dir NOT IN (SELECT dir FROM hit WHERE id <> keeper)")
def pending_unmatched_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, m = grouped(spark, sf_dir)
    return policy.unmatched_dirs(m, g.select(F.col("keeper").alias("id")), dirs(spark))


@query(f"WITH {_PENDING} SELECT p.id, m.path, m.size, m.group_id, p.reason FROM pend p LEFT JOIN members m USING (id) ORDER BY p.reason IS NOT NULL, CASE WHEN p.reason IS NULL THEN -m.size END, CASE WHEN p.reason IS NULL THEN m.group_id END, CASE WHEN p.reason IS NULL THEN p.id END, p.ord LIMIT 50")
def pending_page_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, m, g = _pending(spark, sf_dir)
    return policy.pending_page(rows, m, g, "size", 0, 50)


@query(f"WITH {_PENDING} SELECT p.id, m.path, m.size, m.group_id, p.reason FROM pend p LEFT JOIN members m USING (id) ORDER BY p.reason IS NOT NULL, CASE WHEN p.reason IS NULL THEN m.path END, p.ord LIMIT 20 OFFSET 20")
def pending_page_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, m, g = _pending(spark, sf_dir)
    return policy.pending_page(rows, m, g, "path", 1, 20)


@query(f"""WITH {GROUPS}, f AS (SELECT m.group_id, m.id % 4 = 0 AS sel FROM members m WHERE m.id <> m.keeper)
SELECT group_id, CASE WHEN count(*) FILTER (sel) = 0 THEN 'none' WHEN count(*) FILTER (sel) = count(*) THEN 'all' ELSE 'some' END AS state, count(*) AS selectable FROM f GROUP BY group_id""")
def selection_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, m = grouped(spark, sf_dir)
    return policy.selection_state(m, g.select(F.col("keeper").alias("id")), m.where("id % 4 = 0").select("id"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN -doc_id END AS ord FROM documents WHERE doc_id % 2 = 0")
def selection_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.first_choice(_selection(spark, sf_dir))


@query(f"WITH {GROUPS} SELECT group_id, id, row_number() OVER (PARTITION BY group_id ORDER BY path) AS position FROM members")
def member_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.member_positions(grouped(spark, sf_dir)[1]).select("group_id", "id", "position")


def _page_sql(key: str, limit: int, offset: int) -> str:
    return f"WITH {GROUPS} SELECT group_id, size, n_files, reclaimable FROM grp ORDER BY {key} DESC, group_id LIMIT {limit} OFFSET {offset}"


def _page(spark: SparkSession, folder: str, sort: str, number: int, size: int) -> DataFrame:
    return policy.page(dedup.groups(members0(spark, folder)), sort, number, size).select("group_id", "size", "n_files", "reclaimable")


@query(_page_sql("reclaimable", 10, 10))
def results_page_reclaimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "reclaimable", 1, 10)


@query(_page_sql("size", 500, 0))
def results_page_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "size", -3, 9999)


@query(_page_sql("n_files", 100, 0))
def results_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "count", 0, 0)


@query(_page_sql("n_files", 20, 40))
def results_page_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a store whose files have ten groups each."""
    store = PageStore.write(dedup.groups(members0(spark, sf_dir)), f"{shared_folder(spark)}/tessella-pages", "count", 10)
    found = stage(store.page(2, 20).select("group_id", "size", "n_files", "reclaimable"), "page")
    drop_folder(spark, store.folder)
    return found


@query(f"WITH {GROUPS} SELECT count(*) AS groups, coalesce(sum(reclaimable), 0)::BIGINT AS reclaimable, coalesce(sum(n_files), 0)::BIGINT AS duplicate_files FROM grp WHERE group_id IN (SELECT group_id FROM members WHERE ext = '.txt')")
def results_totals_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, m = grouped(spark, sf_dir)
    return dedup.totals(policy.with_extension(g, m, ".TXT"))


# --- hash cache: a first run's rows, and a second run that changed some files ---------------------

_CACHE = f"""{FILES}, old AS (SELECT path, size, mtime_ns, hash, id, volume_id AS dev, file_index AS ino FROM files WHERE id % 8 <> 0),
now AS (SELECT id, path, CASE WHEN id % 9 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN id % 10 = 0 THEN mtime_ns + 1 ELSE mtime_ns END AS mtime_ns, volume_id AS dev, CASE WHEN id % 11 = 0 THEN -file_index ELSE file_index END AS ino, resolved FROM files WHERE id % 16 <> 1)"""


def cache_rows(spark: SparkSession, folder: str) -> DataFrame:
    hashed = files(spark, folder).select("*", *[c.alias(n) for n, c in dedup.sample_hashes(F.col("content"), F.col("size"), CHUNK, SMALL).items()])
    return hashed.where("id % 8 <> 0").select("path", "size", "mtime_ns", *cache.SAMPLES, F.when(F.col("id") % 3 == 0, F.sha2("content", 256)).alias("full"), (F.col("id") % 50).alias("last_hit"), F.col("volume_id").alias("dev"), F.col("file_index").alias("ino"))


def second_run(spark: SparkSession, folder: str) -> DataFrame:
    on = lambda n, a, b: F.when(F.col("id") % n == 0, a).otherwise(b)
    hashed = files(spark, folder).where("id % 16 <> 1")
    hashed = hashed.select("*", *[c.alias(n) for n, c in dedup.sample_hashes(F.col("content"), F.col("size"), CHUNK, SMALL).items()])
    return hashed.select("id", "path", on(9, F.col("size") + 1, F.col("size")).alias("size"), on(10, F.col("mtime_ns") + 1, F.col("mtime_ns")).alias("mtime_ns"), *cache.SAMPLES, F.col("volume_id").alias("dev"), on(11, -F.col("file_index"), F.col("file_index")).alias("ino"), "resolved")


@query(f"""WITH {_CACHE} SELECT n.id, CASE WHEN o.path IS NULL THEN 'miss' WHEN o.size = n.size AND o.mtime_ns = n.mtime_ns AND (NOT n.resolved OR (o.dev = n.dev AND o.ino = n.ino)) THEN 'hit' ELSE 'stale' END AS verdict FROM now n LEFT JOIN old o USING (path)""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.lookup(second_run(spark, sf_dir).drop(*cache.SAMPLES), cache_rows(spark, sf_dir)).select("id", "verdict")


@query(f"""WITH {_CACHE} SELECT count(*) AS files, count(*) FILTER (o.path IS NOT NULL AND o.size = n.size AND o.mtime_ns = n.mtime_ns AND (NOT n.resolved OR (o.dev = n.dev AND o.ino = n.ino)) AND n.id % 3 = 0) AS reused FROM now n LEFT JOIN old o USING (path)""")
def cache_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked = cache.trusted_full(cache.lookup(second_run(spark, sf_dir), cache_rows(spark, sf_dir)))
    return looked.agg(F.count("*").alias("files"), F.count("cached_full").alias("reused"))


@query(f"""WITH {_CACHE} SELECT coalesce(n.path, o.path) AS path, coalesce(n.size, o.size) AS size, coalesce(n.mtime_ns, o.mtime_ns) AS mtime_ns,
  CASE WHEN n.path IS NULL THEN CASE WHEN o.id % 3 = 0 THEN o.hash END WHEN n.id % 7 = 0 THEN f.hash WHEN o.path IS NOT NULL AND o.size = n.size AND o.mtime_ns = n.mtime_ns AND o.id % 3 = 0 THEN o.hash END AS full_hash,
  CASE WHEN n.path IS NULL THEN o.id % 50 ELSE 1000 END AS last_hit FROM now n FULL JOIN old o USING (path) LEFT JOIN files f ON f.id = n.id""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = files(spark, sf_dir).select("id", F.when(F.col("id") % 7 == 0, F.sha2("content", 256)).alias("full"))
    blank = F.col("id") % 4 == 0
    new = second_run(spark, sf_dir).join(full, "id").select("path", "size", "mtime_ns", *[F.when(blank, 0).otherwise(F.col(c)).alias(c) for c in cache.SAMPLES], "full", F.lit(1000).cast("bigint").alias("last_hit"), "dev", "ino")
    return cache.upsert(cache_rows(spark, sf_dir), new).select("path", "size", "mtime_ns", F.col("full").alias("full_hash"), "last_hit")


@query(f"WITH {_CACHE} SELECT path, id % 50 AS last_hit FROM old ORDER BY id % 50 DESC, path DESC LIMIT 333")
def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.evict(cache_rows(spark, sf_dir), 333).select("path", "last_hit")


@query(f"WITH {_CACHE} SELECT count(*) AS entries, count(*) FILTER (id % 3 = 0) AS with_full FROM old")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.stats(cache.usable(cache_rows(spark, sf_dir), cache.VERSION))


@query(f"WITH {GROUPS} SELECT group_id, hash, n_files FROM grp")
def cache_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a second run that takes full hashes from the cache where it may."""
    run = files(spark, sf_dir).withColumn("dev", F.col("volume_id")).withColumn("ino", F.col("file_index"))
    return dedup.groups(cache.incremental(run, cache_rows(spark, sf_dir), CHUNK, SMALL).members).select("group_id", "hash", "n_files")


@query(f"WITH {_CACHE} SELECT path, CASE WHEN path IN (SELECT path FROM now) THEN 77 ELSE id % 50 END::BIGINT AS last_hit FROM old")
def cache_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.touch(cache_rows(spark, sf_dir), second_run(spark, sf_dir), 77).select("path", F.col("last_hit").cast("bigint").alias("last_hit"))
