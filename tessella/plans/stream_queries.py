"""Journals, progress and the cache store, over tables and over streams of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import dedup
from tessella.operators.store import CacheStore
from tessella.plans.dedup_queries import _CACHE, cache_rows, second_run
from tessella.plans.registry import query
from tessella.sources import corpus
from tessella.sources.scratch import drop_folder, shared_folder, stage
from tessella.streaming import journal, progress, sink

#: What a kind of event asks of its user's item.
ASKS = {"signup": "planned", "click": "done", "error": "failed", "view": "undoing", "purchase": "undone"}
_LEGAL = " OR ".join(f"(at = '{a}' AND e IN ({', '.join(repr(b) for b in more)}))" for a, more in journal.NEXT.items() if more)
_FOLDED = f"""WITH e AS (SELECT user_id AS item, list(CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ASKS.items())} END ORDER BY event_id) AS l FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
r AS (SELECT item, len(l) AS n, list_reduce(list_prepend('|0', l), lambda acc, e: CASE WHEN {_LEGAL.replace('at =', "split_part(acc, '|', 1) =")} THEN e || '|' || (split_part(acc, '|', 2)::BIGINT + 1) ELSE acc END) AS a FROM e)
SELECT item, split_part(a, '|', 1) AS state, split_part(a, '|', 2)::BIGINT AS taken, (n - split_part(a, '|', 2)::BIGINT)::BIGINT AS rejected FROM r"""


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in ASKS.items() for x in pair])
    return corpus.table(spark, folder, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.try_element_at(names, F.col("event_type")).alias("state"), F.col("ts").cast("timestamp").alias("at"))


def _folders(spark: SparkSession, name: str) -> tuple[str, str, str]:
    """New folders for what arrives, for results and for a stream's checkpoint."""
    import uuid

    top = f"{shared_folder(spark)}/tessella-streams/{name}-{uuid.uuid4().hex}"
    return f"{top}/in", f"{top}/out", f"{top}/state"


@query(_FOLDED)
def journal_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as requests for new states of an item, folded over the table."""
    return journal.folded(_asked(spark, sf_dir).drop("at"))


@query(_FOLDED)
def journal_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream that is stopped and started again as events arrive."""
    rows = _asked(spark, sf_dir)
    come, out, state = _folders(spark, "journal")
    for _ in sink.in_turns(rows, "seq", come):
        sink.run_to_end(journal.tracked(spark.readStream.schema(rows.schema).parquet(come)), out, state)
    found = stage(sink.latest(spark, out, ["item"]).drop("stale"), "journal")
    drop_folder(spark, come.rsplit("/", 1)[0])
    return found


_PROGRESS = """p AS (SELECT event_type AS stage, ts, floor(value * 100)::BIGINT AS bytes, (props::JSON ->> 'k')::INT AS k FROM events),
w AS (SELECT stage, date_trunc('hour', ts) AS start, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM p WHERE k <= 60 GROUP BY ALL)"""


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Events that arrived as many minutes late as their properties say."""
    e, minutes = corpus.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.col("event_type").alias("stage"), F.col("ts").alias("at"), (F.col("ts") + F.make_dt_interval(mins=minutes)).alias("arrived"), F.lit(1).cast("bigint").alias("files"), F.floor(F.col("value") * 100).cast("bigint").alias("bytes"))


@query(f"WITH {_PROGRESS} SELECT * FROM w")
def progress_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.windows(_events(spark, sf_dir))


@query(f"WITH {_PROGRESS} SELECT * FROM w")
def progress_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows by a stream with a watermark."""
    rows = _events(spark, sf_dir)
    come, out, state = _folders(spark, "progress")
    for _ in sink.in_turns(rows, "event_id", come):
        sink.run_to_end(progress.windows(spark.readStream.schema(rows.schema).parquet(come)), out, state)
    found = stage(sink.latest(spark, out, ["stage", "start"]), "progress")
    drop_folder(spark, come.rsplit("/", 1)[0])
    return found


@query(f"""WITH {_PROGRESS}, t AS (SELECT stage, sum(bytes) AS total FROM p GROUP BY stage),
s AS (SELECT stage, min(start) AS first, max(start) AS start, arg_max(files, start) AS files, arg_max(bytes, start) AS bytes, sum(bytes) AS done, epoch(max(start)) + 3600 - epoch(min(start)) AS elapsed FROM w GROUP BY stage)
SELECT s.stage, s.start, s.files, s.bytes, round(done / elapsed, 6) AS speed, round(done / total * 100, 6) AS percent, floor(greatest(0, total - done) / (done / elapsed))::BIGINT AS eta FROM s JOIN t USING (stage)""")
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest window, speed and time left of each stage; late events count in what is left."""
    e = _events(spark, sf_dir)
    return progress.speeds(progress.windows(e), e.groupBy("stage").agg(F.sum("bytes").alias("total")))


@query(f"""WITH {_CACHE}, m AS (SELECT coalesce(n.path, o.path) AS path, coalesce(n.size, o.size) AS size, coalesce(n.mtime_ns, o.mtime_ns) AS mtime_ns,
  CASE WHEN n.path IS NULL THEN CASE WHEN o.id % 3 = 0 THEN o.hash END WHEN o.path IS NOT NULL AND o.size = n.size AND o.mtime_ns = n.mtime_ns AND o.id % 3 = 0 THEN o.hash END AS full_hash,
  CASE WHEN coalesce(o.size, n.size) % 2 = 0 THEN 70 WHEN n.path IS NULL THEN o.id % 50 ELSE 60 END AS last_hit FROM now n FULL JOIN old o USING (path))
SELECT * FROM (SELECT * FROM m ORDER BY last_hit DESC, path DESC LIMIT (SELECT count(*) // 2 FROM m))""")
def cache_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after two runs, touches of every file of even size and the eviction of the older half."""
    import uuid

    store = CacheStore(spark, f"{shared_folder(spark)}/tessella-cache-{uuid.uuid4().hex}", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")), fanout=2)
    first = stage(cache_rows(spark, sf_dir), "cache-first")
    second = stage(second_run(spark, sf_dir), "cache-second")
    store.upsert(first)
    store.upsert(second.select("path", "size", "mtime_ns", *dedup.SAMPLES, F.lit(None).cast("string").alias("full"), F.lit(60).alias("last_hit"), "dev", "ino"))
    sizes = first.select("path", "size", F.lit(0).alias("k")).unionByName(second.select("path", "size", F.lit(1).alias("k"))).groupBy("path").agg(F.min_by("size", "k").alias("size"))
    store.touch(sizes.where("size % 2 = 0"), 70)
    store.evict(store.read().count() // 2)
    found = stage(store.read().select("path", "size", "mtime_ns", F.col("full").alias("full_hash"), "last_hit"), "cache-left")
    store.close()
    drop_folder(spark, store.folder)
    return found
