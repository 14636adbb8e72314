"""Formats, message classes, states and other scalar rules over table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import classify, formats, markdown, paths, records
from tessella.operators import policy
from tessella.plans.registry import FILES, query
from tessella.sources import corpus

_NUMBERS = "n AS (SELECT o_orderkey AS id, (o_orderkey * pow(1024, o_orderkey % 5))::BIGINT AS n FROM orders)"


def _numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of every order of magnitude; those of large keys don't fit 64 bits."""
    n = F.col("o_orderkey").cast("decimal(20,0)") * F.pow(F.lit(1024.0), F.col("o_orderkey") % 5).cast("decimal(18,0)")
    return corpus.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), n.alias("n"))


_UNIT = "CASE {} WHEN 1 THEN 'K' WHEN 2 THEN 'M' WHEN 3 THEN 'G' WHEN 4 THEN 'T' WHEN 5 THEN 'P' ELSE 'E' END"
_POWER = "((n >= 1024)::INT + (n >= 1048576)::INT + (n >= 1073741824)::INT + (n >= 1099511627776)::INT + (n >= 1125899906842624)::INT + (n >= 1152921504606846976)::INT)"


@query(f"""WITH {_NUMBERS} SELECT id, CASE WHEN n < 1024 THEN n || 'B' ELSE printf('%.1f', n / pow(1024, {_POWER})) || {_UNIT.format(_POWER)} || 'iB' END AS report,
  CASE WHEN n <= 0 THEN '0 B' WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f', round(n / pow(1024, {_POWER}), 1)) || ' ' || {_UNIT.format(_POWER)} || 'iB' END AS display,
  CASE WHEN n >= 1099511627776 THEN printf('%.2f TiB', n / 1099511627776) WHEN n >= 1073741824 THEN printf('%.2f GiB', n / 1073741824) WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024) ELSE n || ' B' END AS capacity FROM n""")
def fmt_human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return _numbers(spark, sf_dir).select("id", formats.report_bytes(n).alias("report"), formats.display_bytes(n).alias("display"), formats.capacity_bytes(n).alias("capacity"))


@query("""SELECT o_orderkey AS id, CASE WHEN s < 0 THEN '-' WHEN s < 60 THEN ceil(s)::BIGINT || ' s' WHEN s < 3600 THEN floor(s / 60)::BIGINT || ' min ' || floor(s % 60)::BIGINT || ' s' ELSE floor(s / 3600)::BIGINT || ' h ' || floor((s % 3600) / 60)::BIGINT || ' min' END AS took
FROM (SELECT o_orderkey, (o_orderkey % 20000 - 10)::DOUBLE AS s FROM orders)""")
def fmt_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), formats.duration((F.col("o_orderkey") % 20000 - 10).cast("double")).alias("took"))


@query("""SELECT o_orderkey AS id, CASE WHEN t <= 0 THEN 0.0 ELSE greatest(0.0, least(100.0, d / t * 100)) END::DOUBLE AS percent, CASE WHEN e > 0 AND t > 0 AND d > 0 THEN floor(greatest(0.0, t::DOUBLE - d) / (d / e))::BIGINT ELSE -1 END AS eta
FROM (SELECT o_orderkey, o_orderkey % 1000 AS d, o_custkey % 700 AS t, o_orderkey % 13 AS e FROM orders)""")
def fmt_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t, e = F.col("o_orderkey") % 1000, F.col("o_custkey") % 700, F.col("o_orderkey") % 13
    return corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), formats.percent(d, t).alias("percent"), formats.eta_seconds(d, t, e).alias("eta"))


_MESSAGES = [*[f"open /x: {m}" for m, _ in classify.ERROR_RULES], "Goroutine Panic in worker", "panic: nil", "磁盘已满", "something else", "Database disk image is MALFORMED", "file is not a database"]
_MESSAGES_SQL = ", ".join(f"({k}, '{m}')" for k, m in enumerate(_MESSAGES))
_RULES_SQL = " ".join(f"WHEN contains(lower(text), '{m}') THEN '{c}'" for m, c in classify.ERROR_RULES)
_DAMAGE_SQL = " OR ".join(f"contains(lower(text), '{m}')" for m in classify.DAMAGE_MARKS)


@query(f"""WITH m(k, text) AS (VALUES {_MESSAGES_SQL}), t AS (SELECT event_id, text FROM events JOIN m ON event_id % {len(_MESSAGES)} = k)
SELECT event_id, CASE WHEN contains(lower(text), 'goroutine panic') OR contains(lower(text), 'panic: ') THEN 'panic' WHEN regexp_matches(text, '[\\x{{3001}}-\\x{{303F}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}]') THEN text {_RULES_SQL} ELSE 'unclassified' END AS class, {_DAMAGE_SQL} AS damaged FROM t""")
def err_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("event_id") % len(_MESSAGES) + 1).cast("int"))
    return corpus.table(spark, sf_dir, "events").select("event_id", text.alias("text")).select("event_id", classify.error_class(F.col("text")).alias("class"), classify.damaged(F.col("text")).alias("damaged"))


@query("""WITH k AS (SELECT o_orderkey AS id, ['trash', 'move', 'delete', 'hardlink', 'symlink'][o_custkey % 5 + 1] AS kind, ['windows', 'linux', 'darwin'][o_orderkey % 3 + 1] AS platform FROM orders)
SELECT id, kind <> 'delete' AND NOT (kind = 'trash' AND platform = 'windows') AS undoable, CASE WHEN kind = 'trash' AND platform = 'windows' THEN 'windows-trash' WHEN kind = 'delete' THEN 'permanent-delete' END AS reason FROM k""")
def rule_undoable(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    kind, platform = pick(("trash", "move", "delete", "hardlink", "symlink"), F.col("o_custkey")), pick(("windows", "linux", "darwin"), F.col("o_orderkey"))
    return corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), classify.undoable(kind, platform).alias("undoable"), classify.not_undoable_reason(kind, platform).alias("reason"))


def _pick(values: list[str | None], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_STEMS, _ENDS = ["con", "Com1", "LPT9", "aux", "nul", "clock$", "com0", "console", "prn", "a.con"], ["", ".txt", ".tar.gz", " ", "..", " .x", "1"]


@query(f"""WITH n AS (SELECT doc_id, {_list(_STEMS)}[doc_id % 10 + 1] || {_list(_ENDS)}[doc_id // 10 % 7 + 1] AS name FROM documents)
SELECT doc_id, name, regexp_full_match(upper(split_part(rtrim(name, ' .'), '.', 1)), 'CON|PRN|AUX|CLOCK[$]|NUL|COM[1-9]|LPT[1-9]') AS reserved FROM n""")
def rule_reserved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(_pick(_STEMS, F.col("doc_id")), _pick(_ENDS, F.floor(F.col("doc_id") / 10)))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).withColumn("reserved", classify.reserved_name(F.col("name")))


_MARKS, _TAILS = ["a.app-restored", "b.app-old", ".app-tmp", "c.app-undo-tmp", "d.APP-old", ".app-case-probe-", "x.app-restoredx"], ["", ".undo", "_1.bin", ".jpg", "x", "_12", "42", "_3.undo"]


@query(f"""WITH n AS (SELECT doc_id, doc_id % 7 AS m, {_list(_TAILS)}[doc_id // 7 % 8 + 1] AS tail, {_list(_MARKS)}[doc_id % 7 + 1] || {_list(_TAILS)}[doc_id // 7 % 8 + 1] AS name FROM documents)
SELECT doc_id, name, CASE WHEN m = 0 THEN tail NOT IN ('x', '42') WHEN m IN (1, 2, 3) THEN tail IN ('', '.undo') WHEN m = 5 THEN tail = '42' ELSE false END AS temporary FROM n""")
def rule_work_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(_pick(_MARKS, F.col("doc_id")), _pick(_TAILS, F.floor(F.col("doc_id") / 7)))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).withColumn("temporary", classify.work_temp(F.col("name"), "app"))


_PARENTS = ["/src1", "/src", "", "/src2/en", "src3", "/src1/.h/en/0.txt", "/src10"]


@query(f"""WITH {FILES}, p AS (SELECT id, path, {_list(_PARENTS)}[id % 7 + 1] AS parent FROM files) SELECT id, parent, path = parent OR left(path, length(parent) + 1) = parent || '/' AS inside FROM p""")
def rule_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.documents(spark, sf_dir, False).withColumn("parent", _pick(_PARENTS, F.col("id")))
    return files.select("id", "parent", paths.under(F.col("path"), F.col("parent")).alias("inside"))


_STREAMS, _MET = ["::$DATA", ":x:$DATA", ":y", ":$data", "z", ":"], ["none", "denied", "no-streams", "none", "missing", "fs-no-streams", "none"]


@query(f"""WITH e AS (SELECT event_id, event_id % 6 AS a, event_id // 6 % 6 AS b, {_list(_MET)}[event_id % 7 + 1] AS kind FROM events)
SELECT event_id, CASE WHEN kind = 'none' THEN CASE WHEN a IN (1, 2) OR b IN (1, 2) THEN 'reject-named' END WHEN kind = 'denied' THEN 'reject-unknown' END AS decision FROM e""")
def rule_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams a file: only those named x and y are alternate ones."""
    names = F.array(_pick(_STREAMS, F.col("event_id")), _pick(_STREAMS, F.floor(F.col("event_id") / 6)))
    return corpus.table(spark, sf_dir, "events").select("event_id", classify.stream_decision(names, _pick(_MET, F.col("event_id"))).alias("decision"))


_LEGAL = sorted((a, b) for a, targets in classify.TRANSITIONS.items() for b in targets)


@query(f"""WITH s(s) AS (VALUES {", ".join(f"('{a}')" for a in classify.TRANSITIONS)}), l(f, t) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _LEGAL)})
SELECT a.s AS from_status, b.s AS to_status, EXISTS (SELECT 1 FROM l WHERE f = a.s AND t = b.s) AS legal FROM s a, s b""")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list(classify.TRANSITIONS)
    asked = spark.createDataFrame([(a, b) for a in names for b in names], "from_status string, to_status string")
    legal = spark.createDataFrame(_LEGAL, "from_status string, to_status string").withColumn("legal", F.lit(True))
    return asked.join(legal, ["from_status", "to_status"], "left").withColumn("legal", F.coalesce("legal", F.lit(False)))


@query("""SELECT event_id, epoch_us(ts) AS unix_us, epoch_us(ts) * 10 + 116444736000000000 AS filetime FROM events""")
def rule_filetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return corpus.table(spark, sf_dir, "events").select("event_id", us.alias("unix_us"), (us * 10 + 116444736000000000).alias("filetime"))


@query("""SELECT o_orderkey AS id, array_to_string(list_reverse(regexp_extract_all(printf('%016x', o_orderkey), '..')), '') AS packed, o_orderkey AS unpacked FROM orders""")
def rule_pack_u64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), records.pack_u64(F.col("o_orderkey")).alias("packed")).withColumn("unpacked", records.unpack_u64(F.col("packed")))


@query(f"""WITH {FILES}, v AS (SELECT volume_id, sum(size) // 400 AS cap, count(*) FILTER (resolved) % 2 = 0 AS own FROM files WHERE size IS NOT NULL GROUP BY volume_id),
d AS (SELECT f.id, f.size, v.cap, v.own, f.path || '/' || coalesce(f.text, '') AS p, f.actual_known FROM files f JOIN v USING (volume_id))
SELECT id, CASE WHEN cap > 0 AND size > cap THEN 'too-large' END AS capacity, CASE WHEN NOT actual_known THEN 'off-by-policy' WHEN own THEN 'off-for-volume' END AS policy,
  CASE WHEN length(p) + length(regexp_replace(p, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) > 259 THEN 'too-long' END AS length FROM d""")
def recycle_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against the bin for each file: its volume's capacity and setting, and how long its path would be with the text as its last part."""
    f = corpus.documents(spark, sf_dir)
    per = f.where("size is not null").groupBy("volume_id").agg(F.expr("sum(size) div 400").alias("cap"), (F.count_if("resolved") % 2 == 0).alias("own"))
    state = lambda on: records.setting_state(F.lit(None).cast("string"), on.cast("int"))
    d = f.join(F.broadcast(per) if per.count() < 1000 else per, "volume_id")
    path = F.concat("path", F.lit("/"), F.coalesce(F.col("content").cast("string"), F.lit("")))
    off = records.switched_off(state(~F.col("actual_known")), state(F.col("own")))
    return d.select("id", records.over_capacity(F.col("size"), F.col("cap")).alias("capacity"), off.alias("policy"), records.too_long(path).alias("length"))


@query("""SELECT o_orderkey AS id, CASE WHEN l <= 100 THEN 100 ELSE greatest(100, least(l, 500)) END AS segment_size, CASE WHEN l <= 100 THEN 1 ELSE ceil(l / greatest(100, least(l, 500)))::BIGINT END AS segments, CASE WHEN l <= 100 THEN 1 ELSE ceil(l / 100)::BIGINT END AS next_page
FROM (SELECT o_orderkey, o_orderkey % 3000 AS l FROM orders)""")
def page_reload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = policy.reload_plan(F.col("o_orderkey") % 3000)
    return corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *[c.alias(name) for name, c in plan.items()])


@query("""SELECT o_orderkey AS id, CASE WHEN r = 0 THEN -1 WHEN i <= 0 THEN 0 WHEN i < r THEN i ELSE -1 END AS first_excluded FROM (SELECT o_orderkey, o_orderkey % 50 AS r, o_custkey % 200 - (o_orderkey % 4) * 50 AS i FROM orders)""")
def page_first_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = policy.first_excluded(F.col("o_orderkey") % 50, F.col("o_custkey") % 200, (F.col("o_orderkey") % 4) * 50)
    return corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), first.alias("first_excluded"))


@query("""SELECT page_id, sum((regexp_matches(l, '^#{1,6} '))::INT)::BIGINT AS headings, sum((regexp_matches(l, '^[-*] '))::INT)::BIGINT AS bullets, count(*) AS lines FROM (SELECT page_id, unnest(string_split(replace(html, '<', chr(10) || '- <'), chr(10))) AS l FROM pages) GROUP BY page_id""")
def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.explode(F.split(F.replace("html", F.lit("<"), F.lit("\n- <")), "\n"))
    lines = corpus.table(spark, sf_dir, "pages").select("page_id", line.alias("l"))
    return lines.groupBy("page_id").agg(F.sum(F.col("l").rlike("^#{1,6} ").cast("int")).alias("headings"), F.sum(F.col("l").rlike("^[-*] ").cast("int")).alias("bullets"), F.count("*").alias("lines"))


@query("""SELECT p_partkey AS id, p_size * 1024 AS bytes, round(p_partkey / 1024.0)::BIGINT AS kib FROM part""")
def size_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), formats.bytes_of(F.col("p_size")).alias("bytes"), formats.kib_of(F.col("p_partkey")).alias("kib"))


@query("""WITH t AS (SELECT conv_id, turn, '# turn ' || turn || ' of *' || coalesce(role, '') || '*' AS head, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, turn, 0 AS block, 'heading' AS kind, 0 AS item, 'turn ' || turn || ' of *' || substr(head, position('*' IN head) + 1) AS text, CASE WHEN ends_with(head, '**') THEN 1 ELSE 2 END AS segments FROM t
UNION ALL SELECT conv_id, turn, 1, 'bullets', 0, 'characters: ' || length(text), 1 FROM t UNION ALL SELECT conv_id, turn, 1, 'bullets', 1, 'words: [here](docs/' || conv_id || ')', 2 FROM t
UNION ALL SELECT conv_id, turn, 2, 'code', 0, text, 0 FROM t""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as notes in Markdown: a heading, a list, the text as it is; parsed into rows."""
    t = corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    number = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit("# turn "), number("turn"), F.lit(" of *"), "role", F.lit("*\n"))
    items = F.concat(F.lit("- characters: "), F.char_length("text").cast("string"), F.lit("\n- words:\n  [here](docs/"), number("conv_id"), F.lit(")\n"))
    note = F.concat(head, items, F.lit("```\n"), "text", F.lit("\n```\n"))
    found = markdown.parsed(t.select(F.struct("conv_id", "turn").alias("id"), note.alias("note")), "id", "note")
    return found.select("id.conv_id", "id.turn", "block", "kind", "item", "text", F.size("segments").alias("segments"))
