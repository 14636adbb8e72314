"""URL filters (operator 1), DataFrame operations only.

Each URL is expanded into expressions: every suffix of its host that starts at
a label, joined with prefixes of its path in the lengths that rules have. An
expression's digest is SHA-256; URLs meet rules by an equi-join on the
digest's first bits, the full digests are compared, and the longest rule wins.
Expansion and join run on distinct (host, path prefix) pairs, aggregated before
the shuffle, so a host with a third of all pages is expanded once per prefix.
What they come to is written: pages then meet a table of known size, which is
broadcast if it is small; else a host's prefix with very many pages can be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._cluster import cut

#: Hexadecimal digits of a digest that the join uses (32 bits).
PREFIX_DIGITS = 8
#: Rule tables of so many rows at most are broadcast: under 1 MB. Larger ones are shuffled.
BROADCAST_RULES = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://`` empty."""
    rest = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    whole = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    host = F.substring_index(whole, "/", 1)
    return F.coalesce(F.substr(whole, F.char_length(host) + 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``verdict, host, path`` rows as a table."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``<id_col>, host, path, rule, verdict`` for each row of ``pages``.

    A rule ``verdict, host, path`` fits its host and all subdomains where the
    URL's path starts with the rule's. The longest rule (characters of host and
    path) wins; of equally long ones the longer host, then ``block`` before
    ``allow``. Without a rule ``rule`` is null and the verdict ``default``.

    Null URLs and those without ``://`` have an empty host and path and fit no
    rule. Repeated rows and null ids stay. Very long URLs cost a row per host
    label and path length that rules use. Rules with a null or empty host are
    ignored, repeated ones count once. Other columns are not read, so their
    names can't clash; an empty table gives no rows.
    """
    clean = rules.where("host <> ''").select(F.lower("verdict").alias("verdict"), F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).distinct()
    found = clean.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.char_length("path"))).alias("lengths")).first()
    lengths = found["lengths"] or [0]
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)
    known = clean.select(digest(F.col("host"), F.col("path")).alias("digest"), F.concat("host", "path").alias("rule"), F.char_length("host").alias("host_length"), "verdict")
    known = known.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    if found["n"] <= BROADCAST_RULES:
        known = F.broadcast(known)

    parsed = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parsed = parsed.withColumn("head", F.substring("path", 1, max(lengths)))
    keys = parsed.select("host", "head").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    wanted = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("head"))
    expanded = keys.select("host", "head", F.explode(hosts).alias("suffix")).select("host", "head", "suffix", F.explode(wanted).alias("n"))
    expanded = expanded.select("host", "head", digest(F.col("suffix"), F.substr("head", F.lit(1), F.col("n"))).alias("full"))
    met = expanded.withColumn("short", F.substring("full", 1, PREFIX_DIGITS)).join(known, "short").where("full = digest")
    best = cut(met.groupBy("host", "head").agg(F.max(F.struct(F.char_length("rule").alias("length"), "host_length", "verdict", "rule")).alias("best")), "url-rules")
    joined = parsed.join(best, ["host", "head"], "left")
    return joined.select(F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
