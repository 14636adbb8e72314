"""The operators of this subpackage as registered queries, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import oracles
from tessella.llm._cluster import cut
from tessella.llm.decontaminate import contamination
from tessella.llm.language import language_id
from tessella.llm.license_scan import license_scan
from tessella.llm.lm import lm_score
from tessella.llm.ngram_jaccard import ngram_jaccard
from tessella.llm.packing import pack
from tessella.llm.periodic_runs import periodic_runs
from tessella.llm.repeated_bytes import repeated_bytes
from tessella.llm.substring_dedup import substring_dedup
from tessella.llm.token_files import read_token_files, write_token_files
from tessella.llm.topk import top_k
from tessella.llm.url_filter import rule_table, url_filter
from tessella.llm.vector_codes import vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: The rules of ``op1_url_filter``: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Where a document would lie as a file: 64 ids a folder, every sixteenth its licence file.
_NAMED = "CASE WHEN doc_id % 16 = 0 THEN concat('LICENSE.', CAST(doc_id AS VARCHAR(20))) ELSE concat(CAST(doc_id AS VARCHAR(20)), '.txt') END"


def _path(divided: str) -> str:
    return f"concat('/', source, '/', lang, '/', CAST({divided} AS VARCHAR(20)), '/', {_NAMED})"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "item_id", "start", "n_words", "similarity")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(_table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(_path("doc_id div 64")).alias("path"))
    return license_scan(documents, "doc_id", "path", "text")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(_table(spark, sf_dir, "documents"), joined=True)
    return kept.select("row.doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in a tenth of the documents the words from some place on repeat with some period."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    keyed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    keyed = keyed.withColumn("w", F.when(chosen, words)).withColumn("n", F.coalesce(F.size("w"), F.lit(0)).cast("bigint")).withColumn("g", F.expr("h div 10"))
    keyed = keyed.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    moved = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)])), ' ')")
    return keyed.select("doc_id", F.when(F.col("n") > 0, moved).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(_table(spark, sf_dir, "documents")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("longest", longest)
    own = [(-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"), F.expr("1000 * longest.length div -longest.period").alias("exponent_milli")]
    return found.select("row.doc_id", F.size("runs").cast("bigint").alias("n_runs"), *own, F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


#: So many labels, with their sums, are sent to all tasks.
FEW_LABELS = 100_000


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vector_codes(_table(spark, sf_dir, "embeddings"))
    found = made.table.select("row.vec_id", "row.label", F.expr("array_join(transform(codes, c -> lpad(lower(hex(c)), 2, '0')), '')").alias("code"), "error")
    sums = cut(found.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error")), "label-errors", slim=True)
    joined = found.join(F.broadcast(sums) if sums.count() <= FEW_LABELS else sums, F.col("label").eqNullSafe(F.col("own")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(made.sha256()).alias("codebooks_sha256"))


def op13_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeated_bytes(_table(spark, sf_dir, "documents"))
    return kept.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_top_k": op4_top_k,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_packing": op6_packing,
    "op7_lm_score": op7_lm_score,
    "op8_license_scan": op8_license_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_files": op10_token_files,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_repeated_bytes": op13_repeated_bytes,
}
ORACLES: dict[str, str] = {
    "op1_url_filter": oracles.url_filter(URL_RULES),
    "op2_decontaminate": oracles.DECONTAMINATE,
    "op3_language_id": oracles.LANGUAGE_ID,
    "op4_top_k": oracles.TOP_K,
    "op5_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op8_license_scan": oracles.license_scan(_path("doc_id // 64")),
    "op9_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op12_vector_codes": oracles.vector_codes(rounds=4),
}
