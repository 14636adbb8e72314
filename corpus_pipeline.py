"""A training-data pipeline over ``documents``: five stages, each an operator of ``tessella.llm``.

Every stage takes what its predecessor kept. All but the last return the
columns of ``documents``, also if there are others or their names are those that
operators use; the last returns pieces of packed sequences. Rows are dropped by
their place in the table, so ids may be null or repeat. Empty tables pass
through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._cluster import cut
from tessella.llm._rows import placed, without
from tessella.llm.decontaminate import contamination
from tessella.llm.language import UNDETERMINED, identify, learn
from tessella.llm.ngram_jaccard import ngram_jaccard
from tessella.llm.packing import pack
from tessella.llm.substring_dedup import substring_dedup

#: Least language score. Taught languages score 0.36 and more, 0.7 in the middle; other languages, random letters and hex
#: digits 0.27 and less from some fifty n-grams on. Shorter ones may score more and stay.
LEAST_LANGUAGE_SCORE = 0.3
#: Words that a worker remembers in packing: fewer than where packing is alone, since executors hold what earlier stages left.
REMEMBERED = 300_000
#: The shingles of the near-duplicate stage and its similarity, in hundredths.
SHINGLE_WORDS, SIMILARITY = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without a letter, null and empty texts go.

    Rows are judged one by one, so repeated ids and rows, and null ids, make no
    difference. Equal distances go to the smaller language. Without a labelled
    row nothing is taught and all go.
    """
    found = identify(docs, learn(docs))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays, whichever other rows have that id.

    Null ids come last, and of repeated rows one stays. Texts without a word are
    nobody's copies and stay. An empty table stays empty.
    """
    rows = placed(docs)
    key = F.struct(F.col("row.doc_id").isNull().alias("absent"), F.col("row.doc_id").alias("id"), "file", "at").alias("key")
    groups = cut(ngram_jaccard(rows.select(key, F.col("row.text").alias("text")), "key", "text", SHINGLE_WORDS, SIMILARITY, count_links=False), "pipeline-groups")
    other = (F.col("key.file") != F.col("component_id.file")) | (F.col("key.at") != F.col("component_id.at"))
    return without(rows, groups.where(other).select("key.file", "key.at"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a document with a smaller id has; nothing but such passages goes.

    A row of which no word is left goes. Rows with a null id or without a word
    stay as they are, but a null text becomes empty. ``n_chars`` follows the text
    where it changes. Rows that share an id don't touch each other.
    """
    found = substring_dedup(docs).where("n_removed = 0 or n_removed < n_words")

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        own = F.col("row").getField(name)
        return F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(own).cast(docs.schema[name].dataType) if name == "n_chars" else own

    return found.select(*[column(c).alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; each is judged by its own text, whatever its id.

    Null and empty texts hold nothing. Without items or documents nothing goes.
    """
    rows = placed(docs)
    found = contamination(rows.select("file", "at", F.col("row.text").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(rows, cut(found.select("row.file", "row.at"), "pipeline-leaks"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a row is a document, whatever its id. Null and empty texts are one token."""
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=REMEMBERED)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Packing depends on a tokenizer, which SQL can't express; tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces made of ``documents``; what each stage keeps is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
