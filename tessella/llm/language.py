"""Language ID (operator 3) by rank-order profiles (Cavnar and Trenkle).

A profile is a ranking of n-grams of one to three letters, a word's ends
counting as a space. A document's most frequent n-grams are compared with each
language's by the out-of-place distance: the sum over the document's n-grams of
how far their ranks are apart, or the profile's size where one is missing.

N-grams are counted on arrays of code points, three in one 64-bit code whose
order is that of the strings. Training counts are added per task and language
before they are shuffled; the profiles (``PROFILE`` codes a language) are
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._cluster import bound_batches, cut
from tessella.llm._text import KEPT

#: N-grams that a profile and a document's ranking hold at most.
PROFILE = 300
#: Distinct n-grams a task holds for a language before it passes counts on.
HELD_NGRAMS = 1 << 19
UNDETERMINED = "und"
_SPACE = 32


class _Letters:
    """Which code points are letters, made when first used in a worker."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.asarray([chr(c).isalpha() for c in range(0x40000)])
        return cls.table


def letters(text: str) -> np.ndarray:
    """Code points of a text with A-Z lower-cased, all but letters a space, spaces at both ends."""
    KEPT.clear()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    known = _Letters.get()
    points = np.where(known[np.minimum(points, 0x3FFFF)] & (points < 0x40000), points, _SPACE)
    return np.concatenate([[_SPACE], points, [_SPACE]])


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's n-grams, ascending, and how often each occurs."""
    p = letters(text)
    word = p != _SPACE
    ones = p[word] << 36
    a, b = p[:-1], p[1:]
    twos = ((a << 36) | (b << 18))[word[:-1] | word[1:]]
    middle = word[1:-1]
    threes = ((p[:-2] << 36) | (p[1:-1] << 18) | p[2:])[middle]
    return np.unique(np.concatenate([ones, twos, threes]), return_counts=True)


def ranking(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties to smaller codes."""
    if len(codes) > size:
        least = np.partition(counts, -size)[-size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Rankings of all languages as one sorted table of codes with a column of ranks per language."""

    def __init__(self, rankings: dict[str, list[int]], size: int):
        self.size, self.names = size, sorted(rankings)
        self.codes = np.unique(np.concatenate([np.asarray(rankings[n], np.int64) for n in self.names])) if self.names else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, np.asarray(rankings[name], np.int64)), k] = np.arange(len(rankings[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and ``1 - distance / (largest possible distance)``."""
        if not text or not self.names:
            return UNDETERMINED, 0.0
        codes, counts = ngram_counts(text)
        if not len(codes):
            return UNDETERMINED, 0.0
        own = ranking(codes, counts, self.size)
        at = np.searchsorted(self.codes, own)
        at = np.where((at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == own), at, len(self.codes))
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.names[best], 1 - int(apart[best]) / (len(own) * self.size)


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE) -> Profiles:
    """Profiles of all languages in ``lang``; rows with a null language or text are left out."""
    bound_batches(docs.sparkSession)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(where, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)

        def row(name: str, part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(part[0]), pa.string()), pa.array(part[0]), pa.array(part[1])], ["lang", "code", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(name, []).append(ngram_counts(text))
            for name in list(held):
                held[name] = [added(held[name])]
                if len(held[name][0][0]) > HELD_NGRAMS:
                    yield row(name, held.pop(name)[0])
        for name, parts in held.items():
            yield row(name, parts[0])

    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = known.mapInArrow(one, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # two steps, so that no task ranks all n-grams of a language
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("code"), F.lit(64))).orderBy(F.col("n").desc(), "code")
    some = cut(counts.withColumn("k", F.row_number().over(salted)).where(F.col("k") <= size), "language-ngrams")
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    top = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= size)
    rankings: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "k", "code").collect():  # at most the profile's size for each language
        rankings.setdefault(r["lang"], []).append((r["k"], r["code"]))
    return Profiles({name: [c for _, c in sorted(x)] for name, x in rankings.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``row, lang_pred, score``: ``row`` is a struct of all columns of the input, so no name can clash."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    bound_batches(docs.sparkSession)
    data = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["row", "lang_pred", "score"])

    return data.mapInArrow(one, data.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def held_out(id_col: Column, parts: int, fold: int) -> Column:
    """Whether ``crc32`` of an id as text leaves ``fold`` when divided by ``parts``; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == fold, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text", parts: int = 5, fold: int = 0) -> DataFrame:
    """``<id_col>, held_out, lang_pred, score`` for each row of ``docs``.

    Rows whose id falls into the fold, and those with a null id, language or
    text, are not learned from. ``lang_pred`` is ``und`` and ``score`` 0 for a
    null text, one without a letter, and where nothing was learned. Equal
    distances go to the smaller language, equal counts to the smaller n-gram.
    Whole texts are read, however long. Repeated rows stay, other columns are
    not read, an empty table gives no rows.
    """
    data = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).withColumn("held", held_out(F.col("id"), parts, fold))
    profiles = learn(data.where(~F.col("held") & F.col("id").isNotNull()), "lang", "text")
    found = identify(data.select("id", "held", "text"), profiles, "text")
    return found.select(F.col("row.id").alias(id_col), F.col("row.held").alias("held_out"), "lang_pred", "score")
