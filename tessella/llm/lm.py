"""LM scoring (operator 7): a probabilistic suffix tree of word contexts.

* Contexts of up to ``DEPTH`` words are candidates if they occur ``LEAST_CONTEXT``
  times (Ron, Singer and Tishby), and of their next words those that occur
  there ``LEAST_NEXT`` times. Both are counts, so the tree grows with the corpus.
* A divergence test keeps a next word of a context if its count there differs
  from what the parent's distribution expects by more than its cost: the
  likelihood ratio must reach ``2 ln N``. A context with such a word is a state;
  its parent is the context without its first word.
* A state's distribution is smoothed: kept words by a Dirichlet prior of weight
  ``PRIOR`` on the parent's distribution, all others by the parent's, scaled so
  that the sum is 1. Below all states are the add-one word counts.
* A token is scored by the longest suffix of its history that is a state.

The score of a token is a sum: its word's own probability, for each suffix that
is a state its scale, and for each that keeps the word a correction that makes up
for the scale and the parent. So a document's score is a sum over keys, and keys
can be looked up where that is cheapest: the ``MOST_WORDS`` commonest words and
the ``MOST_PARTS`` commonest parts of the tree are broadcast; the others are met
by a shuffled join after they have been added up per document. A filter of bounded size keeps back keys that the tree doesn't have.
What is broadcast changes no score. All counts cover all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import _sketch, _text
from tessella.llm._cluster import bound_batches, cut, release, remove
from tessella.llm.language import held_out

#: Words of a context at most.
DEPTH = 3
#: Occurrences of a context, and of a next word in it, at least.
LEAST_CONTEXT, LEAST_NEXT = 64, 8
#: Weight of the parent's distribution, in tokens.
PRIOR = 5.0
#: Words, and contexts and next words together, that are broadcast at most (16 bytes each).
MOST_WORDS, MOST_PARTS = 1_000_000, 2_000_000
#: Keys that a task adds up in memory before it passes counts on.
HELD_KEYS = 1 << 20
#: Buckets of contexts for each partition of a shuffle.
BUCKETS = 8
#: What follows a context with more than one in so many tokens is dealt to several buckets, each with that share at most.
SALTED = 1000

END = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first row, tokens, splits`` of chunks: hashed words, and an end after each row."""
    for first, _, data, offsets in _text.chunks(column):
        words, splits = _text.hash_words(data, offsets, fold=True)
        out = np.full(len(words) + len(splits) - 1, END, np.uint64)
        out[np.arange(len(words)) + _text.rows_of(splits)] = words
        yield first, out, splits + np.arange(len(splits))


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where sorted ``keys`` hold each of ``wanted``; -1 if they don't."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context with one more word after it."""
    return _text.mix(context * _STEP + word)


def _added_up(texts: DataFrame, keys_of, batch_of, schema: str) -> DataFrame:
    """Rows that ``batch_of(columns, n)`` makes of combinations of keys and how often a task has them.

    ``keys_of(tokens, splits)`` gives a combined key per occurrence, then its
    parts. A task adds up what it holds before it passes it on.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        size = 0

        def added() -> tuple[np.ndarray, ...]:
            columns = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            key, first, where = np.unique(columns[0], return_index=True, return_inverse=True)
            return (key, *(c[first] for c in columns[1:-1]), np.bincount(where, columns[-1], len(key)).astype(np.int64))

        for batch in batches:
            for _, stream, splits in tokens(batch.column(0)):
                found = keys_of(stream, splits)
                if len(found[0]):
                    waiting.append((*found, np.ones(len(found[0]), np.int64)))
                    size += len(found[0])
                if size > HELD_KEYS:
                    row = added()
                    if len(row[0]) > HELD_KEYS // 2:
                        yield from batch_of(row[1:-1], row[-1])
                        waiting, size = [], 0
                    else:
                        waiting, size = [row], len(row[0])
        if waiting:
            row = added()
            yield from batch_of(row[1:-1], row[-1])

    return texts.mapInArrow(one, schema)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` of all tokens of ``texts(text)``."""

    def batch_of(columns: tuple[np.ndarray, ...], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(n), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(_text.signed(columns[0][k : k + 100_000])), pa.array(n[k : k + 100_000])], ["word", "n"])

    rows = _added_up(texts, lambda stream, splits: (stream, stream), batch_of, "word bigint, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, keys_of, salts) -> DataFrame:
    """``name, word, n``: how often each word follows each context of ``keys_of``.

    Contexts are dealt to buckets, ``BUCKETS`` for each partition. A row of the
    shuffle holds all pairs of a bucket in a task by context, so that there are
    few rows and a context's repetitions are compressed away. ``salts``: a
    broadcast of common contexts and of the buckets that each is dealt to.
    """
    buckets = BUCKETS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def batch_of(columns: tuple[np.ndarray, ...], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        context, word = columns
        common, parts = salts.value
        at = find(common, context)
        share = np.where(at >= 0, parts[np.maximum(at, 0)] if len(parts) else 1, 1).astype(np.uint64)
        bucket = (_text.mix(context + word % share) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((context, bucket))
        context, word, bucket, n = context[order], word[order], bucket[order], n[order]
        starts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(n))
        for k in range(0, len(starts) - 1, 100):
            edges = starts[k : k + 101]
            lo, hi = int(edges[0]), int(edges[-1])
            offsets = pa.array((edges - lo).astype(np.int32))
            parts_of = [pa.array(_text.signed(context[lo:hi])), pa.array(_text.signed(word[lo:hi])), pa.array(n[lo:hi].astype(np.int32))]
            lists = [pa.ListArray.from_arrays(offsets, x) for x in parts_of]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), *lists], ["bucket", "names", "words", "counts"])

    rows = _added_up(texts, keys_of, batch_of, "bucket int, names array<bigint>, words array<bigint>, counts array<int>")
    each = rows.repartition("bucket").select("bucket", "names", "counts", F.posexplode("words").alias("k", "word"))
    each = each.select("bucket", F.get("names", F.col("k")).alias("name"), "word", F.get("counts", F.col("k")).alias("n"))
    return each.groupBy("bucket", "name", "word").agg(F.sum("n").alias("n")).drop("bucket")


ROOT = np.uint64(0)


def history(stream: np.ndarray, splits: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the hash of the ``depth`` tokens before it, and whether its document has them."""
    context = np.full(len(stream), ROOT)
    for back in range(depth, 0, -1):
        before = np.zeros(len(stream), np.uint64)
        before[back:] = stream[: max(0, len(stream) - back)]
        context = joined(context, before)
    place = np.arange(len(stream)) - np.repeat(splits[:-1], np.diff(splits))
    return context, place >= depth


#: What tells a context's scale from the correction of the same words as context and next word.
_SCALE = np.uint64(0xA0761D6478BD642F)


@dataclass
class Part:
    """Sorted keys with a figure each."""

    keys: np.ndarray
    figures: np.ndarray

    @classmethod
    def of(cls, table: DataFrame, key: str, figure: str) -> Part:
        found = table.select(key, figure).toArrow()
        keys, figures = found[key].to_numpy().view(np.uint64), found[figure].to_numpy()
        order = np.argsort(keys)
        return cls(keys[order], figures[order])


@dataclass
class Model:
    """What scoring needs: counts of common words, common parts of the tree and a filter of all its keys. ``total`` is N, ``size`` V."""

    total: int
    size: int
    depth: int
    words: Part
    tree: Part
    keys: np.ndarray

    def base(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 of the words' own probability, 0 for those that aren't broadcast; which are."""
        at = find(self.words.keys, stream)
        if not len(self.words.keys):
            return np.zeros(len(stream)), at >= 0
        return np.where(at >= 0, np.log10((self.words.figures[np.maximum(at, 0)] + 1) / (self.total + self.size + 1)), 0.0), at >= 0

    def walk(self, stream: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the broadcast parts add to each token's score; then places and keys that others may have a figure for."""
        logs, places, keys = np.zeros(len(stream)), [], []
        for depth in range(1, self.depth + 1):
            context, there = history(stream, splits, depth)
            there = np.flatnonzero(there)
            for key in (context[there] ^ _SCALE, joined(context[there], stream[there])):
                may = np.flatnonzero(_sketch.passes(self.keys, key))
                at = find(self.tree.keys, key[may])
                hit = at >= 0
                logs[there[may[hit]]] += self.tree.figures[at[hit]]
                places.append(there[may[~hit]])
                keys.append(key[may[~hit]])
        none = np.zeros(0, np.int64)
        return logs, np.concatenate([none, *places]), np.concatenate([none.view(np.uint64), *keys])


def _hashed(table: DataFrame, context: str, word: str, name: str) -> DataFrame:
    """``table`` with the hash of a context with a word after it."""
    columns = table.columns

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in (context, word)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_text.signed(joined(*parts)))], [*columns, name])

    return table.mapInArrow(one, table.withColumn(name, F.lit(None).cast("bigint")).schema)


def _commonest(table: DataFrame, most: int) -> Column:
    """Which rows of ``table(n)`` are among the ``most`` with the greatest ``n``; of those equal at the border none."""
    found, least = 0, None
    for r in sorted(table.groupBy("n").agg(F.count("*").alias("c")).collect(), key=lambda r: -r["n"]):  # different counts are few
        found += r["c"]
        if found > most:
            break
        least = r["n"]
    return F.lit(False) if least is None else F.col("n") >= least


def train(
    texts: DataFrame, depth: int = DEPTH, least_context: int = LEAST_CONTEXT, least_next: int = LEAST_NEXT, prior: float = PRIOR, most_words:
    int = MOST_WORDS, most_parts: int = MOST_PARTS,
) -> tuple[Model, DataFrame]:
    """The model of ``texts(text)``, and the written table ``kind, key, figure``: counts of all words (0), what the rare parts of the tree add (1)."""
    spark = texts.sparkSession
    vocabulary = cut(word_counts(texts), "lm-words")
    whole = vocabulary.agg(F.sum("n").alias("total"), F.count("*").alias("size")).first()
    total, size = whole["total"] or 0, whole["size"]
    words = Part.of(vocabulary.where(_commonest(vocabulary, most_words)), "word", "n")
    heads = vocabulary.where((F.col("n") >= least_context) & (F.col("word") != int(_text.signed(np.asarray([END]))[0]))).withColumn("context", F.lit(int(ROOT)))
    contexts = cut(_hashed(heads, "context", "word", "name").select("name", F.col("context").alias("tail"), F.col("n").alias("total")), "lm-contexts")
    below = vocabulary.where(F.col("n") >= least_next).select(F.col("word").alias("key"), F.log10((F.col("n") + 1) / F.lit(float(total + size + 1))).alias("log"))
    parts = []
    for d in range(1, depth + 1):
        held = contexts.count()
        if not held:
            break
        shared = spark.sparkContext.broadcast((_sketch.key_filter(contexts.select("name"), held), _sketch.key_filter(below.select("key"), below.count())))
        release(spark)
        common = Part.of(contexts.where(F.col("total") * SALTED > total), "name", "total")  # SALTED rows at most
        salts = spark.sparkContext.broadcast((common.keys, -(-common.figures * SALTED // max(total, 1))))
        pairs = cut(pair_counts(texts, _follows(shared, d), salts).where(F.col("n") >= least_next), "lm-pairs")
        grown, states = _tested(pairs, contexts, below, d, total, prior)
        scale_key = F.col("name").bitwiseXOR(F.lit(int(_SCALE.view(np.int64))))
        parts.append(states.select(scale_key.alias("key"), F.col("scale").alias("figure"), F.col("total").alias("n")))
        parts.append(grown.where("delta is not null").select("key", F.col("delta").alias("figure"), "n"))
        remove(pairs)
        longer = grown.where((F.col("n") >= least_context) & (F.col("word") != int(_text.signed(np.asarray([END]))[0])))
        contexts = cut(longer.select(F.col("key").alias("name"), F.col("parent").alias("tail"), F.col("n").alias("total")), "lm-contexts")
        below = grown.select("key", "log")
    tree = spark.createDataFrame([], "key bigint, figure double, n bigint")
    for part in parts:
        tree = tree.unionByName(part)
    tree = cut(tree, "lm-tree")
    release(spark)
    often = _commonest(tree, most_parts)
    model = Model(total, size, depth, words, Part.of(tree.where(often), "key", "figure"), _sketch.key_filter(tree.select("key"), tree.count()))
    rare = tree.where(~often).select(F.lit(1).alias("kind"), "key", "figure")
    return model, cut(vocabulary.select(F.lit(0).alias("kind"), F.col("word").alias("key"), F.col("n").cast("double").alias("figure")).unionByName(rare), "lm-figures")


def _follows(shared, depth: int):
    """Which tokens to count after which contexts of ``depth`` words: those that may be frequent enough, judged by their parts."""

    def follows(stream: np.ndarray, splits: np.ndarray):
        contexts, below = shared.value
        context, there = history(stream, splits, depth)
        there = np.flatnonzero(there)
        there = there[_sketch.passes(contexts, context[there])]
        shorter = joined(history(stream, splits, depth - 1)[0][there], stream[there]) if depth > 1 else stream[there]
        there = there[_sketch.passes(below, shorter)]
        context, word = context[there], stream[there]
        return joined(context, word), context, word

    return follows


def _tested(pairs: DataFrame, contexts: DataFrame, below: DataFrame, depth: int, total: int, prior: float) -> tuple[DataFrame, DataFrame]:
    """``key, parent, word, n, log, delta`` of pairs of context and next word, and the states ``name, scale, total``.

    ``log`` is the log10 probability of the word in the context; ``delta``, null
    for words that aren't kept, what it has over the scaled parent's.
    """
    known = _hashed(_hashed(pairs.join(contexts, "name"), "name", "word", "key"), "tail", "word", "parent")
    met = below.select(F.col("key").alias("word" if depth == 1 else "parent"), F.col("log").alias("below"))
    known = known.join(met, "word" if depth == 1 else "parent")
    usual = F.pow(F.lit(10.0), "below")
    expected = F.col("total") * usual
    ratio = 2 * (F.col("n") * F.log(F.col("n") / expected) - (F.col("n") - expected))
    known = known.withColumn("keep", ratio >= 2 * float(np.log(max(total, 1)))).withColumn("share", (F.col("n") + prior * usual) / (F.col("total") + prior))
    known = cut(known, "lm-tested")
    left = lambda x: F.greatest(1 - F.sum(x), F.lit(1e-12))
    states = cut(known.where("keep").groupBy("name").agg(F.log10(left(F.col("share")) / left(F.pow(F.lit(10.0), "below"))).alias("scale"), F.first("total").alias("total")), "lm-states")
    scaled = F.coalesce("scale", F.lit(0.0)) + F.col("below")
    log = F.when(F.col("keep"), F.log10("share")).otherwise(scaled)
    grown = known.drop("total").join(states.select("name", "scale"), "name", "left").select("key", "parent", "word", "n", log.alias("log"), F.when(F.col("keep"), log - scaled).alias("delta"))
    return cut(grown, "lm-grown"), states


def _per_row(doc: np.ndarray, rows: int, kinds: np.ndarray, keys: np.ndarray) -> list[pa.Array]:
    """List columns: each row's distinct kinds and keys, and how often it has them."""
    order = np.lexsort((keys, kinds, doc))
    doc, kinds, keys = doc[order], kinds[order], keys[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (kinds[1:] != kinds[:-1]) | (keys[1:] != keys[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(doc)))
    offsets = pa.array(np.searchsorted(doc[begin], np.arange(rows + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (kinds[begin], _text.signed(keys[begin]), times.astype(np.int64))]


def lm_score(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", parts: int = 7, fold: int = 2, depth: int = DEPTH, least_context: int =
    LEAST_CONTEXT, least_next: int = LEAST_NEXT, prior: float = PRIOR, most_words: int = MOST_WORDS, most_parts: int = MOST_PARTS,
) -> DataFrame:
    """``<id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    Learns from rows whose id doesn't fall into the fold; scores all. Tokens
    are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end.
    ``base_score`` sums ``log10((c + 1) / (N + V + 1))``, ``score`` the tree's
    log10 probabilities. ``depth``, ``least_context``, ``least_next`` and
    ``prior`` shape the tree, the others only tell what is broadcast.

    Null and empty texts are one end. Rows with a null id are scored but not
    learned from. Repeated rows stay and count as often as they are there.
    Without a row to learn from both scores are those of a uniform symbol.
    Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    data = docs.select(F.col(f"`{id_col}`").alias("id"), held_out(F.col(f"`{id_col}`"), parts, fold).alias("held"), F.col(f"`{text}`").alias("text"))
    model, figures = train(data.where(~F.col("held") & F.col("id").isNotNull()).select("text"), depth, least_context, least_next, prior, most_words, most_parts)
    shared = spark.sparkContext.broadcast(model)
    kind = data.schema["id"].dataType.simpleString()
    schema = f"row bigint, id {kind}, held boolean, n_tokens bigint, n_known bigint, base double, score double, kinds array<int>, keys array<bigint>, times array<bigint>"
    names = [x.split()[0] for x in schema.split(", ")]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, stream, splits in tokens(batch.column(2)):
                rows = len(splits) - 1
                base, known = model.base(stream)
                more, places, keys = model.walk(stream, splits)
                doc, spare = _text.rows_of(splits), np.flatnonzero(~known)
                kinds = np.repeat(np.asarray([0, 1], np.int32), [len(spare), len(places)])
                lists = _per_row(doc[np.concatenate([spare, places])], rows, kinds, np.concatenate([stream[spare], keys]))
                sums = [pa.array(np.bincount(doc, x, rows)) for x in (base, base + more)]
                numbers = [pa.array(np.diff(splits)), pa.array(np.bincount(doc, known, rows).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(rows)), batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), *numbers, *sums, *lists], names)
                row += rows

    release(spark)
    scored = cut(data.mapInArrow(one, schema), "lm-scored")
    spare = scored.select("row", F.explode(F.arrays_zip("kinds", "keys", "times")).alias("x")).select("row", F.col("x.kinds").alias("kind"), F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    met = spare.join(figures, ["kind", "key"], "left")
    word, found = F.col("kind") == 0, F.col("figure").isNotNull()
    own = F.log10((F.coalesce("figure", F.lit(0.0)) + 1) / F.lit(float(model.total + model.size + 1)))
    rest = met.groupBy("row").agg(
        F.sum(F.when(word, F.col("times") * own).otherwise(0.0)).alias("rest"),
        F.sum(F.when(~word & found, F.col("times") * F.col("figure")).otherwise(0.0)).alias("deeper"),
        F.sum(F.when(word & found, F.col("times")).otherwise(0)).alias("more"),
    )
    base = F.col("base") + F.coalesce("rest", F.lit(0.0))
    score = F.col("score") + F.coalesce("rest", F.lit(0.0)) + F.coalesce("deeper", F.lit(0.0))
    known = F.col("n_known") + F.coalesce("more", F.lit(0))
    out = scored.drop("kinds", "keys", "times").join(rest, "row", "left")
    learned = F.lit(model.total).cast("bigint").alias("train_tokens")
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", known.alias("n_known"), learned, base.alias("base_score"), score.alias("score")
    )
