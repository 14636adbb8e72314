"""Substring deduplication (operator 9) on a log-structured fingerprint index.

A window is a run of ``window`` words of one document. Every word goes that is
covered by a window whose words also start in a document with a smaller id;
windows are judged on the input. Storing each window's hash would take more
room than the text, so the index holds selected ones: of the ``gram``-word runs
inside a window the one with the smallest hash (winnowing). Equal windows
select equal runs, so a window can only repeat where a selected run does.

* The index is a folder of immutable runs, tables bucketed and sorted by hash:
  ``h, lo, hi``, the smallest and largest document that hold hash ``h``. It can
  be opened again in another session.
* Each batch of documents becomes a run. It is merge-joined with the runs of
  history, bucket by bucket and without a shuffle: hashes that occur in two
  documents are repeated.
* Runs have levels. When there are more than ``FANOUT`` of a level, they are
  merged into one of the next, before the next batch is joined with them; so a
  hash is rewritten once a level. What a last batch leaves is never merged.
* Verification: around repeated hashes full windows are hashed to 128 bits,
  and the smallest document of each is found by an aggregation that combines
  before it shuffles, so a passage that very many documents share is one row
  per task. A join hands the minimum back to the windows that repeat it.

Documents with the same words form a class and are fingerprinted once: all
words of a copy go (if they fill a window), whatever else holds them.
Texts that nothing repeats are never shuffled: a Bloom filter of fixed size
tells which rows have to meet the results.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import _sketch, _text
from tessella.llm._cluster import bound_batches, cut, release, remove, scratch

#: Runs that the index holds before it merges them.
FANOUT = 2
#: Hashes of a run that one bucket holds before the index is dealt into more.
BUCKET_ROWS = 1 << 22
#: Words of the runs that are selected from a window.
GRAM = 16


def _slide(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (np.minimum or np.maximum) over all runs of ``width`` elements, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = of(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return of(x[: len(x) - rest], x[rest:]) if rest else x


def select(runs: np.ndarray, splits: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Places of the hashes that some window of one row selects; ``runs``: hashes of all ``gram``-word runs of the rows."""
    width = window - gram + 1
    low = _slide(runs, width, np.minimum)
    low = np.where(_text.inside(splits, window), low, 0)
    edge = np.zeros(width - 1, np.uint64)
    high = _slide(np.concatenate([edge, low, edge]), width, np.maximum)
    return np.flatnonzero((high == runs) & (high > 0))


def sequence_class(words: np.ndarray) -> bytes:
    """128 bits that stand for a sequence of hashed words."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def _each(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for first, end, data, offsets in _text.chunks(column):
        words, splits = _text.hash_words(data, offsets, fold=False)
        for r in range(end - first):
            yield first + r, words[splits[r] : splits[r + 1]]


def fingerprints(docs: DataFrame, window: int, gram: int, only=None) -> DataFrame:
    """``doc, seq, n, anchors, places`` of each row of ``docs(doc, text)`` with a window and an id; the arrays once a class and task.

    ``only``: a broadcast filter of hashes, of which a row must have one.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            docs, seqs, sizes, anchors, places = [], [], [], [], []
            for first, end, data, offsets in _text.chunks(batch.column(1)):
                words, splits = _text.hash_words(data, offsets, fold=False)
                runs = _text.grams(words, gram)
                chosen = select(runs, splits, window, gram) if len(words) >= window else np.zeros(0, np.int64)
                edge = np.searchsorted(chosen, splits)
                for r in range(end - first):
                    lo, hi = int(splits[r]), int(splits[r + 1])
                    if hi - lo < window:
                        continue
                    if only is not None and not _sketch.passes(only.value, runs[chosen[edge[r] : edge[r + 1]]]).any():
                        continue
                    seq = sequence_class(words[lo:hi])
                    own = chosen[edge[r] : edge[r + 1]] if seq not in seen else None
                    seen.add(seq)
                    docs.append(first + r)
                    seqs.append(seq)
                    sizes.append(hi - lo)
                    anchors.append(None if own is None else _text.signed(runs[own]))
                    places.append(None if own is None else own - lo)
            none = np.zeros(0, np.int64)
            fresh = pa.array([a is not None for a in anchors])
            lists = [pa.compute.if_else(fresh, _text.list_array([none if p is None else p for p in part], kind), None) for part, kind in ((anchors, pa.int64()), (places, pa.int32()))]
            if docs:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs)), pa.array(seqs, pa.binary()), pa.array(sizes, pa.int64()), *lists], ["doc", "seq", "n", "anchors", "places"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.where("doc is not null and text is not null").select("doc", "text").mapInArrow(one, f"doc {kind}, seq binary, n bigint, anchors array<bigint>, places array<int>")


def _classes(prints: DataFrame) -> DataFrame:
    """``seq, least, most, anchors, places``: the documents of each class and its fingerprints."""
    return prints.groupBy("seq").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.first("anchors", ignorenulls=True).alias("anchors"), F.first("places", ignorenulls=True).alias("places"))


def _merged(classes: DataFrame) -> DataFrame:
    return cut(classes.groupBy("seq").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.first("anchors", ignorenulls=True).alias("anchors"), F.first("places", ignorenulls=True).alias("places")), "dedup-classes")


class FingerprintIndex:
    """Runs of fingerprints ``h, lo, hi`` in a folder, a new one below the shared folder if none is named.

    A run is on record once the manifest that names it is written, so a failed
    ``add`` leaves the index as it was. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder or scratch(spark, "index"), fanout
        self.runs: list[dict] = []
        self.buckets, self.version = int(spark.conf.get("spark.sql.shuffle.partitions")), 0
        self._names: dict[str, str] = {}
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if self._fs.exists(path):
            self.version = max((int(f.getPath().getName()[9:-5]) for f in self._fs.listStatus(path) if f.getPath().getName().startswith("manifest-")), default=0)
        if self.version:
            found = json.loads("".join(r["value"] for r in spark.read.text(self._manifest(), wholetext=True).collect()))
            self.buckets, self.runs = found["buckets"], found["runs"]

    def _manifest(self) -> str:
        return f"{self.folder}/manifest-{self.version}.json"

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _record(self, runs: list[dict]) -> None:
        old = self._manifest()
        self.version += 1
        out = self._fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(self._manifest() + ".part"), True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "runs": runs}).encode()))
        out.close()
        self._fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(self._manifest() + ".part"), self.spark._jvm.org.apache.hadoop.fs.Path(self._manifest()))
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(old), False)
        for gone in (r for r in self.runs if r not in runs):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(gone['name'], gone['name'])}")
            self._fs.delete(self._path(gone["name"]), True)
        self.runs = runs

    def _write(self, run: DataFrame, level: int) -> dict:
        """A run by bucket, each sorted, on disk but not yet on record."""
        kind = run.schema["lo"].dataType.simpleString()
        name = f"run_{uuid.uuid4().hex}"
        self._names[name] = name
        dealt = run.select("h", "lo", "hi").repartition(self.buckets, "h").sortWithinPartitions("h")
        dealt.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        return {"name": name, "level": level, "kind": kind, "rows": self.spark.table(name).count()}

    def _table(self, run: dict) -> DataFrame:
        if run["name"] not in self._names:
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {run['name']} (h BIGINT, lo {run['kind']}, hi {run['kind']}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run['name']}'")
            self._names[run["name"]] = run["name"]
        return self.spark.table(run["name"])

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in ``batch(doc, h)`` as a run; the hashes of it that two documents of batch and history hold."""
        self.compact()
        new = self._write(batch.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")), 0)
        run = self._table(new)
        repeated = run.where("lo < hi").select("h")
        for old in self.runs:
            repeated = repeated.unionByName(run.select("h").join(self._table(old).select("h").hint("merge"), "h"))
        repeated = cut(repeated.distinct(), "index-repeated")
        self._record([*self.runs, new])
        return repeated

    def compact(self) -> None:
        """Merge the runs of each level that has more than ``fanout``, bucket by bucket."""
        level = 0
        while any(r["level"] >= level for r in self.runs):
            own = [r for r in self.runs if r["level"] == level]
            if len(own) > self.fanout:
                every = self._table(own[0])
                for run in own[1:]:
                    every = every.unionByName(self._table(run))
                merged = self._write(every.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), level + 1)
                self._record([*(r for r in self.runs if r not in own), merged])
            level += 1
        most = max((r.get("rows", 0) for r in self.runs), default=0)
        if most > BUCKET_ROWS * self.buckets:
            self.rebucket(-(-2 * most // BUCKET_ROWS))

    def rebucket(self, buckets: int) -> None:
        """Deal the index into that many buckets, in one run; all later runs have as many."""
        every = None
        for run in self.runs:
            every = self._table(run) if every is None else every.unionByName(self._table(run))
        old, self.buckets = self.buckets, buckets
        if every is None:
            return
        try:
            merged = self._write(every.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), max(r["level"] for r in self.runs))
            self._record([merged])
        except BaseException:
            self.buckets = old
            raise

    def forget(self) -> None:
        """Delete the index and its folder."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder), True)
        self.runs, self._names = [], {}


def _batches(classes: DataFrame, batches: int) -> list[DataFrame]:
    """``classes`` by ascending first document, in parts of about equal size."""
    if batches < 2:
        return [classes]
    some = classes.select("least").where("least is not null").orderBy(F.xxhash64("least")).limit(1000).collect()  # bounds need not be exact
    some = sorted(r["least"] for r in some)
    bounds = list(dict.fromkeys(some[len(some) * k // batches] for k in range(1, batches))) if some else []
    parts, least = [], F.col("least")
    for lo, hi in zip([None, *bounds], [*bounds, None], strict=True):
        parts.append(classes.where((F.lit(True) if lo is None else least > F.lit(lo)) & (F.lit(True) if hi is None else least <= F.lit(hi))))
    return parts


def repeated_starts(
    docs: DataFrame, classes: DataFrame, history: DataFrame | None, index: FingerprintIndex, window: int, gram: int, batches: int,
) -> tuple[DataFrame, DataFrame]:
    """``seq, starts``: where, in the first document of a class, windows start that a smaller document has as well; and all classes with a repeated hash of ``history``, if there is one."""
    posted = lambda rows: rows.select("seq", F.col("least").alias("doc"), F.explode(F.arrays_zip("anchors", "places")).alias("x")).select("seq", "doc", F.col("x.anchors").alias("h"), F.col("x.places").alias("place"))
    repeated = None
    for part in _batches(classes, batches):
        new = index.add(posted(part).select("doc", "h"))
        repeated = new if repeated is None else repeated.unionByName(new)
    repeated = repeated.distinct()
    if history is not None:
        kept = docs.sparkSession.sparkContext.broadcast(_sketch.key_filter(repeated, repeated.count()))
        classes = _merged(classes.unionByName(_classes(fingerprints(history, window, gram, kept))))
        docs = docs.unionByName(history)
    wanted = cut(posted(classes).join(repeated, "h").groupBy("seq", "doc").agg(F.collect_list("place").alias("places")), "dedup-wanted")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, out = batch.column(2), []
            for first, end, data, offsets in _text.chunks(batch.column(3)):
                a, splits = _text.hash_words(data, offsets, fold=False)
                b, _ = _text.hash_words(data, offsets, fold=False, seed=1)
                a, b = _text.grams(a, window, 1), _text.grams(b, window, 2)
                for r in range(end - first):
                    lo, n = int(splits[r]), int(splits[r + 1] - splits[r]) - window + 1
                    place = np.asarray(places[first + r].as_py())
                    near = np.zeros(n + 1, np.int32)  # windows that hold a repeated run
                    np.add.at(near, np.maximum(0, place + gram - window), 1)
                    np.add.at(near, np.minimum(n, place + 1), -1)
                    starts = np.flatnonzero(np.cumsum(near[:n]) > 0)
                    out.append((np.full(len(starts), first + r), a[lo + starts], b[lo + starts], starts))
            if out:
                row, a, b, starts = (np.concatenate(x) for x in zip(*out, strict=True))
                for k in range(0, len(row), 50_000):
                    s = slice(k, k + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(_text.signed(a[s])), pa.array(_text.signed(b[s])), batch.column(1).take(pa.array(row[s])), batch.column(0).take(pa.array(row[s])), pa.array(starts[s].astype(np.int32))], ["w1", "w2", "doc", "seq", "start"])

    release(docs.sparkSession)
    texts = _chosen(docs, wanted.select("seq"), once=True)
    kind = docs.schema["doc"].dataType.simpleString()
    joined = wanted.join(texts, "seq").dropDuplicates(["seq"]).select("seq", "doc", "places", "text")
    windows = cut(joined.mapInArrow(full, f"w1 bigint, w2 bigint, doc {kind}, seq binary, start int"), "dedup-windows")
    # written, so that the join below has shuffles on both sides and a passage that very many hold is split
    least = cut(windows.groupBy("w1", "w2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").drop("hi"), "dedup-least")
    starts = cut(windows.join(least, ["w1", "w2"]).where("doc > lo").groupBy("seq").agg(F.collect_list("start").alias("starts")), "dedup-starts")
    remove(wanted, windows, least)
    return starts, classes


def _seq64(seqs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(s[:8] for s in seqs), np.uint64)


def _filter_of(seqs: DataFrame):
    return seqs.sparkSession.sparkContext.broadcast(_sketch.bloom(seqs, lambda names: _seq64(names.to_pylist())))


def _chosen(docs: DataFrame, seqs: DataFrame, once: bool) -> DataFrame:
    """``seq, text`` of rows whose class may be in ``seqs``; ``once``: of each class one row a task."""
    wanted = _filter_of(seqs)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in batches:
            rows, names = [], []
            for r, words in _each(batch.column(0)):
                seq = sequence_class(words)
                if not (once and seq in seen) and _sketch.may_hold(bits, _seq64([seq]))[0]:
                    seen.add(seq)
                    rows.append(r)
                    names.append(seq)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), batch.column(0).take(pa.array(rows))], ["seq", "text"])

    return docs.where("doc is not null and text is not null").select("text").mapInArrow(one, "seq binary, text string")


def keep_words(text: str, starts: list[int] | None, all_go: bool, window: int, joined: bool) -> tuple[str, int, int]:
    """``text, n_words, n_removed`` after the words under windows at ``starts`` have gone."""
    words = text.encode().split()
    if all_go:
        return "", len(words), len(words)
    if not starts:
        return (b" ".join(words).decode() if joined else text), len(words), 0
    covered = np.zeros(len(words) + 1, np.int32)
    np.add.at(covered, np.asarray(starts), 1)
    np.add.at(covered, np.asarray(starts) + window, -1)
    keep = np.cumsum(covered[:-1]) == 0
    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    return b" ".join(kept).decode(), len(words), len(words) - len(kept)


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 50, gram: int = GRAM, batches: int = 3, joined: bool = False,
    index: FingerprintIndex | None = None, history: DataFrame | None = None,
) -> DataFrame:
    """``row, text, n_words, n_removed`` for each row of ``docs``.

    ``row`` is a struct of the input's other columns, so no name can clash;
    ``text`` is the kept text: kept words joined by one space where words were
    removed (or everywhere, with ``joined``), else the text as it was, and
    empty for a null. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. ``batches``:
    parts, in ascending id order, that enter the index one after the other.

    With an ``index`` that holds earlier documents, ``docs`` are judged against
    those as well, and enter it. Their texts are looked up in ``history``, a table
    with the same two columns; of it only rows with a repeated fingerprint are
    shuffled.

    Rows with a null id neither remove nor lose a word. Rows with the same id
    don't touch each other; repeated rows all get the same result. Ids are of
    any type that can be ordered. Texts shorter than a window stay whole. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rest = [c for c in docs.columns if c != text]
    data = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    plain = data.select("doc", "text")
    earlier = None if history is None else history.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    own = index or FingerprintIndex(spark)
    classes = cut(_classes(fingerprints(plain, window, gram)), "dedup-classes")
    starts, every = repeated_starts(plain, classes, earlier, own, window, gram, batches)
    if index is None:
        own.forget()
    results = cut(every.select("seq", "least", "most").join(starts, "seq", "left").where("starts is not null or least < most"), "dedup-results")
    remove(starts, classes)
    release(spark)
    wanted = _filter_of(results.select("seq"))
    out = T.StructType([data.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that surely lose nothing."""
        bits = wanted.value
        for batch in batches:
            ids, rows, texts, sizes = batch.column(1), [], [], []
            for r, words in _each(batch.column(2)):
                if len(words) < window or not ids[r].is_valid or not _sketch.may_hold(bits, _seq64([sequence_class(words)]))[0]:
                    new, n, _ = keep_words(batch.column(2)[r].as_py() or "", None, False, window, joined)
                    rows.append(r)
                    texts.append(new)
                    sizes.append(n)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(np.zeros(len(rows), np.int64))], out.names)

    between = T.StructType([data.schema["row"], data.schema["doc"], data.schema["text"], T.StructField("seq", T.BinaryType())])

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            rows, seqs = [], []
            for r, words in _each(batch.column(2)):
                seq = sequence_class(words)
                if len(words) >= window and _sketch.may_hold(bits, _seq64([seq]))[0]:
                    rows.append(r)
                    seqs.append(seq)
            if rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in range(3)), pa.array(seqs, pa.binary())], between.names)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [keep_words(t, s, bool(go), window, joined) for t, s, go in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)]
            if new:
                texts, sizes, gone = zip(*new, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], out.names)

    met = data.where("doc is not null").mapInArrow(doubtful, between).join(results, "seq", "left")
    met = met.select("row", "text", "starts", F.coalesce(F.col("doc") > F.col("least"), F.lit(False)).alias("go"))
    return data.mapInArrow(clear, out).unionByName(met.mapInArrow(rewrite, out))
