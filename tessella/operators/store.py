"""The hash cache as a store of versions: a bucketed base, deltas of what changed, and a manifest for each version.

Writing adds a delta with the rows that it is given and then the manifest of the
next version; nothing that exists is changed. A writer that fails leaves files
that no manifest names. A reader keeps the version that it began with. Reading
folds the deltas, which are small, and joins them to the base, which is bucketed
and sorted by path and isn't shuffled. After ``FANOUT`` deltas the next
writer makes a new base first.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.cache import MOST_ROWS, SAMPLES
from tessella.operators.rank import ranked

#: Deltas that are folded when reading, before they are merged into a new base.
FANOUT = 8
#: Bins of one histogram of times.
_BINS = 1 << 12
COLUMNS = {"path": "string", "size": "bigint", "mtime_ns": "bigint", **dict.fromkeys(SAMPLES, "bigint"), "full": "string", "last_hit": "bigint", "dev": "bigint", "ino": "bigint"}
_REST = [c for c in COLUMNS if c != "path"]
_SCHEMA = ", ".join(f"{c} {k}" for c, k in COLUMNS.items())
_ROW = "struct<" + ", ".join(f"{c}: {COLUMNS[c]}" for c in _REST) + ">"


class Conflict(RuntimeError):
    """Another writer has made this version."""


def _put(old: Column, new: Column) -> Column:
    """A row after an upsert; ``old`` may be null.

    Samples that are all zero leave the old ones. A new full hash wins; without
    one the old stays if size, time and samples are the same or no samples came.
    """
    blank, equal = F.lit(True), F.lit(True)
    for c in SAMPLES:
        blank &= F.coalesce(new[c], F.lit(0)) == 0
        equal &= new[c].eqNullSafe(old[c])
    same = (old["size"] == new["size"]) & (old["mtime_ns"] == new["mtime_ns"])
    values = {c: new[c] for c in _REST}
    for c in SAMPLES:
        values[c] = F.when(blank & old.isNotNull(), old[c]).otherwise(new[c])
    values["full"] = F.when(new["full"].isNotNull(), new["full"]).when(old.isNotNull() & same & (equal | blank), old["full"])
    return F.struct(*[values[c].alias(c) for c in _REST])


def _applied(old: Column, change: Column) -> Column:
    """A row after one change of kind ``put``, ``touch`` or ``drop``."""
    touched = F.struct(*[(change["row"][c] if c == "last_hit" else old[c]).alias(c) for c in _REST])
    return F.when(change["kind"] == "put", _put(old, change["row"])).when((change["kind"] == "touch") & old.isNotNull(), touched).when(change["kind"] == "touch", old)


class CacheStore:
    """A store in ``folder``, which is made if it isn't there; ``buckets`` hold then and stay."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        path = self._path("")
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._names: set[str] = set()
        newest = max(self._versions(), default=0)
        if newest:
            self.state = self._load(newest)
        else:
            self.state = {"version": 0, "buckets": buckets, "base": None, "deltas": [], "commits": {}}

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(""))]
        return [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]

    def _load(self, version: int) -> dict:
        rows = self.spark.read.text(f"{self.folder}/manifest-{version}.json", wholetext=True).collect()
        return json.loads(rows[0]["value"])

    def at(self, version: int) -> CacheStore:
        """The store as it was at a version that ``vacuum`` hasn't removed."""
        out = CacheStore(self.spark, self.folder, fanout=self.fanout)
        out.state = self._load(version)
        return out

    def _commit(self, **changed) -> None:
        """Write the manifest of the next version; ``Conflict`` if there is one."""
        state = self.state | changed | {"version": self.state["version"] + 1}
        name = f"manifest-{state['version']}.json"
        part = f"{name}.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(part), False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(self._path(part), self._path(name)):
            self._fs.delete(self._path(part), False)
            raise Conflict(f"version {state['version']} of {self.folder} is there")
        self.state = state

    def _table(self, name: str, schema: str) -> DataFrame:
        """A bucketed table by the files in the folder; the catalog's entry is this session's only."""
        table = f"cache_{name.replace('-', '_')}"
        if table not in self._names:
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet CLUSTERED BY (path) SORTED BY (path) INTO {self.state['buckets']} BUCKETS LOCATION '{self.folder}/{name}'")
            self._names.add(table)
        return self.spark.table(table)

    def _write_base(self, rows: DataFrame) -> str:
        name = f"base-{uuid.uuid4().hex}"
        table = f"cache_{name.replace('-', '_')}"
        dealt = rows.select(*COLUMNS).repartition(self.state["buckets"], "path").sortWithinPartitions("path")
        dealt.write.bucketBy(self.state["buckets"], "path").sortBy("path").option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(table)
        self._names.add(table)
        return name

    def _write_delta(self, kind: str, rows: DataFrame, commit: tuple[str, int] | None) -> None:
        """A delta of ``rows``, and the version that has it."""
        if len(self.state["deltas"]) >= self.fanout:
            self.compact()
        name = f"delta-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        commits = self.state["commits"] | ({commit[0]: commit[1]} if commit else {})
        self._commit(deltas=[*self.state["deltas"], {"name": name, "kind": kind}], commits=commits)

    def committed(self, stream: str) -> int:
        """The last batch of a stream that is in this version; -1 if none is."""
        return self.state["commits"].get(stream, -1)

    def upsert(self, entries: DataFrame, commit: tuple[str, int] | None = None) -> bool:
        """Put ``entries`` in; of several of a path the greatest row counts. A batch ``(stream, number)`` that is in already is left out; whether it wasn't."""
        if commit and self.committed(commit[0]) >= commit[1]:
            return False
        own = entries.where("path is not null").groupBy("path").agg(F.max(F.struct(*[F.col(c).cast(COLUMNS[c]).alias(c) for c in _REST])).alias("row"))
        self._write_delta("put", own, commit)
        return True

    def touch(self, hits: DataFrame, now: int) -> None:
        """``last_hit`` of the paths in ``hits(path)`` becomes ``now``; others aren't added."""
        row = F.struct(*[(F.lit(now) if c == "last_hit" else F.lit(None)).cast(COLUMNS[c]).alias(c) for c in _REST])
        self._write_delta("touch", hits.select("path").where("path is not null").distinct().select("path", row.alias("row")), None)

    def read(self) -> DataFrame:
        """The cache of this version, a row for each path."""
        base = None if self.state["base"] is None else self._table(self.state["base"], _SCHEMA)
        deltas = self.state["deltas"]
        if not deltas:
            return base if base is not None else self.spark.createDataFrame([], _SCHEMA)
        changes = None
        for k, d in enumerate(deltas):
            one = self.spark.read.schema(f"path string, row {_ROW}").parquet(f"{self.folder}/{d['name']}").select("path", F.lit(k).alias("at"), F.lit(d["kind"]).alias("kind"), "row")
            changes = one if changes is None else changes.unionByName(one)
        folded = changes.repartition(self.state["buckets"], "path").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "row"))).alias("changes"))  # a change a delta at most
        none = F.lit(None).cast(_ROW)
        if base is None:
            out = folded.select("path", F.lit(None).cast(_ROW).alias("old"), "changes")
        else:
            had = base.select(F.col("path").alias("had"), F.struct(*_REST).alias("old"))
            out = had.hint("merge").join(folded, F.col("had") == F.col("path"), "full_outer").select(F.coalesce("path", "had").alias("path"), "old", "changes")
        row = F.when(F.col("changes").isNull(), F.col("old")).otherwise(F.aggregate(F.coalesce("changes", F.array().cast(f"array<struct<at: int, kind: string, row: {_ROW}>>")), F.coalesce("old", none), lambda old, c: _applied(old, c).cast(_ROW)))
        return out.select("path", row.alias("row")).where("row is not null").select("path", *[f"row.{c}" for c in _REST])

    def compact(self) -> None:
        """Merge base and deltas into a new base."""
        if self.state["deltas"]:
            self._commit(base=self._write_base(self.read()), deltas=[])

    def _threshold(self, rows: DataFrame, most: int) -> tuple[int, int] | None:
        """``time, n``: later rows all stay, and ``n`` of that time; null if all do. By histograms of ever smaller ranges."""
        found = rows.agg(F.count("*").alias("n"), F.min("last_hit").alias("lo"), F.max("last_hit").alias("hi")).first()
        if found["n"] <= most:
            return None
        lo, hi, left = found["lo"], found["hi"], most
        while True:
            step = -(-(hi - lo + 1) // _BINS)
            part = rows.where(F.col("last_hit").between(lo, hi)).groupBy(F.expr(f"(last_hit - {lo}) div {step}").alias("bin")).agg(F.count("*").alias("n"))
            for r in sorted(part.collect(), key=lambda r: -r["bin"]):  # _BINS rows at most
                if r["n"] > left:
                    lo, hi = lo + r["bin"] * step, min(hi, lo + (r["bin"] + 1) * step - 1)
                    break
                left -= r["n"]
            else:
                return lo - 1, 0
            if lo == hi:
                return lo, left

    def evict(self, most: int = MOST_ROWS) -> int:
        """Drop all but the ``most`` latest by ``last_hit``, then the greatest paths; how many went. Only rows of one time are ranked."""
        rows = self.read().withColumn("last_hit", F.coalesce("last_hit", F.lit(0)))
        found = self._threshold(rows, most)
        if found is None:
            return 0
        time, n = found
        gone = rows.where(F.col("last_hit") < time).select("path")
        tied = rows.where(F.col("last_hit") == time).select("path")
        gone = gone.unionByName(ranked(tied, [F.col("path").desc()], "k").where(F.col("k") > n).select("path"))
        self._write_delta("drop", gone.select("path", F.lit(None).cast(_ROW).alias("row")), None)
        return self.spark.read.parquet(f"{self.folder}/{self.state['deltas'][-1]['name']}").count()

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete what none of the newest ``keep`` versions names, also what failed writers left; the names."""
        versions = sorted(self._versions())[-keep:]
        named = {f"manifest-{v}.json" for v in versions}
        for v in versions:
            state = self._load(v)
            named |= {state["base"]} | {d["name"] for d in state["deltas"]}
        there = [f.getPath().getName() for f in self._fs.listStatus(self._path(""))]
        gone = [n for n in there if n not in named]
        for n in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS cache_{n.replace('-', '_')}") if n.startswith("base-") else None
            self._fs.delete(self._path(n), True)
        return gone

    def close(self) -> None:
        """Take this session's names of the store's files out of the catalog; the files stay."""
        for table in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._names = set()

