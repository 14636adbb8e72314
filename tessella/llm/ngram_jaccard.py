"""N-gram Jaccard join (operator 5): token-combination prefixes.

Two documents link when the Jaccard similarity of their sets of distinct word
n-grams reaches ``num / den``. No link between different texts is lost:

* Documents with equal sets form a class; the work is done on classes.
* A global order of n-grams, rarest first by a frequency sketch of fixed size,
  then by hash. Of a set of ``n`` at most ``m = n - ceil(n * num / den)``
  elements miss in a partner, so the first ``m + k`` elements of two linked
  sets share ``k`` of them, for any ``k`` (Chaudhuri et al., extended prefixes).
* Either the first n-gram that they share is of a rare class, which is indexed
  alone, or the first ``k`` are all of frequent classes. Those are dealt into
  ``k - 1`` groups by hash, and combinations of two of a group are indexed: two
  of ``k`` shared ones fall into one group. With ``k`` in proportion to ``m`` a set
  of any size has a few combinations for each n-gram that may miss.
* Linked sets are of similar size, so their sizes fall into the same or
  neighbouring bands, ``den / num`` wide. An aggregation notes for each key which
  bands are held; classes without a partner in reach go before any join.
* Candidates are pruned by a bound that is exact: bits that differ in two
  parity bitmaps are at most the size of the symmetric difference. Under a key
  that is done in blocks of bounded size, before any pair is a row. A block
  gives all its pairs if they are few, else a forest of them; such keys stay
  open. A key of several blocks has one class, the commonest, in all of them.
* Pairs are verified on the sets themselves and joined to components. Then only
  pairs from different components under open keys matter. Keys with the same
  largest component are taken together, so each class is compared once for all
  of them. Bitmaps, again in blocks, mark the classes that have a candidate;
  the sets of those are compared in blocks that give a forest of verified links.
  The largest component is never compared with itself or copied to more blocks
  than the rest needs, so a group of copies costs in proportion to its size.
* These links give the components, but not every link in them. A class links
  only within its component, so for link counts all sets of a component are
  compared, each pair once, in blocks whose links are added up before they are
  rows.

Texts are read three times: for the sketch and the classes, for keys, and for the
sets of those classes that have a candidate.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import _sketch, _text
from tessella.llm._cluster import bound_batches, cut, release, remove
from tessella.llm._graph import components

#: Classes under one key that are compared with each other in one piece.
BLOCK_ROWS = 2048
#: Pairs that a piece gives for each of its classes before it gives a forest.
PAIRS_EACH = 4
#: N-grams of the sets of one component that are compared with each other in one piece.
BLOCK_GRAMS = 1 << 18
#: Bands of sizes are numbered around a ring of so many bits.
_RING = 63
_SHIFT = np.uint64(64 - (_sketch.SKETCH_SLOTS.bit_length() - 1))


def shingle_sets(batch_text: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashed n-grams of each row; of fewer words the whole sequence, of none nothing."""
    for first, end, data, offsets in _text.chunks(batch_text):
        words, splits = _text.hash_words(data, offsets, fold=True)
        runs = {n: _text.grams(words, n) for n in range(1, width + 1)}
        for r in range(end - first):
            lo, hi = int(splits[r]), int(splits[r + 1])
            n = min(width, hi - lo)
            yield np.unique(runs[n][lo : hi - n + 1]) if n else np.zeros(0, np.uint64)


def class_of(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; None for the empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def parity_bits(shingles: np.ndarray, num: int, den: int) -> bytes:
    """Bit i tells whether an odd number of elements fall on i.

    There are four times as many bits, rounded up to a power of two, as elements
    may differ in a set of equal size that links; strangers differ in half of them.
    """
    size = max(64, 1 << (8 * len(shingles) * (den - num) // (den + num)).bit_length())
    return np.packbits((np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference of the sets behind two parity bitmaps."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        half = len(a) // 2
        a = (int.from_bytes(a[:half]) ^ int.from_bytes(a[half:])).to_bytes(half)
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def combination_groups(n: int, num: int, den: int) -> int:
    """Into how many groups a set of ``n`` deals its frequent n-grams before it combines those of a group; 0: they are indexed singly.

    Sets that link share one n-gram more than there are groups, so two of them
    fall into one. Half as many groups as n-grams may miss, a power of two, keep
    the combinations of a set of any size to some three for each of those.
    """
    least = -(-n * num // den)
    most = min(max(1, (n - least) // 2), least - 1)
    return 1 << (most.bit_length() - 1) if most > 0 else 0


def index_keys(shingles: np.ndarray, counts: np.ndarray, limit: int, num: int, den: int) -> np.ndarray:
    """Keys under which a set is indexed: two sets that link have one in common.

    The first n-gram that they share is among the first ``m + 1`` of each. If it
    is rare it is a key of both. If not, the first ``g + 1`` that they share are
    all frequent, and among the first ``m + g + 1`` of each; two of them are in
    one of ``g`` groups, and their combination is a key of both. ``g`` is that of
    the smaller set, so a set uses those of all sizes that may link with it.
    """
    n = len(shingles)
    m = n - -(-n * num // den)
    frequency = counts[(shingles >> _SHIFT).astype(np.int64)]
    order = np.argsort(frequency, kind="stable")
    head = order[: m + 1]
    keys = [shingles[head[frequency[head] <= limit]]]
    if len(head) and frequency[head[-1]] > limit:
        lo, hi = combination_groups(-(-n * num // den), num, den), combination_groups(n, num, den)
        if lo == 0:
            keys.append(shingles[head[frequency[head] > limit]])
        groups = max(1, lo)
        while groups <= hi:
            tail = order[: m + groups + 1]
            often = shingles[tail[frequency[tail] > limit]]
            group = (often >> np.uint64(20)) & np.uint64(groups - 1)
            by = np.lexsort((often, group))
            often, group = often[by], group[by]
            for step in range(1, len(often)):
                same = group[step:] == group[:-step]
                if not same.any():
                    break
                keys.append(_text.mix(often[:-step][same] * np.uint64(0xD6E8FEB86659FD93) + often[step:][same] + np.uint64(groups)))
            groups *= 2
    return np.concatenate(keys)


def size_band(n: int, num: int, den: int) -> int:
    """The band of a set of ``n``; sets that link are in the same or neighbouring bands of the ring."""
    return int(math.log(n) / max(math.log(den / num) * (1 + 1e-9), 1e-9)) % _RING


def _census(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """``doc, n, cls`` of each row, and among these rows the pieces of a sketch of all n-grams (``piece`` isn't null)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), *T.StructType.fromDDL(f"n bigint, cls binary, {_sketch.PIECE_SCHEMA}")])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(_sketch.SKETCH_SLOTS, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, sizes, classes = batch.column(0).type, [], []
            for shingles in shingle_sets(batch.column(1), width):
                np.add.at(counts, (shingles >> _SHIFT).astype(np.int64), 1)
                sizes.append(len(shingles))
                classes.append(class_of(shingles))
            none = [pa.nulls(len(sizes), t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), *none], schema.names)
        if kind is not None:
            pieces = _sketch.pieces_of(counts)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(pieces[0]), t) for t in (kind, pa.int64(), pa.binary())), *pieces], schema.names)

    return cut(rows.mapInArrow(one, schema), "jaccard-census")


def _classes(docs: DataFrame, text: str, width: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """``cls, h, n, band, commonness, keys, bits`` of each class that can link; ``h``: 64 bits of ``cls``."""
    limit = max(64, 4 * int(counts.sum()) // len(counts))
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in batches:
            rows: list[tuple] = []
            for shingles in shingle_sets(batch.column(0), width):
                n, cls = len(shingles), class_of(shingles)
                if cls is None or cls in seen or n * (den - num) < num:  # so small that only equal sets link
                    continue
                seen.add(cls)
                common = float(counts[(shingles >> _SHIFT).astype(np.int64)].mean())
                rows.append((cls, n, size_band(n, num, den), common, _text.signed(index_keys(shingles, counts, limit, num, den)), parity_bits(shingles, num, den)))
            if rows:
                cls, n, band, common, keys, bits = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls, pa.binary()), pa.array(_text.signed(_hash64(cls))), pa.array(n, pa.int64()), pa.array(band, pa.int32()), pa.array(common, pa.float64()), _text.list_array(list(keys), pa.int64()), pa.array(bits, pa.binary())],
                    ["cls", "h", "n", "band", "commonness", "keys", "bits"],
                )

    found = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(one, "cls binary, h bigint, n bigint, band int, commonness double, keys array<bigint>, bits binary")
    return cut(found.dropDuplicates(["cls"]), "jaccard-classes")


def _hash64(cls: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(c[:8] for c in cls), np.uint64)


def _next(bands: Column) -> Column:
    """Each bit of a ring moved up by one."""
    return F.shiftleft(bands, 1).bitwiseAND(F.lit((1 << _RING) - 1)).bitwiseOR(F.shiftright(bands, _RING - 1))


def _meetings(classes: DataFrame) -> DataFrame:
    """``key, h, held``: keys of which several classes hold one, with those that have one of similar size."""
    posted = classes.select("h", "band", F.explode("keys").alias("key"))
    own = F.expr("shiftleft(1L, band)")
    held = posted.groupBy("key").agg(F.count("*").alias("held"), F.bit_or(own).alias("bands"))
    crowded = F.bit_count("bands") < F.col("held")
    held = held.where((F.col("held") > 1) & (crowded | (F.col("bands").bitwiseAND(_next(F.col("bands"))) != 0)))
    met = F.col("bands").bitwiseAND(_next(own)) != 0
    met |= _next(F.col("bands")).bitwiseAND(own) != 0
    return cut(posted.join(held, "key").where(crowded | met).select("key", "h", "held"), "jaccard-rows")


def _folded(bits: list[bytes], size: int) -> np.ndarray:
    """Parity bitmaps as rows of 64-bit words, longer ones folded to ``size`` bytes."""
    out = np.zeros((len(bits), size // 8), np.uint64)
    for r, data in enumerate(bits):
        out[r] = np.bitwise_xor.reduce(np.frombuffer(data, np.uint64).reshape(-1, size // 8), axis=0)
    return out


class Block:
    """Classes that are compared with each other: ascending sizes, parity bitmaps, and the side of each.

    If there are two sides, only pairs across them count.
    """

    def __init__(self, sizes: np.ndarray, bits: list[bytes], sides: np.ndarray, num: int, den: int):
        self.sizes, self.bits, self.sides, self.num, self.den = sizes, bits, sides, num, den
        self.ends = np.searchsorted(sizes, sizes * den // num, side="right")
        self.two = bool((sides != sides[0]).any())
        self.widths = np.asarray([len(x) for x in bits])
        self.first, self.level, self.words = 0, 0, np.zeros((0, 0), np.uint64)

    def near(self, a: int, label: np.ndarray) -> np.ndarray:
        """Those after ``a`` with another label that the bounds on sizes and bitmaps allow; ``a`` must ascend."""
        end = int(self.ends[a])
        if end <= a + 1:
            return np.zeros(0, np.int64)
        allowed = label[a + 1 : end] != label[a]
        if self.two:
            allowed &= self.sides[a + 1 : end] != self.sides[a]
        at = np.flatnonzero(allowed) + a + 1
        if not len(at):
            return at
        if self.widths[a] != self.level:
            self.first, self.level = a, int(self.widths[a])
            self.words = _folded(self.bits[a:], self.level)
        far = np.bitwise_count(self.words[at - self.first] ^ self.words[a - self.first]).sum(axis=1)
        return at[far.astype(np.int64) * (self.den + self.num) <= (self.sizes[at] + self.sizes[a]) * (self.den - self.num)]


def near_pairs(block: Block, label: np.ndarray, most: float) -> tuple[list[tuple[int, int]], bool]:
    """Near pairs of unequal ``label``; or, if there are more than ``most``, a forest that joins what they join, and True."""
    pairs: list[tuple[int, int]] = []
    forest: list[tuple[int, int]] = []
    now, only_forest = label.copy(), most <= 0
    for a in range(len(label)):
        near = block.near(a, now if only_forest else label)
        if not len(near):
            continue
        if not only_forest:
            pairs += [(a, b) for b in near.tolist()]
        forest += _join(now, a, near)
        only_forest = only_forest or len(pairs) > most
    return (forest if only_forest else pairs), only_forest


def _join(label: np.ndarray, a: int, others: np.ndarray) -> list[tuple[int, int]]:
    """Give ``others`` and all with their labels that of ``a``; the pairs that did so."""
    new = others[label[others] != label[a]]
    met, where = np.unique(label[new], return_index=True)
    label[np.isin(label, met)] = label[a]
    return [(a, b) for b in new[where].tolist()]


def marked(block: Block, label: np.ndarray) -> np.ndarray:
    """Which have a near one of another label."""
    out = np.zeros(len(label), bool)
    for a in range(len(label)):
        near = block.near(a, label)
        out[near] = True
        out[a] |= len(near) > 0
    return out


def linked_forest(block: Block, label: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A forest of links of unequal ``label``, verified on the sets, that joins what all such links join."""
    _, items = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(block.sizes) - block.sizes
    own, now, out = np.zeros(int(items.max()) + 1, bool), label.copy(), []
    for a in range(len(label)):
        near = block.near(a, now)
        if not len(near):
            continue
        held = items[starts[a] : starts[a] + block.sizes[a]]
        own[held] = True
        first, last = int(starts[near[0]]), int(starts[near[-1]] + block.sizes[near[-1]])
        shared = np.add.reduceat(own[items[first:last]], starts[near[0] : near[-1] + 1] - first, dtype=np.int64)[near - near[0]]
        own[held] = False
        out += _join(now, a, near[shared * block.den >= (block.sizes[near] + block.sizes[a] - shared) * block.num])
    return out


def _by_piece(split: DataFrame, piece: list[str], columns: list[str], of, schema: str) -> DataFrame:
    """``of(piece, rows)`` of the rows of each piece, ``columns`` of ``split``, of which the first two order them."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"binary": pa.binary(), "bigint": pa.int64()}[x.split()[1]] for x in schema.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        def found(now: tuple | None, held: list[tuple]) -> list[tuple]:
            return list(of(now, sorted(held, key=lambda x: x[:2]))) if len(held) > 1 else []

        now, held, out = None, [], []
        for batch in batches:
            own = []
            for c in (*piece, *columns):
                column = batch.column(c)
                if pa.types.is_list(column.type):
                    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
                    own.append([flat[i:j].copy() for i, j in zip(ends[:-1], ends[1:], strict=True)])
                else:
                    own.append(column.to_pylist())
            for row in zip(*own, strict=True):
                if row[: len(piece)] != now:
                    out += found(now, held)
                    now, held = row[: len(piece)], []
                held.append(row[len(piece) :])
            if out:
                yield batch_of(out)
                out = []
        out += found(now, held)
        if out:
            yield batch_of(out)

    return split.repartition(*piece).sortWithinPartitions(*piece).mapInArrow(compare, schema)


def _first_pairs(rows: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b, open``: near pairs within each block under each key, all or a forest; rows with ``open`` name keys with a forest."""
    blocks = F.ceil(F.col("held") / BLOCK_ROWS).cast("int")
    own = lambda h: F.pmod(F.xxhash64(h), F.col("blocks")).cast("int")
    placed = rows.select("key", "h", blocks.alias("blocks")).withColumn("block", own("h"))
    leaders = placed.where("blocks > 1").join(classes.select("h", "commonness"), "h").groupBy("key", "blocks").agg(F.max(F.struct("commonness", "h"))["h"].alias("h"))
    guests = leaders.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("block") != own("h"))
    every = placed.select("key", "block", "h").unionByName(guests.select("key", "block", "h"))
    each = PAIRS_EACH

    def pairs(piece: tuple, rows: list[tuple]) -> Iterator[tuple]:
        sizes, names, bits = zip(*rows, strict=True)
        if len(rows) == 2:
            near = int(sizes[1]) * num <= int(sizes[0]) * den and parity_distance(*bits) * (den + num) <= sum(sizes) * (den - num)
            found, rest = [(0, 1)] if near else [], False
        else:
            found, rest = near_pairs(Block(np.asarray(sizes), list(bits), np.zeros(len(rows), np.int64), num, den), np.arange(len(rows)), each * len(rows))
        for a, b in found:
            yield min(names[a], names[b]), max(names[a], names[b]), None
        if rest:
            yield None, None, piece[0]

    split = every.join(classes.select("h", "n", "bits"), "h").select("key", "block", "h", "n", "bits")
    return cut(_by_piece(split, ["key", "block"], ["n", "h", "bits"], pairs, "a bigint, b bigint, open bigint"), "jaccard-first")


def _named(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: the classes behind distinct pairs of their 64 bits; all of them, should several share those."""
    names = classes.select("h", "cls")
    ends = pairs.select("a", "b").distinct().join(names.select(F.col("h").alias("a"), F.col("cls").alias("x")), "a").join(names.select(F.col("h").alias("b"), F.col("cls").alias("y")), "b")
    return ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _in_blocks(members: DataFrame, weight: str, most: int) -> DataFrame:
    """``members(hub, cls, root, <weight>)`` dealt into pieces ``hub, lo, hi`` of blocks whose weights sum to ``most`` or so, with their ``own`` block.

    Any two members of a hub meet in a piece, but for pairs within the hub's own component.
    """
    own = F.when(F.col("root") == F.col("hub"), F.col(weight)).otherwise(0)
    parts = members.groupBy("hub").agg(F.sum(own).alias("major"), F.sum(F.col(weight) - own).alias("minor"))
    blocks = lambda n: F.ceil(F.col(n) / most).cast("int")
    split = members.join(parts.where("minor > 0").select("hub", blocks("major").alias("majors"), blocks("minor").alias("minors")), "hub")
    among = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    minor = F.col("root") != F.col("hub")
    split = split.withColumn("own", F.when(minor, among("minors")).otherwise(F.col("minors") + among("majors")).cast("bigint"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(minor, F.col("minors") + F.col("majors")).otherwise(F.col("minors")).cast("bigint") - 1)))
    return split.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))


def _labels(roots: tuple) -> np.ndarray:
    number = {root: k for k, root in enumerate(dict.fromkeys(roots))}
    return np.asarray([number[root] for root in roots])


def _apart(members: DataFrame, roots: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """``hub, cls, root``: classes under keys of ``members(key, cls)`` that are near one in another component of ``roots(cls, root)``.

    A key's hub is its largest component.
    """
    placed = cut(members.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "jaccard-placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("c", "root")).alias("top")).where("roots > 1")
    hubs = placed.join(parts.select("key", F.col("top.root").alias("hub")), "key").select("hub", "cls", "root").distinct()
    hubs = cut(hubs.join(classes.select("cls", "n", "bits"), "cls").withColumn("one", F.lit(1)), "jaccard-hubs")

    def near(piece: tuple, rows: list[tuple]) -> Iterator[tuple]:
        sizes, names, bits, roots, sides = zip(*rows, strict=True)
        label = _labels(roots)
        if label.any():
            for k in np.flatnonzero(marked(Block(np.asarray(sizes), list(bits), np.asarray(sides), num, den), label)).tolist():
                yield piece[0], names[k], roots[k]

    split = _in_blocks(hubs, "one", BLOCK_ROWS).select("hub", "lo", "hi", "n", "cls", "bits", "root", "own")
    found = cut(_by_piece(split, ["hub", "lo", "hi"], ["n", "cls", "bits", "root", "own"], near, "hub binary, cls binary, root binary").distinct(), "jaccard-apart")
    remove(placed, hubs)
    return found


def _bridges(apart: DataFrame, classes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: links that join all components of ``apart(hub, cls, root)`` that a link joins; the classes' sets are in ``sets(c, items)``."""

    def links(piece: tuple, rows: list[tuple]) -> Iterator[tuple]:
        sizes, names, bits, roots, sides, items = zip(*rows, strict=True)
        label = _labels(roots)
        if label.any():
            for a, b in linked_forest(Block(np.asarray(sizes), list(bits), np.asarray(sides), num, den), label, list(items)):
                yield min(names[a], names[b]), max(names[a], names[b])

    split = _in_blocks(apart.join(classes.select("cls", "n", "bits"), "cls"), "n", BLOCK_GRAMS).join(sets.withColumnRenamed("c", "cls"), "cls")
    split = split.select("hub", "lo", "hi", "n", "cls", "bits", "root", "own", "items")
    return cut(_by_piece(split, ["hub", "lo", "hi"], ["n", "cls", "bits", "root", "own", "items"], links, "a binary, b binary").distinct(), "jaccard-bridges", slim=True)


def _contents(docs: DataFrame, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """``c, items``: the sets of the classes in ``wanted(c)``, a written table."""

    shared = docs.sparkSession.sparkContext.broadcast(_sketch.bloom(wanted, lambda names: _hash64(names.to_pylist())))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            found: dict[bytes, np.ndarray] = {}
            for shingles in shingle_sets(batch.column(0), width):
                cls = class_of(shingles)
                if cls is not None and cls not in seen and _sketch.may_hold(bits, _hash64([cls]))[0]:
                    seen.add(cls)
                    found[cls] = _text.signed(shingles)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), _text.list_array(list(found.values()), pa.int64())], ["c", "items"])

    sets = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(contents, "c binary, items array<bigint>")
    return cut(sets.join(wanted, "c", "left_semi").dropDuplicates(["c"]), "jaccard-contents")


def _verified(near: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``near(a, b)``, pairs of classes, that link."""
    shared = F.size(F.array_intersect("ia", "ib"))
    both = near.join(sets.select(F.col("c").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("c").alias("b"), F.col("items").alias("ib")), "b")
    return cut(both.where(shared * den >= (F.size("ia") + F.size("ib") - shared) * num).select("a", "b"), "jaccard-links")


def _components(links: DataFrame) -> DataFrame:
    return cut(components(links, "jaccard-roots").withColumnRenamed("node", "cls"), "jaccard-components", slim=True)


def linked(sets: list[np.ndarray], sides: np.ndarray, num: int, den: int) -> np.ndarray:
    """With how many of the others each of ``sets``, all different, links.

    ``sides`` tells the block of each; pairs of unequal blocks count, or all if
    there is one block.
    """
    sizes = np.asarray([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, sides = sizes[order], sides[order]
    _, items = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    ends = np.searchsorted(sizes, sizes * den // num, side="right")
    two = bool((sides != sides[0]).any())
    own, out = np.zeros(int(items.max()) + 1, bool), np.zeros(len(sets), np.int64)
    for a in range(len(sets)):
        end = int(ends[a])
        if end <= a + 1:
            continue
        held = items[starts[a] : starts[a] + sizes[a]]
        own[held] = True
        first, last = int(starts[a + 1]), int(starts[end - 1] + sizes[end - 1])
        shared = np.add.reduceat(own[items[first:last]], starts[a + 1 : end] - first, dtype=np.int64)
        own[held] = False
        link = shared * den >= (sizes[a + 1 : end] + sizes[a] - shared) * num
        if two:
            link &= sides[a + 1 : end] != sides[a]
        out[order[a + 1 : end]] += link
        out[order[a]] += int(link.sum())
    return out


def _link_counts(roots: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``cls, n_links`` of the classes in ``roots(cls, root)`` that link, whose n-grams are in ``sets(c, items)``."""
    sizes = sets.select(F.col("c").alias("cls"), F.size("items").alias("n"))
    parts = roots.join(sizes, "cls").groupBy("root").agg(F.count("*").alias("held"), F.sum("n").alias("grams"))
    placed = cut(roots.join(parts, "root").where("held > 1").select("cls", "root", "held", F.ceil(F.col("grams") / BLOCK_GRAMS).cast("int").alias("blocks")), "jaccard-members", slim=True)
    of_two = placed.where("held = 2").select("cls", F.lit(1).cast("bigint").alias("n_links"))
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    split = placed.where("held > 2").withColumn("own", own).join(sets.withColumnRenamed("c", "cls"), "cls")
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cls", "items")

    def counted(piece: tuple, rows: list[tuple]) -> Iterator[tuple]:
        names, sides, items = zip(*rows, strict=True)
        if piece[1] == piece[2] or len(set(sides)) == 2:
            found = linked(list(items), np.asarray(sides), num, den)
            for k in np.flatnonzero(found).tolist():
                yield names[k], int(found[k])

    found = _by_piece(split, ["root", "lo", "hi"], ["cls", "own", "items"], counted, "cls binary, n bigint")
    out = cut(of_two.unionByName(found.groupBy("cls").agg(F.sum("n").alias("n_links"))), "jaccard-counts")
    remove(placed)
    return out


def ngram_jaccard(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, num: int = 90, den: int = 100, count_links: bool = True,
) -> DataFrame:
    """Near-duplicate groups of ``docs``: ``<id_col>, n_shingles, component_id, n_links``, a row per row of ``docs``.

    ``component_id`` is the smallest id that links reach, ``n_links`` the number
    of other classes (different sets) that a row's class links with; without
    ``count_links`` that column is left out. Ids are of any type that can be
    ordered. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; sets
    hold distinct ``width``-grams, or the whole sequence where there are fewer
    words.

    Null and empty texts and those without a word have no n-gram and link with
    nothing. Rows with a null id take part; they get the smallest id in their
    group, and null where no id is known. Repeated rows stay, each with its
    result. An empty table gives no rows. Columns other than the two named are
    not read, so their names can't clash.
    """
    bound_batches(docs.sparkSession)
    census = _census(docs, id_col, text, width)
    counts = _sketch.gathered(census.where("piece is not null").select("task", "piece", "data"), _sketch.SKETCH_SLOTS, "int64", "sum")
    classes = _classes(docs, text, width, num, den, counts)
    rows = _meetings(classes)
    facts = cut(classes.drop("keys"), "jaccard-facts")
    remove(classes)
    release(docs.sparkSession)
    first = _first_pairs(rows, facts, num, den)
    near = cut(_named(first.where("open is null"), facts), "jaccard-near", slim=True)
    sets = _contents(docs, text, width, near.select(F.col("a").alias("c")).unionByName(near.select(F.col("b").alias("c"))).distinct())
    release(docs.sparkSession)
    links = _verified(near, sets, num, den)
    roots = _components(links)
    left = first.where("open is not null").select(F.col("open").alias("key")).unionByName(rows.where(F.col("held") > BLOCK_ROWS).select("key")).distinct()
    members = cut(rows.join(left, "key").join(facts.select("h", "cls"), "h").select("key", "cls"), "jaccard-open", slim=True)
    remove(rows, first, near)
    apart = _apart(members, roots, facts, num, den)
    missing = cut(apart.select(F.col("cls").alias("c")).distinct().join(sets.select("c"), "c", "left_anti"), "jaccard-missing", slim=True)
    if missing.take(1):
        more = _contents(docs, text, width, missing)
        whole = cut(sets.unionByName(more), "jaccard-contents")
        remove(sets, more)
        sets = whole
    bridges = _bridges(apart, facts, sets, num, den)
    if bridges.take(1):
        whole = cut(links.unionByName(bridges), "jaccard-links", slim=True)
        remove(roots, links)
        links = whole
        roots = _components(links)
    remove(members, facts, apart, missing, bridges)
    release(docs.sparkSession)

    kept = census.where("piece is null")
    found = kept.groupBy("cls").agg(F.min("doc").alias("least")).where("cls is not null").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    best = found.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = found.join(best, "root").select("cls", "component_id")
    out = [F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id")]
    counted = [_link_counts(roots, sets, num, den)] if count_links else []
    if count_links:
        labelled = labelled.join(counted[0], "cls", "left")
        out.append(F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    result = cut(kept.select("doc", "n", "cls").join(labelled, "cls", "left").select(*out), "jaccard-result")
    remove(census, sets, links, roots, *counted)
    return result
