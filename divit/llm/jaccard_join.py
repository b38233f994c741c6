"""N-gram Jaccard join: pivots, Voronoi regions with boundary windows, and recursive exact joins of regions.

The metric is the symmetric difference |x ^ y| of sets of word shingles: documents link (Jaccard >= s) exactly where
|x ^ y| <= H(x, y) = (1 - s) / (1 + s) * (|x| + |y|). It is invariant under re-centring: |x ^ y| = |(x ^ p) ^ (y ^ p)|
for every pivot p, so a region around a pivot can be joined on the differences from it, which are small near it.

*First level, pivot: the empty set.* Seen from there documents are their own sets. By the triangle inequality linked sets
share all but H of their elements, so they meet in `depth` of their |x| - ceil(s|x|) + `depth` rarest shingles (all they share, if
fewer): a document is copied into the cells of these, its window. For a pair of known sizes the windows narrow and sizes bound the distance too.

*Pivots of cells.* In each cell with documents of two classes the smallest one is the pivot; all others are compared with it exactly, and links
contract documents into classes until few are won. Then cells of at most `SMALL` documents are joined pair by pair of classes. In larger ones
a document belongs to the Voronoi region of the cell's pivot or of the empty set, whichever is nearer, and to both where the two distances
differ by at most 2 H: linked documents share a region (triangle inequality).

*Recursion.* In the pivot's region x becomes x ^ p. Linked x, y share all but H/2 elements of the smaller of the two differences, so they
meet in their H + 1 rarest elements, or in the cell of those that differ by less than that. A region of at most `REGION` documents is joined in one
piece from these small differences; larger ones are cut into those cells, which are joined as before, with pivots of their own. Cells of the same pivot are one region, however many there are. In the region of the empty set documents meet a second
time, in the cell of two common shingles. After `LEVELS` levels what still shares a cell is compared pair by pair: that needs texts
which differ by much the same elements at each level without linking.

Each link is an exact comparison of whole sets of 64-bit shingle hashes, and a pair is left out only if both documents are in one class
already or can't link. Sets are told apart by 64-bit digests. Equal sets are one document before any join. Hot groups: a task sends equal sets
once; cells are grouped by partial aggregation, members meet only pivots, and a pivot's members are dealt out in chunks of `CHUNK`.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, forest
from .shared import fresh, quoted, remove, settle, settle_turns_by, small_batches, tidy, trimmed
from .textbytes import mix, shingle_sets, steps

CHUNK, SMALL, LEVELS, SEEN = 256, 64, 3, 100_000
#: Regions of up to so many documents, and bytes of their differences, are joined in one piece; larger ones are cut into cells.
REGION, REGION_BYTES = 2048, 32 << 20
#: About so many ids are broadcast at a time to pick texts, and so many marks of rows that go; more marks are joined by a shuffle of all rows.
WANTED, MARKS = 200_000, 1_000_000
#: What carries sets moves in turns, so that beside the tables only a share lies in shuffle files: windows always, sets from so many documents a turn, comparisons from so many pairs.
WINDOW_TURNS, MOST_TURNS, SETS_TURN, PAIRS_TURN = 4, 8, 50_000, 100_000
#: The order of pivots is a table of counts of all shingles of all documents, folded into 2**ORDER_BITS cells: its size never grows.
ORDER_BITS, SLOTS = 21, 32


def _ceil(percent: int, n: int) -> int:
    return -(-percent * n // 100)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(both) - inter)


def _digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def _signatures(words: int):
    """Per document: size and digest of its set; and per task the counts of shingles."""
    side = 1 << ORDER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(side, np.uint32)
        for batch in batches:
            for part in steps(batch, "text"):
                size, name = [], []
                for s in shingle_sets(part.column("text"), words):
                    np.add.at(counts, (s & np.uint64(side - 1)).astype(np.int64), 1)
                    size.append(len(s)), name.append(_digest(s))
                yield pa.record_batch([part.column("doc"), part.column("key"), pa.array(size, pa.int64()), pa.array(name, pa.int64()), pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary())], names=_SIGNATURE)
        if counts.any():
            blobs = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(SLOTS, -1)]
            null = pa.nulls(SLOTS, pa.int64())
            yield pa.record_batch([null, null, null, null, pa.array(range(SLOTS), pa.int32()), pa.array(blobs, pa.binary())], names=_SIGNATURE)

    return run, "doc long, key long, size long, name long, slot int, counts binary"


_SIGNATURE = ["doc", "key", "size", "name", "slot", "counts"]


def _summed(last: bool):
    """Sums of tables slot by slot; the last ones as logarithms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for slot, group, blob in zip(*(batch.column(c).to_pylist() for c in ("slot", "grp", "counts"))):
                x = zlib.decompress(blob)
                x = np.frombuffer(x, np.uint32).astype(np.uint64) if len(x) == 4 * (1 << ORDER_BITS) // SLOTS else np.frombuffer(x, np.uint64)
                sums[slot, group] = sums[slot, group] + x if (slot, group) in sums else x
        for (slot, _), x in sums.items():
            if last:
                x = np.minimum(255, np.round(4 * np.log2(1 + x.astype(np.float64)))).astype(np.uint8)
            yield pa.record_batch([pa.array([slot], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], names=["slot", "counts"])

    return run


def _order(tables: DataFrame) -> np.ndarray:
    """The logarithm of each cell's count in eighths: one byte a cell, summed in two levels on the executors."""
    part = tables.withColumn("grp", F.monotonically_increasing_id() % 16).repartition(SLOTS * 4, "slot", "grp").mapInArrow(trimmed(_summed(False)), "slot int, counts binary")
    log = part.withColumn("grp", F.lit(0).cast("long")).repartition(SLOTS, "slot").mapInArrow(trimmed(_summed(True)), "slot int, counts binary")
    out = np.zeros((SLOTS, (1 << ORDER_BITS) // SLOTS), np.uint8)
    for row in log.collect():  # SLOTS rows of bounded size
        out[row.slot] = np.frombuffer(zlib.decompress(row.counts), np.uint8)
    return out.reshape(-1)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of a sorted partition, group by group."""

    def rows():
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                yield from batch.slice(at, 16).to_pylist()

    return itertools.groupby(rows(), key=lambda r: tuple(r[k] for k in keys))


def _ranked(s: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A set by the order of pivots: rarest first, ties by hash."""
    return s[np.argsort(weight[(s & np.uint64(len(weight) - 1)).astype(np.int64)], kind="stable")]


def _recentred(apart: np.ndarray, pivot: np.ndarray, usual: float, weight: np.ndarray) -> np.ndarray:
    """A difference from a pivot by how many of its region are likely to share each element, fewest first, ties by hash.

    An element outside the pivot is about as frequent there as anywhere; one of the pivot is missing in all that haven't got it, when
    `usual` is the count of most elements of the pivot.
    """
    count = np.exp2(weight[(apart & np.uint64(len(weight) - 1)).astype(np.int64)] / 4.0) - 1
    own = pivot[np.minimum(np.searchsorted(pivot, apart), len(pivot) - 1)] == apart
    return apart[np.lexsort((apart, np.where(own, np.maximum(1.0, usual - count), count)))]


def _windows(words: int, percent: int, depth: int, order):
    """Copies of each document's set for the cells in its window; a task sends equal sets once (again after `SEEN` others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, seen = order.value, set()
        for batch in batches:
            for part in steps(batch, "text"):
                cells, name, n, at = [], [], [], []
                for s in shingle_sets(part.column("text"), words):
                    if not len(s) or (d := _digest(s)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(d)
                    kept = _ranked(s, weight)[: len(s) - _ceil(percent, len(s)) + depth]
                    cells.append(kept), name.append(np.full(len(kept), d)), n.append(np.full(len(kept), len(s), np.int32)), at.append(np.arange(len(kept), dtype=np.int32))
                if cells:
                    yield pa.record_batch([pa.array(c) for c in (_signed(np.concatenate(cells)), np.concatenate(name), np.concatenate(n), np.concatenate(at))], names=["cell", "doc", "n", "rank"])

    return run, "cell long, doc long, n int, rank int"


def _whole(words: int):
    """(doc, set): the sorted hashes of each document's set as bytes; a task sends those of repeated rows once (again after `SEEN` others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            names = batch.column("doc").to_pylist()
            new = [i for i, d in enumerate(names) if d not in seen and not seen.add(d)]
            if len(seen) >= SEEN:
                seen.clear()
            for part in steps(batch.take(pa.array(new, pa.int64())), "text"):
                yield pa.record_batch([part.column("doc"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), words)], pa.binary())], names=["doc", "set"])

    return run, "doc long, set binary"


def _compared(percent: int, order):
    """Exact comparison of a document with its candidates; its own row comes first in each group.

    Of the members of a `star`, also each one's part in the region of the document and in that of the empty set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = order.value
        for (a, _), rows in _groups(batches, ("a", "chunk")):
            own, usual, out, held = None, 0.0, [], 0
            for r in rows:
                s = np.frombuffer(r["set"], np.uint64)
                if r["b"] is None:
                    own = s
                    if r["star"]:
                        usual = np.median(np.exp2(weight[(own & np.uint64(len(weight) - 1)).astype(np.int64)] / 4.0))
                    continue
                linked = _linked(own, s, percent)
                if not r["star"]:
                    if linked:
                        out.append((a, r["b"], True, len(s), False, None, None))
                    continue
                radius = (100 - percent) * (len(s) + 100 * len(s) // percent) // (100 + percent)
                apart = np.setxor1d(own, s, assume_unique=True)
                cells = raw = None
                if len(apart) <= len(s) + 2 * radius:
                    cells = _recentred(apart, own, usual, weight)[: radius + 1]
                    if len(apart) <= radius:
                        cells = np.append(cells, np.uint64(0))
                    raw = apart.tobytes()
                    cells = _signed(mix(cells ^ mix(np.array([a]).astype(np.uint64)))).tolist()
                out.append((a, r["b"], linked, len(s), len(apart) >= len(s) - 2 * radius, cells, raw))
                held += len(raw or b"")
                if len(out) >= 256 or held >= 1 << 22:
                    held = 0
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _COMPARED)], names=_COMPARED_NAMES)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _COMPARED)], names=_COMPARED_NAMES)

    return run, "a long, b long, linked boolean, n int, far boolean, cells array<long>, apart binary"


_COMPARED = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.binary())
_COMPARED_NAMES = ["a", "b", "linked", "n", "far", "cells", "apart"]


def _region(percent: int):
    """Links within each region of a pivot: |x ^ y| of all its members at once, from their differences from the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, ("a",)):
            rows = list(rows)
            ids, cls, n = (np.array([r[c] for r in rows], np.int64) for c in ("doc", "cls", "n"))
            apart = [np.frombuffer(r["apart"], np.uint64) for r in rows]
            del rows
            size = np.array([len(d) for d in apart], np.float32)
            _, place, times = np.unique(np.concatenate(apart), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(ids)), size.astype(np.int64))
            del apart
            met = times[place] > 1
            row, place = row[met], (np.cumsum(times > 1) - 1)[place[met]]
            order = np.argsort(place, kind="stable")
            row, place = row[order], place[order]
            both = np.zeros((len(ids), len(ids)), np.float32)
            width = max(1, (1 << 20) // len(ids))
            for at in range(0, int(place[-1]) + 1 if len(place) else 0, width):
                here = slice(*np.searchsorted(place, [at, at + width]))
                x = np.zeros((len(ids), width), np.float32)
                x[row[here], place[here] - at] = 1
                both += x @ x.T
            root = np.arange(len(ids))
            for at in range(0, len(ids), 256):
                some = slice(at, at + 256)
                i, j = np.nonzero((100 + percent) * (size[some, None] + size - 2 * both[some]) <= (100 - percent) * (n[some, None] + n))
                i += at
                new = (i < j) & (cls[i] != cls[j])
                root = forest(len(ids), np.append(i[new], np.arange(len(ids))), np.append(j[new], root))
            moved = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.record_batch([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"])

    return run


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _turns(n: int, size: int) -> int:
    return max(1, min(MOST_TURNS, -(-n // size)))


def _class(column: str, turns: int):
    """The turn of a row."""
    return F.pmod(F.xxhash64(F.lit("turn"), F.col(column)), F.lit(turns))  # another hash than those that deal rows out


def _compared_in_turns(pairs: DataFrame, sets: list[DataFrame], percent: int, order, label: str) -> DataFrame:
    """_compare() of a written table of pairs, written: documents `a` class by class, as every pair moves a whole set."""
    turns, out = _turns(pairs.count(), PAIRS_TURN), None
    for turn in range(turns):
        part = settle(_compare(pairs.where(_class("a", turns) == turn), sets, percent, order), label)
        out = part if out is None else out.unionByName(part)
    return out


def _compare(pairs: DataFrame, sets: list[DataFrame], percent: int, order) -> DataFrame:
    """Those of pairs(a, b, star) that link, and all of a star with b's regions. A document with many partners is dealt out in chunks."""
    many = pairs.groupBy("a").count().where(f"count > {CHUNK}")
    pairs = pairs.join(many, "a", "left").select("a", "b", "star", F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("count", F.lit(1)) / CHUNK)).alias("chunk"))
    firsts = pairs.groupBy("a", "chunk").agg(F.max("star").alias("star"))
    theirs = [pairs.join(s.withColumnRenamed("doc", "b"), "b").select("a", "chunk", "b", "star", "set") for s in sets]
    own = [firsts.join(s.withColumnRenamed("doc", "a"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "star", "set") for s in sets]
    both = functools.reduce(DataFrame.unionByName, own + theirs).repartition(_parts(pairs.sparkSession), "a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    run, schema = _compared(percent, order)
    return both.mapInArrow(trimmed(run), schema)


class _Sets:
    """The sets of the documents that meet in pairs, hashed from their texts when they first do and kept dealt out by document."""

    def __init__(self, rows: DataFrame, texts: DataFrame, words: int) -> None:
        self.rows, self.texts, self.words, self.known = rows, texts, words, []

    def of(self, pairs: DataFrame) -> list[DataFrame]:
        """Tables (doc, set), each document in one, with all documents in pairs(a, b) and perhaps others."""
        ids = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
        for table in self.known:
            ids = ids.join(table.select("doc"), "doc", "left_anti")
        wanted = settle(self.rows.join(ids.withColumnRenamed("doc", "name"), "name", "left_semi").groupBy("name").agg(F.min("key").alias("key")), "wanted")
        if n := wanted.count():
            run, schema = _whole(self.words)
            turns, parts = max(_turns(n, SETS_TURN), -(-n // WANTED)), _parts(pairs.sparkSession)  # ids are always broadcast, so no text is shuffled

            def hashed(turn: int) -> DataFrame:
                mine = wanted.where(_class("key", turns) == turn)
                texts = self.texts.where(_class("key", turns) == turn).join(F.broadcast(mine), "key").select(F.col("name").alias("doc"), "text")
                return texts.mapInArrow(trimmed(run), schema).repartition(parts, "doc").dropDuplicates(["doc"])

            self.known.append(settle_turns_by((hashed(turn) for turn in range(turns)), "sets", "doc", parts))
        remove(wanted)
        return self.known or [ids.select("doc", F.lit(None).cast("binary").alias("set"))]


def _named(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows(doc, ...) with their class."""
    return rows.join(classes.select(F.col("node").alias("doc"), F.col("root").alias("cls")), "doc", "left").withColumn("cls", F.coalesce("cls", "doc"))


def _edges(classes: DataFrame) -> DataFrame:
    """The links that hold classes together."""
    return classes.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _mixed(rows: DataFrame, key: list[str]) -> DataFrame:
    """Those of rows(key, cls, ...) whose key has two classes."""
    return rows.join(rows.groupBy(*key).agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select(*key), key, "left_semi")


def _likely(pairs: DataFrame, percent: int, depth: int) -> DataFrame:
    """Pairs (a, b, na, nb, ra, rb) that meet often enough (`depth`) inside the windows that their two sizes leave."""
    overlap = f"(({percent} * (na + nb) + {99 + percent}) div {100 + percent})"  # what two linked sets of these sizes share at least
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    if depth > 1:
        fits += f" and ra < na - {overlap} + {depth} and rb < nb - {overlap} + {depth}"
    met = pairs.where(fits).groupBy("a", "b").agg(F.count("*").alias("c"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    return met.where(f"c >= least({depth}, {overlap})").select("a", "b")


def _pairs_in(named: DataFrame, last: bool) -> DataFrame:
    """Pairs of members of different classes in the same cell. Cells are small ones, but for the last level."""
    if last:
        x, y = named.alias("x"), named.alias("y")
        both = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.cls") != F.col("y.cls")))
        return both.select(*(F.col(f"{t}.{c}").alias(n + u) for c, n in (("doc", ""), ("n", "n"), ("rank", "r")) for t, u in (("x", "a"), ("y", "b"))))
    cells = named.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("doc", "cls", "n", "rank"))).alias("m"))
    first = cells.select(F.posexplode("m").alias("at", "x"), "m").where("at + 1 < size(m)")
    both = first.select("x", F.explode(F.expr("filter(slice(m, at + 2, size(m)), y -> y.cls <> x.cls)")).alias("y"))
    return both.select(*(F.col(f"{t}.{c}").alias(n + u) for c, n in (("doc", ""), ("n", "n"), ("rank", "r")) for t, u in (("x", "a"), ("y", "b"))))


def _classes(source: DataFrame, words: int, percent: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """source(doc, key, text) -> a row (doc, key, size, name of its set) for each of its rows, and (name, root) of the sets with links.

    `key` is a hash of whatever tells the texts of rows apart. Shuffle files go as each write ends, and tables when nothing reads them any more.
    """
    with tidy(source.sparkSession):
        return _joined(source, words, percent, depth)


def _joined(source: DataFrame, words: int, percent: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """_classes(), within tidy()."""
    spark = source.sparkSession
    small_batches(spark)
    run, schema = _signatures(words)
    first = settle(source.mapInArrow(trimmed(run), schema), "signatures")
    rows = first.where("slot is null").select("doc", "key", "size", "name")
    order = spark.sparkContext.broadcast(_order(first.where("slot is not null").select("slot", "counts")))
    texts = source.where("text is not null").select("key", "text")

    run, schema = _windows(words, percent, depth, order)
    n = _parts(spark)
    # Dealt out once for the grouping and the join. Equal texts share a turn.
    copies = settle_turns_by((texts.where(_class("text", WINDOW_TURNS) == turn).mapInArrow(trimmed(run), schema).repartition(n, "cell") for turn in range(WINDOW_TURNS)), "windows", "cell", n)
    met = copies.groupBy("cell").agg(F.min("doc").alias("pivot"), F.max("doc").alias("high"), F.count("*").alias("members")).where("pivot < high").drop("high")
    open_ = settle(copies.join(met.hint("merge"), "cell").groupBy("cell", "doc", "n", "rank").agg(F.min("pivot").alias("pivot"), F.min("members").alias("members")), "open")
    remove(copies)
    sets = _Sets(rows, texts, words)

    # Around pivots first: links contract documents into classes.
    met = open_.where("doc <> pivot").groupBy(F.col("pivot").alias("a"), F.col("doc").alias("b")).agg(F.count("*").alias("c"))
    met = settle(met.where(f"c >= {depth}").select("a", "b", F.lit(False).alias("star")), "star")
    found = _compared_in_turns(met, sets.of(met), percent, order, "links")
    classes = components(found.select("a", "b"))
    remove(met), remove(found)

    # Then small cells pair by pair, and large ones by regions and again.
    level, rest = 0, []
    while not open_.isEmpty():
        last = level == LEVELS
        named = settle(_mixed(_named(open_, classes), ["cell"]), "named")
        rest = [named]
        small = _likely(_pairs_in(named if last else named.where(f"members <= {SMALL}"), last), percent, depth if level == 0 else 1)
        big = named.where(f"members > {SMALL}").where(F.lit(not last))
        met = big.where("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
        met = settle(small.withColumn("star", F.lit(False)).unionByName(met.withColumn("star", F.lit(True))), "pairs")
        if met.isEmpty():
            remove(met)
            break
        parts = _compared_in_turns(met, sets.of(met), percent, order, "regions")
        remove(met)
        rest = [named, parts]
        found = parts.where("linked").select("a", "b")
        if not found.isEmpty():
            classes = components(_edges(classes).unionByName(found))
        if last or big.isEmpty():
            break
        # Only regions and cells that still hold two classes go on.
        near = _mixed(_named(parts.where("cells is not null").withColumnRenamed("b", "doc"), classes), ["a"])
        held = near.groupBy("a").agg(((F.count("*") <= REGION) & (F.sum(F.length("apart")) <= REGION_BYTES)).alias("fits"))
        near = settle(near.join(held, "a"), "near")
        inside = near.where("fits").select("a", "doc", "cls", "n", "apart").repartition(n, "a").sortWithinPartitions("a", "doc").mapInArrow(trimmed(_region(percent)), "a long, b long")
        if not (inside := settle(inside, "inside")).isEmpty():
            classes = components(_edges(classes).unionByName(inside))
        near_cells = near.where("not fits").select(F.explode("cells").alias("cell"), "doc", "n", F.lit(0).alias("rank"))
        far = _mixed(_named(parts.where("far").withColumnRenamed("b", "doc"), classes), ["a"]).select(F.col("a").alias("pivot"), "doc")
        far = big.join(far, ["pivot", "doc"], "left_semi").select("cell", "doc", "n")
        if level == 0:
            twice = F.col("n") * percent > 100 * depth
            other = open_.select(F.col("doc").alias("o_doc"), F.col("cell").alias("o_cell"))
            both = far.where(twice).join(other, (F.col("doc") == F.col("o_doc")) & (F.col("cell") != F.col("o_cell")))
            both = both.select(F.xxhash64(F.least("cell", "o_cell"), F.greatest("cell", "o_cell")).alias("cell"), "doc", "n").distinct()
            far = both.unionByName(far.where(~twice))
        rest += [near, inside, open_]
        named = settle(_named(near_cells.unionByName(far.withColumn("rank", F.lit(0))), classes), "copies")
        met = named.groupBy("cell").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.min("doc").alias("pivot"), F.count("*").alias("members")).where("low < high")
        open_ = settle(named.drop("cls").join(met.drop("low", "high"), "cell"), "open")
        for table in [*rest, named]:
            remove(table)
        rest = []
        level += 1

    for table in [open_, *sets.known, *rest]:
        remove(table)
    return rows, classes.select(F.col("node").alias("name"), "root")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, depth: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of each document under links of Jaccard similarity >= percent / 100 between sets of `words`-word shingles.

    Returns one row per input row: `id_col`, n_shingles (size of its set), component_id (the smallest
    id that links reach). Texts without words and null texts link with nothing. Fewer than `words` words: the whole sequence is one
    shingle. Rows that repeat an id are one document with several texts. A row without an id links like any other, but gets a null component_id
    and never gives one. Ties don't matter: classes are a function of the links. An empty table gives an empty result; extra columns are not read.
    """
    text = F.col(quoted(text_col)).cast("string")
    rows, roots = _classes(docs.select(F.col(quoted(id_col)).cast("long").alias("doc"), F.xxhash64(F.col(quoted(id_col)), text).alias("key"), text.alias("text")), words, percent, depth)
    full = rows.where("doc is not null and size > 0")
    several = full.groupBy("doc").agg(F.min("name").alias("a"), F.max("name").alias("z")).where("a <> z").select("doc", "a")
    own = full.join(several, "doc").where("name <> a").select("a", F.col("name").alias("b"))
    if not own.isEmpty():
        both = own.unionByName(roots.select(F.col("root").alias("a"), F.col("name").alias("b")))
        roots = components(both).select(F.col("node").alias("name"), "root")
    named = rows.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    least = named.where("doc is not null and size > 0").groupBy("root").agg(F.min("doc").alias("least"))
    out = named.join(least, "root", "left")
    return out.select(F.col("doc").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("doc").isNull(), None).when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc")).cast("long").alias("component_id"))


def near_duplicates_removed(docs: DataFrame, words: int = 5, percent: int = 80, depth: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one row of each class: the one with the smallest id (nulls last; of these the smallest hash of its columns); all columns stay.

    Classes are of rows, by their texts: of rows that repeat an id each is judged for itself, rows with a null id as well, and of rows equal
    in all columns one stays. Rows without words (null, empty, white space alone) are in no class and all stay. An empty table gives no
    rows. Columns of any name and type but maps are carried along.
    """
    key, one, at = (fresh(docs, n) for n in ("key", "one", "at"))
    columns = [F.col(quoted(c)) for c in docs.columns]
    keyed = docs.withColumn(key, F.xxhash64(*columns))
    rows, roots = _classes(keyed.select(F.col(quoted(id_col)).cast("long").alias("doc"), F.col(key).alias("key"), F.col(quoted(text_col)).cast("string").alias("text")), words, percent, depth)
    rows = rows.where("size > 0")
    named = rows.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    with tidy(docs.sparkSession):
        named = settle(named.groupBy("root", "key").agg(F.min("doc").alias("doc"), F.count("*").alias("times")), "rows")
    first = named.groupBy("root").agg(F.min("doc").alias("least"))
    firsts = named.join(first, "root").where("doc <=> least").groupBy("root").agg(F.min("key").alias("kept"))
    marked = named.join(firsts, "root").where("key <> kept or times > 1")
    # Few rows beside the texts: those that go, and those of which one of several equal ones stays.
    with tidy(docs.sparkSession):
        marked = settle(marked.select(F.col("key").alias(at), (F.col("key") == F.col("kept")).alias(one)).distinct(), "marked")
    remove(named)
    marks = F.broadcast(marked) if marked.count() <= MARKS else marked
    met = keyed.join(marks, F.col(key) == F.col(at), "left")
    alone = met.where(F.col(at).isNull()).select(*columns)
    again = met.where(F.col(one)).dropDuplicates([key]).select(*columns)
    return alone.unionByName(again)
