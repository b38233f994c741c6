"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within the squared distance t = 2 - 2c. A fixed random rotation spreads that distance evenly
over the coordinates; cut into blocks of `WIDTH` of them, some block must lie within its proportional share of t. Each block is
range-joined for itself: its leading coordinates give a grid with cells of twice the block's radius, each vector owns the cell it lies in
and is copied into the neighbouring cells that its radius touches. A pair is looked at where the smaller row of the two owns
the cell; those within the block's share are verified by the cosine of the original vectors in double precision. Of several blocks that
find a pair the first one counts it, so link counts add up without any list of pairs leaving a task.
Cells of more than `CELL` vectors are dealt out: their owners in parts, each met by all vectors of the cell.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, forest
from .shared import settle, small_batches

WIDTH, CELL, TILE = 8, 8192, 1024


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _cuts(dim: int) -> list[tuple[int, int]]:
    return [(a, min(dim, a + WIDTH)) for a in range(0, dim, WIDTH)]


def _usable(values, dims=None) -> np.ndarray | None:
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    return x if np.isfinite(x).all() and np.isfinite(n := float(x @ x)) and n > 0 else None


def _packed(x: np.ndarray) -> bytes:
    """A vector's bytes, as 32-bit floats where these hold it exactly: it is copied into many cells."""
    short = x.astype(np.float32) if np.abs(x).max() < 3e38 else x
    return short.tobytes() if (short == x).all() else x.tobytes()


def _unpacked(raw: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64).astype(np.float64) for r in raw])


def _copies(t: float, grid: int):
    """One row per block for the cell that a vector owns and one for each neighbouring cell that its radius touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out: list[tuple] = []
                part = batch.slice(at, 512)
                for uid, label, values in zip(*(part.column(c).to_pylist() for c in ("uid", "label", "vec"))):
                    x = _usable(values)
                    if x is None:
                        continue
                    d = len(x)
                    y = (x / np.linalg.norm(x)) @ turn.setdefault(d, rotation(d))
                    raw = _packed(x)
                    for b, (lo, hi) in enumerate(_cuts(d)):
                        radius = math.sqrt(t * (hi - lo) / d) + 1e-9
                        lead = y[lo : min(hi, lo + grid)]
                        own = np.floor(lead / (2 * radius)).astype(int)
                        sides = [sorted({int(np.floor((v - radius) / (2 * radius))), int(np.floor((v + radius) / (2 * radius)))}) for v in lead]
                        for cell in itertools.product(*sides):
                            out.append((label, d, b, ",".join(map(str, cell)), uid, cell == tuple(own.tolist()), raw))
                if out:
                    cols = list(zip(*out))
                    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
                    yield pa.record_batch([pa.array(c, ty) for c, ty in zip(cols, types)], names=["label", "dim", "block", "cell", "uid", "own", "raw"])

    return run


def _joined(cosine: float, t: float):
    """Links of one (label, block, cell, part): how many each vector has, and a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "block", "cell", "part", "uid", "mine", "raw")))

        for (_, dim, block, *_), group in itertools.groupby(rows(), key=lambda r: r[:5]):
            group = list(group)
            ids = np.array([r[5] for r in group])
            mine = np.array([r[6] for r in group])
            x = _unpacked([r[7] for r in group], dim)
            del group
            x = x / np.sqrt((x * x).sum(1))[:, None]
            y = x @ rotation(dim)
            cuts = _cuts(dim)
            share = [t * (hi - lo) / dim + 1e-9 for lo, hi in cuts]
            lo, hi = cuts[block]
            z = y[:, lo:hi]
            sq = (z * z).sum(1)
            links = np.zeros(len(ids), np.int64)
            root = np.arange(len(ids))
            owners = np.flatnonzero(mine)
            for at, to in itertools.product(range(0, len(owners), TILE), range(0, len(ids), 4 * TILE)):
                o = owners[at : at + TILE]
                m = slice(to, to + 4 * TILE)
                near = sq[o][:, None] + sq[m][None, :] - 2 * (z[o] @ z[m].T) <= share[block]
                i, j = np.nonzero(near)
                i, j = o[i], j + to
                later = ids[j] > ids[i]
                i, j = i[later], j[later]
                hit = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + 65536]], x[j[s : s + 65536]]) >= cosine for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
                i, j = i[hit], j[hit]
                for e in range(block):  # an earlier block has counted the pair
                    a, b = cuts[e]
                    first = np.concatenate([((y[i[s : s + 65536], a:b] - y[j[s : s + 65536], a:b]) ** 2).sum(1) <= share[e] for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
                    i, j = i[~first], j[~first]
                if len(i):
                    links += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                    root = forest(len(ids), np.concatenate([i, np.arange(len(ids))]), np.concatenate([j, root]))
            k = np.flatnonzero(links)
            if len(k):
                yield pa.record_batch([pa.array(ids[k]), pa.array(ids[root[k]]), pa.array(links[k])], names=["a", "b", "n"])

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of equal labels whose cosine is at least `cosine`.

    Returns one row per input row: `id_col`, n_links (other rows linked directly), component_id (the smallest id that links reach,
    its own included) and kept (id = component_id). Vectors that are null, empty, zero or hold null or non-finite components, those with a null
    label and those of different lengths link with nothing. Rows that repeat an id are vectors of their own; a null id is never a
    component_id unless its component has no other. An empty table gives no rows; extra columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = 2 - 2 * cosine
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = settle(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    largest = rows.where("label is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 1
    grid = min(WIDTH, max(2, math.ceil(math.log(max(1.0, largest / 4096), 2.5))))  # cells stay about as full at every size
    copies = rows.where("label is not null and vec is not null").select("uid", "label", "vec")
    cells = copies.mapInArrow(_copies(t, grid), "label long, dim int, block int, cell string, uid long, own boolean, raw binary")
    key = ["label", "dim", "block", "cell"]
    cells = settle(cells, "cells", "snappy")  # the copies of a vector lie side by side
    hot = cells.groupBy(*key).agg(F.ceil(F.count("*") / CELL).alias("parts")).where("parts > 1")  # one in CELL of the copies at most
    dealt = cells.join(F.broadcast(hot), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.withColumn("mine", F.col("own") & (F.pmod(F.xxhash64("uid"), F.col("parts")) == F.col("part")))
    dealt = dealt.repartition(n_parts, *key, "part").sortWithinPartitions(*key, "part", "uid")
    found = settle(dealt.select(*key, "part", "uid", "mine", "raw").mapInArrow(_joined(cosine, t), "a long, b long, n long"), "links")
    counts = found.groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n_links"))
    of = components(found.select("a", "b")).withColumnRenamed("node", "uid")
    named = rows.select("uid", "id").join(of, "uid")
    least = named.groupBy("root").agg(F.min("id").alias("least"))
    placed = named.join(least, "root").select("uid", "least")
    out = rows.select("uid", "id").join(counts, "uid", "left").join(placed, "uid", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
