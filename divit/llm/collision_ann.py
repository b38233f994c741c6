"""Approximate nearest neighbours by collision counting.

Inner products become distances by one more coordinate (the largest norm's rest), so that the nearest in the index' space are those of the largest
inner product. `HASHES` single projections give sorted arrays. Around a query's projection a window opens in each of them and widens round by
round (virtual rehashing: nothing is hashed anew); each vector that enters a window collides once. Vectors with at least `THRESHOLD` collisions
are verified by their exact inner product in double precision, and the rounds end when `SHARE` of an index segment and k vectors more
have been verified. Vectors of like norms (`NORMS` classes for each doubling of the square) are indexed together, each class with a largest norm of its own, so that the
added coordinate stays small whatever the norms of a table are. Segments of about `SEGMENT` vectors of a class are indexed side by side, queries come in blocks of `QUERIES`, and each query's
best of all segments are merged. `SHARE` is set by recall: on vectors without any structure the 20 nearest are hardly nearer than
others; tests hold recall against brute force.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import quoted, settle, small_batches
from .subspace_dedup import _usable

HASHES, THRESHOLD, SHARE, STEP, WIDTH = 64, 34, 0.5, 1.15, 0.9
SEGMENT, QUERIES, NORMS = 8192, 1024, 2


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes, with their length and squared norm."""
    for batch in batches:
        kept = [(i, x) for i, v in zip(batch.column("id").to_pylist(), batch.column("vec").to_pylist()) if i is not None and (x := _usable(v)) is not None]
        cols = [[i for i, _ in kept], [len(x) for _, x in kept], [float(x @ x) for _, x in kept], [x.tobytes() for _, x in kept]]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.binary()))], names=["id", "dim", "sq", "raw"])


class CollisionIndex:
    """Sorted projections of one segment."""

    def __init__(self, x: np.ndarray, largest: float) -> None:
        self.x = x
        dim = x.shape[1]
        self.a = np.random.Generator(np.random.PCG64(dim)).standard_normal((dim + 1, HASHES))
        rest = np.sqrt(np.maximum(0.0, largest - (x * x).sum(1)))
        p = (np.column_stack([x, rest]) / np.sqrt(largest)) @ self.a
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(p, self.order.T, 0).T.copy()

    def verified(self, queries: np.ndarray, k: int) -> np.ndarray:
        """For each query which vectors collide often enough, after as many rounds as it takes."""
        n, m = len(self.x), len(queries)
        want = min(n, k + int(SHARE * n))
        p = (queries / np.sqrt((queries * queries).sum(1))[:, None]) @ self.a[:-1]
        collisions = np.zeros((m, n), np.uint8)
        low = np.column_stack([np.searchsorted(s, p[:, j]) for j, s in enumerate(self.sorted)])
        high = low.copy()
        width, open_ = WIDTH, np.arange(m)
        while len(open_):
            a = np.column_stack([np.searchsorted(s, p[open_, j] - width, "left") for j, s in enumerate(self.sorted)])
            b = np.column_stack([np.searchsorted(s, p[open_, j] + width, "right") for j, s in enumerate(self.sorted)])
            a, b = np.minimum(a, low[open_]), np.maximum(b, high[open_])
            for i, q in enumerate(open_):
                count = collisions[q]
                for j in range(HASHES):
                    order, x, y = self.order[j], low[q, j], high[q, j]
                    if x == y:
                        count[order[a[i, j] : b[i, j]]] += 1
                    else:
                        count[order[a[i, j] : x]] += 1
                        count[order[y : b[i, j]]] += 1
            low[open_], high[open_] = a, b
            enough = (collisions[open_] >= THRESHOLD).sum(1) >= want
            open_ = open_[~(enough | ((a == 0) & (b == n)).all(1))]
            width *= STEP
        return collisions >= THRESHOLD


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("dim", "segment", "block", "query", "id", "largest", "raw")))

        for (dim, *_), group in itertools.groupby(rows(), key=lambda r: r[:3]):
            ids, raw, largest, index, asked = [], [], 0.0, None, []
            for *_, query, i, big, bytes_ in group:
                if not query:
                    ids.append(i), raw.append(bytes_)
                    largest = big
                else:
                    asked.append((i, bytes_))
            if not ids or not asked:
                continue
            x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
            ids, index = np.array(ids), CollisionIndex(x, largest)
            out: list[tuple[int, int, float]] = []
            for at in range(0, len(asked), 128):
                some = asked[at : at + 128]
                q = np.frombuffer(b"".join(r for _, r in some), np.float64).reshape(-1, dim)
                for (i, _), v, near in zip(some, q, index.verified(q, k + 1)):
                    hit = np.flatnonzero(near & (ids != i))
                    score = x[hit] @ v
                    if len(hit) > k:
                        least = np.partition(score, len(score) - k)[len(score) - k]
                        hit, score = hit[score >= least], score[score >= least]
                    out += zip([i] * len(hit), ids[hit].tolist(), score.tolist())
            cols = list(zip(*out)) or [[], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows found of the largest inner product with each query, the query's own id excepted.

    `queries` is an SQL condition on the columns of `vectors`. Returns query_id, rank (from 1; ties to the smaller id), vec_id and score.
    Vectors that are null, empty, zero or hold null or non-finite components and rows with a null id take no part; vectors of different
    lengths don't meet. Repeated rows are found each, and a repeated query id is asked once, with the smallest of its vectors. An empty table gives no rows; extra columns are
    not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("vec"))
    plain = "id long, dim int, sq double, raw binary"
    index = settle(rows.mapInArrow(_plain, plain), "index")
    asked = vectors.where(queries).select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("vec")).mapInArrow(_plain, plain)
    asked = settle(asked.groupBy("id", "dim").agg(F.min("raw").alias("raw")), "queries")
    like = F.floor(F.log2("sq") * NORMS + 0.5).cast("int")  # norms about 1 lie in the middle of a class
    index = index.withColumn("like", like)
    classes, at = [], 0
    for r in index.groupBy("dim", "like").agg(F.count("*").alias("n"), F.max("sq").alias("largest")).orderBy("dim", "like").collect():  # a row for each class of norms: a few thousand at most
        parts = -(-r.n // SEGMENT)
        classes.append((r.dim, r.like, at, parts, r.largest))
        at += parts
    segments, blocks = max(1, at), max(1, -(-asked.count() // QUERIES))
    table = F.broadcast(spark.createDataFrame(classes, "dim int, like int, first int, parts int, largest double"))
    deal = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = index.join(table, ["dim", "like"]).select("dim", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("segment"), deal.alias("block"), F.lit(False).alias("query"), "id", "largest", "raw")
    every = F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1))
    right = asked.join(table, "dim").select("dim", every.alias("segment"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("query"), "id", "largest", "raw")
    dealt = left.unionByName(right).repartition(max(n_parts, segments * blocks), "dim", "segment", "block").sortWithinPartitions("dim", "segment", "block", "query", "id")
    found = dealt.mapInArrow(_searched(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
