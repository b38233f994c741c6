"""Connected components as DataFrames: roots hook to smaller roots and paths are halved, with every round on shared storage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Up to so many edges (8 MB) are joined by one task of an executor; more go by rounds of joins, with the same result.
ONE_TASK = 500_000


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        new = new[new]
        if (new == root).all():
            break
        root = new[root]
    return root


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [np.stack([batch.column(c).to_numpy() for c in ("a", "b")]) for batch in batches]
    if edges:
        nodes, place = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
        a, b = place.reshape(2, -1)
        yield pa.record_batch([pa.array(nodes), pa.array(nodes[forest(len(nodes), a, b)])], names=["node", "root"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """edges(a, b long) -> (node, root): the smallest node that each node of an edge reaches.

    Nulls and loops are left out; repeated edges count once. Up to `one_task` edges are joined by one task; of more
    the number of rounds grows with the logarithm of the longest path. No empty edge table gives rows.
    """
    open_ = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "edges")
    if open_.count() <= one_task:
        return settle(open_.coalesce(1).mapInArrow(_at_once, "node long, root long"), "roots")
    open_ = settle(open_.distinct(), "edges")
    roots = None
    while not open_.isEmpty():
        hook = open_.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        deep = True
        while deep:  # halve the paths until every root is the end of one
            for _ in range(2):
                up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
                hook = hook.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            hook = settle(hook, "hook")
            deep = not hook.join(hook.select(F.col("node").alias("root")), "root", "left_semi").isEmpty()
        if roots is None:
            roots = hook.select("node", "root")
        else:
            named = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            old = roots.join(named, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            roots = old.unionByName(hook.join(roots.select("node"), "node", "left_anti"))
        roots = settle(roots, "roots")
        a = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = open_.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        open_ = settle(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if roots is None:
        return open_.select(F.col("a").alias("node"), F.col("b").alias("root"))
    both = roots.unionByName(roots.select(F.col("root").alias("node"), "root"))
    return both.groupBy("node").agg(F.min("root").alias("root"))
