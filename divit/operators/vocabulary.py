"""Frequencies, votes and ambiguity over (key, spelling) counts. All aggregates combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(toks: DataFrame, *by: str) -> DataFrame:
    return toks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def top_per(df: DataFrame, key: str, tie: str, limit: int) -> DataFrame:
    """The `limit` rows of most n per key; ties go to the smaller `tie`."""
    w = Window.partitionBy(key).orderBy(F.desc("n"), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def majority(pairs: DataFrame, share: float = 0.7, support: int = 3) -> DataFrame:
    """(k, spelling, n, total) of keys whose commonest spelling has the share and support; equal counts go to the greater spelling."""
    voted = pairs.groupBy("k").agg(F.max_by("w", F.struct("n", "w")).alias("spelling"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return voted.where((F.col("n") >= support) & (F.col("n") >= F.col("total") * share))


def ambiguous(pairs: DataFrame, total: int = 6, second: int = 3, share: float = 0.05) -> DataFrame:
    """(k, first, n1, second, n2, total) of keys with a second spelling of enough count and share."""
    by = Window.partitionBy("k")
    order = by.orderBy(F.desc("n"), F.asc("w"))
    ranked = pairs.select("*", F.row_number().over(order).alias("r"), F.sum("n").over(by).alias("total")).where("r <= 2")
    two = ranked.groupBy("k").agg(
        F.max(F.when(F.col("r") == 1, F.col("w"))).alias("first"), F.max(F.when(F.col("r") == 1, F.col("n"))).alias("n1"),
        F.max(F.when(F.col("r") == 2, F.col("w"))).alias("second"), F.max(F.when(F.col("r") == 2, F.col("n"))).alias("n2"),
        F.max("total").alias("total"))
    return two.where((F.col("total") >= total) & (F.col("n2") >= second) & (F.col("n2") >= F.col("total") * share))


def symmetric_difference(left: DataFrame, right: DataFrame, key: str = "k") -> DataFrame:
    """Distinct keys of one side only, with that side."""
    a = left.select(key).distinct().withColumn("_a", F.lit(True))
    b = right.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full")
    return both.where("_a is null or _b is null").select(key, F.when(F.col("_a"), "left").otherwise("right").alias("side"))
