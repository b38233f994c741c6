"""Suffixes: candidates by ending, roots by votes over suffixed forms, and k-fold accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suffix_candidates(words: DataFrame, shortest: int = 2, longest: int = 8, support: int = 20) -> DataFrame:
    """(suffix, words): endings that leave at least two letters, with the number of distinct words that bear them."""
    ends = words.select("k", F.explode(F.sequence(F.lit(shortest), F.lit(longest))).alias("size")).where(F.length("k") >= F.col("size") + 2)
    return ends.groupBy(F.expr("right(k, size)").alias("suffix")).agg(F.count(F.lit(1)).alias("words")).where(F.col("words") >= support)


def root_vote(words: DataFrame, suffixes: DataFrame, evidence: int = 2) -> DataFrame:
    """(root, evidence): words that, with at least so many of the suffixes, make other words. Joins by the stripped form; no pairs of roots and suffixes are made."""
    ends = words.select("k", F.explode(F.sequence(F.lit(2), F.lit(8))).alias("size")).where(F.length("k") >= F.col("size") + 2)
    cut = ends.select(F.expr("left(k, length(k) - size)").alias("root"), F.expr("right(k, size)").alias("suffix")).join(suffixes.select("suffix"), "suffix", "left_semi")
    voted = cut.join(words.select(F.col("k").alias("root")), "root", "left_semi").groupBy("root").agg(F.count(F.lit(1)).alias("evidence"))
    return voted.where(F.col("evidence") >= evidence)


def kfold_spelling(pairs: DataFrame, size: int = 3, folds: int = 5) -> DataFrame:
    """Per fold: how often the commonest capitalisation among other folds' words of the same ending is a word's own.

    (k, w, n) votes; fold = first six hex digits of md5(k) modulo `folds`. Returns fold, words, right.
    """
    top = pairs.groupBy("k").agg(F.max_by("w", F.struct("n", "w")).alias("w")).where(F.length("k") > size)
    rows = top.select("k", (F.col("w") != F.col("k")).cast("long").alias("cap"), F.expr(f"right(k, {size})").alias("e"),
                      (F.conv(F.substring(F.md5("k"), 1, 6), 16, 10).cast("long") % folds).alias("fold"))
    per = rows.groupBy("e", "fold").agg(F.sum("cap").alias("caps"), F.count(F.lit(1)).alias("c"))
    whole = per.groupBy("e").agg(F.sum("caps").alias("all_caps"), F.sum("c").alias("all_c"))
    guess = per.join(whole, "e").select("e", "fold", ((F.col("all_caps") - F.col("caps")) * 2 > F.col("all_c") - F.col("c")).cast("long").alias("guess"))
    return rows.join(guess, ["e", "fold"]).groupBy("fold").agg(F.count(F.lit(1)).alias("words"), F.sum((F.col("guess") == F.col("cap")).cast("long")).alias("right"))
