"""Rules for the ends of spellings, learned from words whose made spelling differs from the right one.

A rule (s, t1, t2) says: if a word ends in s and its made spelling in t1, then t2 stands there. Candidates come from the first difference of two spellings. Counting needs no pairs of rules
and words: each word has one end t2 that would put it right for each (s, t1) it ends in, so an inverted index of ends is grouped, and three counts are joined by (s, t1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a word's end, least and most, and most letters of a made and of a right end.
SHORTEST, LONGEST, MADE, RIGHT = 2, 8, 6, 7


def word_fold(k: Column, folds: int = 5) -> Column:
    """The fold of a word by its checksum."""
    return (F.crc32(F.encode(k, "UTF-8")) % folds).cast("int")


def first_difference(a: Column, b: Column) -> Column:
    """How many letters two strings have in common at their beginning."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda same, i: F.when((same == i - 1) & (i <= n) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(same))


def ends(words: DataFrame, *keep: str) -> DataFrame:
    """keep, k, s, t1, made, right: each end s of a word (two letters at least stay) with each end t1 of its made spelling."""
    cut = words.where(F.length("k") >= SHORTEST + 2).select(*keep, "k", "made", "right", F.explode(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("k") - 2))).alias("n"))
    cut = cut.where("made <> ''").select(*keep, "k", "made", "right", F.expr("right(k, n)").alias("s"), F.explode(F.sequence(F.lit(1), F.least(F.lit(MADE), F.length("made")))).alias("m"))
    return cut.select(*keep, "k", "s", F.expr("right(made, m)").alias("t1"), "made", "right")


def candidates(words: DataFrame, *keep: str) -> DataFrame:
    """keep, s, t1, t2: what turns a wrong spelling into the right one from its first difference on, or from up to two letters before."""
    wrong = words.where("made <> right").withColumn("p", first_difference(F.col("made"), F.col("right"))).withColumn("q", F.explode(F.expr("filter(array(p, p - 1, p - 2), q -> q >= 0)")))
    wrong = wrong.where((F.length("made") - F.col("q") <= MADE) & (F.length("right") - F.col("q") <= RIGHT) & (F.length("made") > F.col("q")))
    cut = wrong.where(F.length("k") >= SHORTEST + 2).withColumn("n", F.explode(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("k") - 2))))
    return cut.select(*keep, F.expr("right(k, n)").alias("s"), F.expr("substring(made, q + 1)").alias("t1"), F.expr("substring(right, q + 1)").alias("t2")).distinct()


def counted(words: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(keep, s, t1, applied, same) and (keep, s, t1, t2, good): how often an end applies, how often the made spelling was right already, and how often t2 puts it right."""
    every = ends(words, *keep)
    per_end = every.groupBy(*keep, "s", "t1").agg(F.count(F.lit(1)).alias("applied"), F.sum((F.col("made") == F.col("right")).cast("long")).alias("same"))
    stem = F.expr("left(made, length(made) - length(t1))")
    right = every.where(F.startswith("right", stem)).select(*keep, "s", "t1", F.expr("substring(right, length(made) - length(t1) + 1)").alias("t2"))
    return per_end, right.groupBy(*keep, "s", "t1", "t2").agg(F.count(F.lit(1)).alias("good"))


def kept(rules: DataFrame, least: int = 3, broken: float = 0.05, share: float = 0.6) -> DataFrame:
    """Rules that put `least` words right or more, break few, and are right in `share` of the words they apply to."""
    return rules.where((F.col("good") >= least) & (F.col("broken") <= broken * F.col("good")) & (F.col("good") / F.col("applied") >= share))


def suffix_rules(words: DataFrame, least: int = 3, broken: float = 0.05, share: float = 0.6) -> DataFrame:
    """(s, t1, t2, good, broken, applied): the rules that words (k, made, right) teach.

    A word counts once (repeated rows with one k count as several words); rows with a null are left out, and words under four letters teach nothing. Joiners should be taken out of
    both spellings beforehand. No wrong word gives no rule.
    """
    words = words.dropna(subset=["k", "made", "right"])
    per_end, right = counted(words)
    rules = candidates(words).join(right, ["s", "t1", "t2"]).join(per_end, ["s", "t1"])
    return kept(rules.withColumn("broken", F.col("same")), least, broken, share).select("s", "t1", "t2", "good", "broken", "applied")


def apply_rules(words: DataFrame, rules: DataFrame, *keep: str) -> DataFrame:
    """words with `fixed`: the made spelling after the rule with the longest s, then the longest t1, then the most good, then the smallest t2; no rule leaves it as it is.

    `keep` are columns that words and rules share (a fold, for instance). (keep, k) should be a key; rows with nulls in k or made have a null.
    """
    hits = ends(words, *keep).join(rules.select(*keep, "s", "t1", "t2", "good"), [*keep, "s", "t1"])
    first = F.min_by(F.struct("t1", "t2"), F.struct(-F.length("s"), -F.length("t1"), -F.col("good"), "t2"))
    best = hits.groupBy(*keep, "k").agg(first.alias("r")).select(*keep, "k", "r.t1", "r.t2")
    changed = F.concat(F.expr("left(made, length(made) - length(t1))"), F.col("t2"))
    return words.join(best, [*keep, "k"], "left").withColumn("fixed", F.when(F.col("t1").isNull(), F.col("made")).otherwise(changed)).drop("t1", "t2")


def fold_rules(words: DataFrame, folds: int = 5, least: int = 3, broken: float = 0.05, share: float = 0.6) -> DataFrame:
    """(fold, s, t1, t2, good, broken, applied): for each fold the rules that the words of the others teach.

    Counts are made once per fold and subtracted from the totals; nothing is learned anew for each fold.
    """
    words = words.dropna(subset=["k", "made", "right"]).withColumn("fold", word_fold(F.col("k"), folds))
    per_end, right = counted(words, "fold")
    every = candidates(words, "fold").withColumnRenamed("fold", "of")
    totals = right.groupBy("s", "t1", "t2").agg(F.sum("good").alias("good"))
    end_totals = per_end.groupBy("s", "t1").agg(F.sum("applied").alias("applied"), F.sum("same").alias("same"))
    taught = every.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("fold <> of").select("fold", "s", "t1", "t2").distinct()
    own = right.withColumnRenamed("good", "own_good")
    own_ends = per_end.select("fold", "s", "t1", F.col("applied").alias("own_applied"), F.col("same").alias("own_same"))
    rows = taught.join(totals, ["s", "t1", "t2"]).join(end_totals, ["s", "t1"]).join(own, ["fold", "s", "t1", "t2"], "left").join(own_ends, ["fold", "s", "t1"], "left")
    less = lambda c: F.col(c) - F.coalesce(f"own_{c}", F.lit(0))
    rows = rows.select("fold", "s", "t1", "t2", less("good").alias("good"), less("same").alias("broken"), less("applied").alias("applied"))
    return kept(rows.where("applied > 0"), least, broken, share)


def fold_accuracy(words: DataFrame, folds: int = 5, least: int = 3, broken: float = 0.05, share: float = 0.6) -> DataFrame:
    """(fold, words, before, after): how many words of a fold are right as made, and how many after the rules of the other folds."""
    words = words.dropna(subset=["k", "made", "right"]).withColumn("fold", word_fold(F.col("k"), folds))
    done = apply_rules(words, fold_rules(words.drop("fold"), folds, least, broken, share), "fold")
    right = lambda c: F.sum((F.col(c) == F.col("right")).cast("long"))
    return done.groupBy("fold").agg(F.count(F.lit(1)).alias("words"), right("made").alias("before"), right("fixed").alias("after"))
