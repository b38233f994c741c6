"""Accuracy, classes of differences, groups of differences, and rules on neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from divit.functions.ottoman import consonant_classes

#: Origins of words whose vowel letters don't tell meanings apart.
BORROWED = ("ar", "fa", "ar-fa", "fa-ar")


def difference_class(a: Column, b: Column, origin: Column, meaning: Column, variant: Column) -> Column:
    """The kind of difference of two spellings of a word.

    `meaning` and `variant` say whether the word is on the approved list of different meanings or of mere variants. A null origin counts as none.
    """
    borrowed = F.coalesce(origin, F.lit("")).isin(*BORROWED)
    strict = consonant_classes(a) == consonant_classes(b)
    loose = consonant_classes(a, True) == consonant_classes(b, True)
    return (F.when(F.translate(a, "ڭ", "ن") == F.translate(b, "ڭ", "ن"), "possessor").when(meaning, "meaning").when(variant, "variant")
            .when(strict, F.when(borrowed, "variant").otherwise("open")).when(loose & ~borrowed, "variant").otherwise("meaning"))


def accuracy(rows: DataFrame, by: str, right: str, weight: str) -> DataFrame:
    """rows(by, right, weight), one per type -> (by, is_total, types, right_types, weight, right_weight, type_accuracy, accuracy), with a total row.

    The total is the mean of the groups weighted by their weights (A34-A36). Null weights count as 0; an empty table gives the total row of zeros alone.
    """
    w = F.coalesce(F.col(weight), F.lit(0))
    hit = F.coalesce(F.col(right), F.lit(False))
    agg = rows.rollup(by).agg(F.grouping(by).cast("int").alias("is_total"), F.count(F.lit(1)).alias("types"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("right_types"),
                              F.coalesce(F.sum(w), F.lit(0)).alias("weight"), F.coalesce(F.sum(F.when(hit, w).otherwise(0)), F.lit(0)).alias("right_weight"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a).cast("double") / F.col(b), 6)).otherwise(0.0)
    return agg.withColumn("type_accuracy", ratio("right_types", "types")).withColumn("accuracy", ratio("right_weight", "weight"))


def diff_groups(opcodes: DataFrame, source: str, *place: str) -> DataFrame:
    """opcodes(source, op, left, right, place...) -> (source, left, right, n, place): equal differences together, most first.

    Equal tokens are no differences. `place` is the first one as text, of which null parts are left out.
    """
    # Only the least place of a group is kept, so that a common difference gathers no list of all its places; its text is made once a group.
    order = F.struct(*(F.col(p).alias(f"p{i}") for i, p in enumerate(place)))
    grouped = opcodes.where("op <> 'equal'").withColumn("o", order).groupBy(source, "left", "right").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first"))
    text = F.concat_ws(":", *(F.col(f"first.p{i}").cast("string") for i in range(len(place))))
    return grouped.select(source, "left", "right", "n", text.alias("place")).orderBy(F.desc("n"), "left", "right")


def matching_rules(toks: DataFrame, rules: DataFrame) -> DataFrame:
    """toks(k, l2, l1, r1, r2, ...) with rules(k, rule, spelling, conditions): the first rule of a word all whose conditions hold.

    conditions: array of (place, pattern); place is L2, L1, R1, R2 or C (any of the four), and the whole neighbour must match. '#' (beyond the line) matches
    nothing. The smallest `rule` wins; tokens without a rule that holds give no row. Rules are few: they join by word.
    """
    holds = """forall(conditions, c -> exists(
        CASE c.place WHEN 'L2' THEN array(l2) WHEN 'L1' THEN array(l1) WHEN 'R1' THEN array(r1) WHEN 'R2' THEN array(r2) ELSE array(l2, l1, r1, r2) END,
        t -> t <> '#' AND t RLIKE concat('^(?:', c.pattern, ')$')))"""
    names = toks.columns
    met = toks.join(rules.select("k", "rule", "spelling", "conditions"), "k").where(F.expr(holds))
    return met.groupBy(*names).agg(F.min(F.struct("rule", "spelling")).alias("m")).select(*names, "m.rule", "m.spelling")
