"""Spelling variants of words that no lexicon has: hard consonants softened, or one rounded vowel opened or closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from divit.functions.suffixes import ALL_VOWELS

#: Consonants that may stand for softer ones, rounded vowels and their counterparts, and the most places that are varied together.
HARDENED, ROUNDED, PLACES = ("ptç", "bdc"), ("uoüö", "ouöü"), 4


def variants(words: DataFrame) -> DataFrame:
    """(k, variant, kind, turn): the variants of distinct words in the order in which they are tried, turn from 0.

    First p, and t and ç before no vowel, behind the first letter, as b, d and c: all choices of one place, then of two, and so on, from the left; words with more
    than four such places have none of these. Then each rounded vowel behind the first letter, one at a time. A word has at most 15 variants of the first kind, and one
    for each rounded vowel. Nulls and words without variants give no row.
    """
    rows = words.select("k").where("k is not null and k <> ''").distinct()
    letters = F.split("k", "")

    def hard(i: Column) -> Column:
        c, after = F.get(letters, i), F.get(letters, i + 1)
        return (i > 0) & ((c == "p") | (c.isin("t", "ç") & (after.isNull() | ~after.isin(*ALL_VOWELS))))

    rows = rows.withColumn("n", F.length("k")).withColumn("places", F.filter(F.sequence(F.lit(0), F.length("k") - 1), hard)).withColumn("some", F.size("places"))
    masks = rows.where(F.col("some").between(1, PLACES)).withColumn("mask", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), F.col("some")) - 1).cast("int"))))
    softened = F.expr(f"array_join(transform(split(k, ''), (c, i) -> if(array_position(places, i) > 0 and shiftright(mask, cast(some - array_position(places, i) as int)) % 2 = 1, translate(c, '{HARDENED[0]}', '{HARDENED[1]}'), c)), '')")
    soft = masks.select("k", softened.alias("variant"), F.lit("soft").alias("kind"), F.struct(F.lit(0).alias("kind"), F.bit_count("mask").alias("many"), (-F.col("mask")).alias("at")).alias("turn"))
    at = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).where(F.substr("k", F.col("i"), F.lit(1)).isin(*ROUNDED[0]) & (F.col("i") > 1))
    swapped = F.concat(F.left("k", F.col("i") - 1), F.translate(F.substr("k", F.col("i"), F.lit(1)), *ROUNDED), F.substr("k", F.col("i") + 1))
    round_ = at.select("k", swapped.alias("variant"), F.lit("rounded").alias("kind"), F.struct(F.lit(1).alias("kind"), F.lit(0).alias("many"), F.col("i").alias("at")).alias("turn"))
    return soft.unionByName(round_)


def variant_lookup(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(k, variant, kind): for words that the lexicon (k) lacks their first variant that it has. Repeated words and entries give one row."""
    unknown = words.select("k").distinct().join(lexicon.select("k"), "k", "left_anti")
    known = lexicon.select(F.col("k").alias("variant")).distinct()
    hit = variants(unknown).join(known, "variant", "left_semi")
    return hit.groupBy("k").agg(F.min_by(F.struct("variant", "kind"), "turn").alias("b")).select("k", "b.variant", "b.kind")
