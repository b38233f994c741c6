"""Paragraphs and tokens. Neighbours are taken inside a paragraph's array, so no plan here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from divit.functions.normalize import WORD, turkish_lower

EDGE = "#"
NOT_BLANK = "[^ \\t\\r]"


def paragraphs(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """One row per non-blank line: `keep`, par (line number from 0), ptext. Null texts give none."""
    lines = df.select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("par", "ptext"))
    return lines.where(F.col("ptext").rlike(NOT_BLANK)).withColumn("par", F.col("par").cast("long"))


def line_array(text: Column) -> Column:
    """The lines of a text in their order, null where they are blank; a null text has none."""
    return F.transform(F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>")), lambda x: F.when(x.rlike(NOT_BLANK), x))


def tokens(df: DataFrame, *keep: str, text: str = "text", around: int = 0) -> DataFrame:
    """One row per word: `keep`, par, pos (from 0), w (as written), k (key); l1, r1 ... are the keys `around` it, '#' beyond the ends."""
    words = paragraphs(df, *keep, text=text).select(*keep, "par", F.regexp_extract_all("ptext", F.lit(WORD), F.lit(0)).alias("words"))
    if not around:  # no neighbours: plain rows, lower-cased in generated code
        return words.select(*keep, "par", F.posexplode("words").alias("pos", "w")).select(*keep, "par", F.col("pos").cast("long").alias("pos"), "w", turkish_lower(F.col("w")).alias("k"))
    keyed = words.withColumn("keys", F.split(turkish_lower(F.array_join("words", "\n")), "\n"))  # one call a line, as a call costs more than its letters

    def item(w: Column, i: Column) -> Column:
        near = []
        for d in range(1, around + 1):
            near += [F.coalesce(F.get("keys", i - d), F.lit(EDGE)).alias(f"l{d}"), F.coalesce(F.get("keys", i + d), F.lit(EDGE)).alias(f"r{d}")]
        return F.struct(i.cast("long").alias("pos"), w.alias("w"), F.get("keys", i).alias("k"), *near)

    return keyed.select(*keep, "par", F.inline(F.transform("words", item)))


def word_counts(df: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """(k, w, *by, n): how often each word is written. Words are counted as written and lower-cased once each, not once a token."""
    lines = df.select(*by, F.explode(F.split(F.col(text), "\n", -1)).alias("ptext"))
    written = lines.select(*by, F.explode(F.regexp_extract_all("ptext", F.lit(WORD), F.lit(0))).alias("w"))
    n = written.groupBy("w", *by).agg(F.count(F.lit(1)).alias("n"))
    return n.select(turkish_lower(F.col("w")).alias("k"), "w", *by, "n")
