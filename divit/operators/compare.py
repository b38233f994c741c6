"""Differences: lines, aligned tokens, splits, rollups and estimates."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from divit.functions.normalize import squeeze
from divit.operators.text import line_array


def train_minus_test(pars: DataFrame, is_test: str) -> DataFrame:
    """Paragraphs of the training works whose squeezed text occurs in no test work."""
    rows = pars.withColumn("norm", squeeze(F.col("ptext")))
    test = rows.where(is_test).select("norm").distinct()
    return rows.where(f"not ({is_test})").join(test, "norm", "left_anti")


def align(pairs: DataFrame, left: str = "a", right: str = "b", key: str = "id", line: str | None = None) -> DataFrame:
    """Opcodes of longest-matching-block alignment of two token arrays, one row per block; null arrays count as empty. `line`, a long column, is kept beside `key`.

    Replaced blocks of equal length are split into pairs of one token. Nothing in the JVM expresses the block search.
    """
    kind = pairs.schema[key].dataType.simpleString()
    names = [key, line] if line else [key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for *i, a, b in zip(*(frame[c] for c in names), frame[left], frame[right]):
                a, b = list(a) if a is not None else [], list(b) if b is not None else []
                for op, a0, a1, b0, b1 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                    cuts = [(x, x + 1, y, y + 1) for x, y in zip(range(a0, a1), range(b0, b1))] if op == "replace" and a1 - a0 == b1 - b0 else [(a0, a1, b0, b1)]
                    out += [(*i, op, x0, y0, " ".join(a[x0:x1]), " ".join(b[y0:y1])) for x0, x1, y0, y1 in cuts]
            yield pd.DataFrame(out, columns=[*names, "op", "left_pos", "right_pos", "left", "right"])

    return pairs.select(*names, left, right).mapInPandas(run, f"{key} {kind}, {f'{line} long, ' if line else ''}op string, left_pos long, right_pos long, left string, right string")


def neighbour_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, par, a, b): the lines of each document beside those of the next id, null where one of them lacks the line or has it blank.

    Whole texts travel, once as left and once as right, and are cut into lines where they meet. Of documents with one id each line meets each line; a line
    that no document of the other id has comes once a document.
    """
    left = docs.select(F.col(doc).alias("id"), F.col(text).alias("a"), F.monotonically_increasing_id().alias("na"))
    right = docs.select((F.col(doc) - 1).alias("id"), F.col(text).alias("b"), F.monotonically_increasing_id().alias("nb"))
    w = Window.partitionBy("id")
    met = left.join(right, "id").select("id", "na", "nb", line_array(F.col("a")).alias("a"), line_array(F.col("b")).alias("b"))
    met = met.withColumn("pairs", F.count(F.lit(1)).over(w)).withColumn("lead_a", F.col("na") == F.min("na").over(w)).withColumn("lead_b", F.col("nb") == F.min("nb").over(w))

    def held(c: str) -> Column:
        places = F.transform(F.col(c), lambda x, i: F.when(x.isNotNull(), i.cast("long")))
        return F.array_distinct(F.flatten(F.collect_set(F.when(F.col("pairs") > 1, F.array_compact(places))).over(w)))

    met = met.withColumn("in_a", held("a")).withColumn("in_b", held("b"))
    last = F.greatest(F.size("a"), F.size("b"))
    places = F.when(last > 0, F.sequence(F.lit(0), last - 1))

    def counts(x: Column) -> Column:
        both = x["a"].isNotNull() & x["b"].isNotNull()
        only_a = x["b"].isNull() & x["a"].isNotNull() & F.col("lead_b") & ~F.array_contains("in_b", x["par"])
        only_b = x["a"].isNull() & x["b"].isNotNull() & F.col("lead_a") & ~F.array_contains("in_a", x["par"])
        return both | only_a | only_b

    rows = F.transform(places, lambda i: F.struct(i.cast("long").alias("par"), F.get("a", i).alias("a"), F.get("b", i).alias("b")))
    return met.select("id", F.inline(F.filter(rows, counts)))


def coverage_rollup(toks: DataFrame, lexicon: DataFrame, by: str) -> DataFrame:
    """(by, is_total, tokens, covered, ratio) per group and in total. The lexicon joins the token counts, not the tokens."""
    n = toks.groupBy(by, "k").agg(F.count(F.lit(1)).alias("n"))
    hit = n.join(lexicon.select("k", F.lit(1).alias("hit")).distinct(), "k", "left")
    agg = hit.rollup(by).agg(F.grouping(by).cast("int").alias("is_total"), F.sum("n").alias("tokens"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("covered"))
    return agg.withColumn("ratio", F.round(F.col("covered").cast("double") / F.col("tokens"), 6))


def stratified_estimate(rows: DataFrame, top: str, wrong: str, weight: str) -> DataFrame:
    """One row: errors of the top stratum counted exactly, plus the tail's error rate times its mass, over all mass."""
    m = F.col(weight).cast("double")
    agg = rows.agg(F.sum(F.when(F.expr(top) & F.expr(wrong), m).otherwise(0.0)).alias("top_errors"), F.avg(F.when(~F.expr(top), F.expr(wrong).cast("double"))).alias("tail_rate"),
                   F.sum(F.when(~F.expr(top), m).otherwise(0.0)).alias("tail_mass"), F.sum(m).alias("mass"))
    return agg.select(F.round((F.col("top_errors") + F.col("tail_rate") * F.col("tail_mass")) / F.col("mass"), 6).alias("error_rate"), F.round("tail_rate", 6).alias("tail_rate"))
