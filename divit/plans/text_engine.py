"""Queries of the text engine over the driver tables: suffix chains, phrases, claims, the word cascade, learned endings and ownership.

The tables hold no Arabic script, so the benchmark's words stand for the lexicon: a word's spelling is that of its letters. SQL twins are in text_engine_sql.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from divit.functions.letters import by_letters
from divit.functions.normalize import ROMAN
from divit.operators import alignment, cascade, claims, context, ownership, phrases, suffix_chains, suffix_rules, transliterate, variants, verbs, vocabulary
from divit.operators.skew import cut
from divit.operators.text import paragraphs, tokens
from divit.plans.catalogue import bench_words, doc_pairs, doc_tokens, doc_words, table
from divit.plans.text_engine_sql import ACCENTS, ARTICLES, BLOCKERS, TURNERS
from divit.plans.text_engine_sql import ORACLE as ORACLE

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _chain(parts: str = "parts"):
    return F.array_join(parts, "+").alias("parts")


@query
def legal_chain_split(spark, sf):
    """What words leave behind benchmark words, as legal chains of up to five suffixes."""
    tails = suffix_chains.tried_roots(doc_words(spark, sf), bench_words(spark, sf)).select("tail")
    return suffix_chains.legal_splits(tails).select("tail", _chain())


@query
def tail_split(spark, sf):
    """The same tails, as up to three suffixes, the longest first one first."""
    tails = suffix_chains.tried_roots(doc_words(spark, sf), bench_words(spark, sf)).select("tail")
    return suffix_chains.split_tails(tails).select("tail", _chain())


@query
def suffix_peel(spark, sf):
    """Up to three suffixes peeled off until a benchmark word is left."""
    return suffix_chains.peeled(doc_words(spark, sf), bench_words(spark, sf)).select("k", "root", _chain())


@query
def deep_roots(spark, sf):
    """The longest benchmark word before a legal chain of suffixes."""
    return suffix_chains.rooted(doc_words(spark, sf), bench_words(spark, sf)).select("k", "root", _chain())


@query
def chain_spelling(spark, sf):
    """The spelling of the chains that deep_roots finds, and whether they are trusted."""
    found = suffix_chains.rooted(doc_words(spark, sf), bench_words(spark, sf))
    root, parts = F.col("root"), F.col("parts")
    found = found.withColumn("sound", suffix_chains.trusted(root, parts))
    found = found.withColumn("spelling", suffix_chains.chain_spelling(root, parts, F.array().cast("array<string>"), F.col("sound")))
    return found.select("k", "root", "sound", "spelling", F.array_join("parts", "+").alias("chain"))


@query
def verb_split(spark, sf):
    """Words of documents that end as verbs do, with the longest ending that fits."""
    return verbs.verb_forms(doc_words(spark, sf))


@query
def variant_hits(spark, sf):
    """Words of documents that the benchmark lacks, with their first variant that it has."""
    return variants.variant_lookup(doc_words(spark, sf), bench_words(spark, sf))


def _bench_phrases(spark, sf) -> DataFrame:
    """Runs of two and three words, one blank between them, of a benchmark line."""
    words = phrases.pieces(paragraphs(table(spark, sf, "benchmark"), "item_id"), "item_id")
    two = F.transform("words", lambda w, i: F.when(F.get("gaps", i) == " ", F.concat_ws(" ", w, F.get("words", i + 1))))
    three = F.transform("words", lambda w, i: F.when((F.get("gaps", i) == " ") & (F.get("gaps", i + 1) == " "), F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2))))
    runs = words.select(F.explode(F.concat(two, three)).alias("phrase")).where("phrase is not null")
    return runs.groupBy("phrase").count().where("count >= 2").select("phrase")


def _spans(spark, sf) -> DataFrame:
    return phrases.phrase_spans(paragraphs(table(spark, sf, "documents"), "doc_id"), _bench_phrases(spark, sf), "doc_id", "par")


@query
def phrase_covered_tokens(spark, sf):
    """Phrases that reading each document finds, and the words that they cover."""
    return _spans(spark, sf).where("claimed").groupBy("doc_id").agg(F.count(F.lit(1)).alias("phrases"), F.sum((F.col("stop") - F.col("start")).cast("long")).alias("covered"), F.max(F.length("phrase")).alias("longest"))


@query
def claim_layers(spark, sf):
    """Claims of three layers on the words of documents: phrases, then numerals, then words of two letters, each only where no outer one lies."""
    lines = paragraphs(table(spark, sf, "documents"), "doc_id")
    rows = transliterate.runs(lines, "doc_id", "par")
    rows = cut(rows.where((F.length("w") == 2) | F.col("w").isin(*ROMAN)))  # layers are read by several plans
    short = rows.where("length(w) = 2").select("doc_id", "par", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"), F.lit("").alias("spelling"))
    found = cut(_spans(spark, sf).where("claimed").withColumn("spelling", F.col("phrase")))
    held = claims.awarded([("phrase", found), ("numeral", transliterate.numerals(rows, "doc_id", "par")), ("short", short)], "doc_id", "par")
    return held.groupBy("doc_id", "layer").agg(F.count(F.lit(1)).alias("claims"), F.sum((F.col("stop") - F.col("start")).cast("long")).alias("words"))


def _letter_lexicon(spark, sf) -> DataFrame:
    return bench_words(spark, sf).select("k", by_letters(F.translate("k", "'’", "")).alias("spelling"))


@query
def word_layers(spark, sf):
    """The layer of the cascade that decides each distinct word, and how many words each layer decides, per layer."""
    found = cascade.resolve(doc_words(spark, sf), cascade.word_layers(_letter_lexicon(spark, sf)))
    return found.groupBy("layer").agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("k").cast("long")).alias("letters"), F.min("k").alias("first"), F.max("k").alias("last"))


@query
def transliterate_documents(spark, sf):
    """All documents in Arabic script; no SQL twin, as letters and chains are spelled."""
    lines = paragraphs(table(spark, sf, "documents"), "doc_id")
    spelled = _bench_phrases(spark, sf).withColumn("spelling", by_letters(F.replace(F.col("phrase"), F.lit(" "), F.lit(""))))
    return transliterate.transliterate(lines, _letter_lexicon(spark, sf), spelled, "doc_id", "par")


@query
def unknown_suggestions(spark, sf):
    """Words of documents that the benchmark lacks, with their number, the benchmark words in letters that fit best, and the veto of the best; no SQL twin, as the costs are aligned."""
    n = doc_pairs(spark, sf).groupBy("k").agg(F.sum("n").alias("seen")).join(bench_words(spark, sf), "k", "left_anti").where("length(k) >= 4")
    entries = tokens(table(spark, sf, "benchmark")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(by_letters(F.translate("k", "'’", "")).alias("entry"), "n")
    found = alignment.suggestions(n.select("k"), entries, most=3.0)
    return found.join(n, "k").select("k", "seen", "entry", "n", F.round("cost", 6).alias("cost"), F.round("score", 6).alias("score"), "rank", alignment.veto(F.col("k"), F.col("entry")).alias("veto"))


def _accent_pairs(spark, sf) -> DataFrame:
    """(k, made, right): words without their accents, and the spelling that most of their occurrences have (twice or more, in 70 % or more)."""
    words = doc_pairs(spark, sf).groupBy("k").agg(F.sum("n").alias("n"))  # accents are looked for in distinct words
    top = vocabulary.majority(words.select(F.translate("k", *ACCENTS).alias("k"), F.col("k").alias("w"), "n"), 0.7, 2)
    return top.where(F.length("k") >= 4).select("k", F.col("k").alias("made"), F.col("spelling").alias("right"))


@query
def learned_suffix_rules(spark, sf):
    """Rules of word ends that put accents right."""
    return suffix_rules.suffix_rules(_accent_pairs(spark, sf))


@query
def fold_rule_accuracy(spark, sf):
    """Accuracy of accents before and after the rules that the other folds teach."""
    return suffix_rules.fold_accuracy(_accent_pairs(spark, sf))


@query
def feature_counts(spark, sf):
    """The neighbours of each spelling of ambiguous words, per work."""
    toks = doc_tokens(spark, sf, "source", around=1).where("source is not null")
    return context.feature_counts(toks.join(vocabulary.ambiguous(doc_pairs(spark, sf)).select("k"), "k", "left_semi"), "source")


@query
def nearest_owner_6(spark, sf):
    """Words of five letters or more whose nearest article or pronoun among the six words before them in the clause is an article."""
    rows = paragraphs(table(spark, sf, "documents"), "doc_id")
    clauses = ownership.clauses(rows, "doc_id", "par")
    return ownership.nearest_owner(clauses, "doc_id", "par", target=lambda k: F.length(k) >= 5, owner=lambda k: k.isin(*ARTICLES), blocker=lambda k: k.isin(*BLOCKERS), turned=lambda k: k.isin(*TURNERS))
