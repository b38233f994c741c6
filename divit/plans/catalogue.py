"""Queries over the driver tables; their SQL twins are in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divit.functions.normalize import eastern_digits, flat, no_apostrophe, ottoman_punctuation, roman_number
from divit.functions import ottoman
from divit.operators import compare, context, evaluate, lexicon, suffix, vocabulary
from divit.operators.skew import classed, cut, few, in_turns, kept, of_turn, passing
from divit.operators.text import paragraphs, tokens, word_counts
from divit.plans.oracle import GIVEN, NUMERALS
from divit.plans.oracle import ORACLE as ORACLE
from divit.sources.files import chapters, html_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}



def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc_tokens(spark: SparkSession, sf: str, *keep: str, around: int = 0) -> DataFrame:
    return tokens(table(spark, sf, "documents"), *keep, around=around)


def doc_words(spark: SparkSession, sf: str) -> DataFrame:
    return doc_pairs(spark, sf).select("k").distinct()


def given(spark: SparkSession) -> DataFrame:
    """Keys that exercise what the tables' languages lack."""
    return spark.createDataFrame([(k,) for k in GIVEN], "k string")


def bench_words(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(table(spark, sf, "benchmark")).select("k").distinct()


def doc_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return word_counts(table(spark, sf, "documents"))


def bench_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.majority(word_counts(table(spark, sf, "benchmark")), 0, 1)


def lexicons(spark: SparkSession, sf: str) -> DataFrame:
    talk = vocabulary.majority(word_counts(table(spark, sf, "conversations")), 0, 1)
    return lexicon.prioritized(talk, bench_lexicon(spark, sf))


@query
def token_freq(spark, sf):
    """A01."""
    return vocabulary.counts(doc_tokens(spark, sf), "k")


@query
def token_freq_by_source(spark, sf):
    """A02."""
    return vocabulary.counts(doc_tokens(spark, sf, "source"), "k", "source")


@query
def top2_sources_per_word(spark, sf):
    """Null sources count as a source without a name."""
    named = doc_tokens(spark, sf, "source").withColumn("source", F.coalesce("source", F.lit("")))
    return vocabulary.top_per(vocabulary.counts(named, "k", "source"), "k", "source", 2)


@query
def vocab_minus_benchmark(spark, sf):
    """A03."""
    return doc_words(spark, sf).where("length(k) > 1").join(bench_words(spark, sf), "k", "left_anti")


@query
def vocab_intersect_benchmark(spark, sf):
    """F01."""
    return doc_words(spark, sf).intersect(bench_words(spark, sf))


@query
def vocab_symdiff(spark, sf):
    """F01."""
    return vocabulary.symmetric_difference(doc_words(spark, sf), bench_words(spark, sf))


@query
def pair_counts(spark, sf):
    """A04."""
    return doc_pairs(spark, sf)


@query
def majority_spelling(spark, sf):
    """A05."""
    return vocabulary.majority(doc_pairs(spark, sf))


@query
def majority_expand_keys(spark, sf):
    """The natural key first, derived keys only where no key is natural; the given keys count five times each."""
    voted = vocabulary.majority(doc_pairs(spark, sf).unionByName(given(spark).select("k", F.col("k").alias("w"), F.lit(5).cast("long").alias("n"))))
    keys = F.explode(F.array_distinct(F.array("k", flat(F.col("k")), no_apostrophe(F.col("k")), flat(no_apostrophe(F.col("k")))))).alias("derived")
    rows = voted.select(keys, (F.col("k")).alias("k"), "spelling").withColumn("rank", (F.col("derived") != F.col("k")).cast("int"))
    return rows.groupBy("derived").agg(F.min(F.struct("rank", "k", "spelling")).alias("b")).select("derived", "b.k", "b.spelling", "b.rank")


@query
def changed_spellings(spark, sf):
    """A07."""
    old = bench_lexicon(spark, sf).select("k", F.col("spelling").alias("before"))
    return vocabulary.majority(doc_pairs(spark, sf)).join(old, "k").where("spelling <> before").select("k", "before", F.col("spelling").alias("after"), "n")


@query
def phrase_majority(spark, sf):
    """Phrases of two neighbouring keys, with the spelling of the second voted."""
    two = doc_tokens(spark, sf, around=1).where("l1 <> '#'").select(F.concat_ws(" ", "l1", "k").alias("k"), "w")
    return vocabulary.majority(vocabulary.counts(two, "k", "w"))


@query
def prioritized_lexicon(spark, sf):
    """D02."""
    return lexicons(spark, sf)


@query
def flat_index(spark, sf):
    """D11."""
    return lexicon.flat_index(doc_words(spark, sf).union(given(spark)))


@query
def apostrophe_index(spark, sf):
    """D12."""
    return lexicon.apostrophe_index(doc_words(spark, sf).union(given(spark)))


@query
def exact_or_flat_lookup(spark, sf):
    """J01, J02."""
    return lexicon.exact_or_flat(doc_words(spark, sf), bench_words(spark, sf))


@query
def longest_prefix_root(spark, sf):
    """The longest root that begins a word; no suffixes are peeled."""
    return lexicon.longest_prefix(doc_words(spark, sf), bench_words(spark, sf))


@query
def phrase_ngram_join(spark, sf):
    """documents' word pairs that occur in the benchmark."""
    def two(name):
        return tokens(table(spark, sf, name), around=1).where("l1 <> '#'").select(F.concat_ws(" ", "l1", "k").alias("k"))
    return vocabulary.counts(two("documents"), "k").join(two("benchmark").distinct(), "k", "left_semi")


@query
def skeleton_blocks(spark, sf):
    """J24."""
    unknown = doc_words(spark, sf).join(bench_words(spark, sf), "k", "left_anti")
    return lexicon.skeleton_blocks(unknown, bench_words(spark, sf))


@query
def fuzzy_top3_levenshtein(spark, sf):
    """J24, with the edit distance as a stand-in cost."""
    unknown = doc_words(spark, sf).join(bench_words(spark, sf), "k", "left_anti")
    return lexicon.fuzzy(unknown, bench_words(spark, sf))


@query
def ambiguous_keys(spark, sf):
    """A19."""
    return vocabulary.ambiguous(doc_pairs(spark, sf))


@query
def work_separation(spark, sf):
    """Per ambiguous key, the share that agrees with its work's own majority."""
    pairs = vocabulary.counts(doc_tokens(spark, sf, "source"), "k", "source", "w")
    keys = vocabulary.ambiguous(pairs.groupBy("k", "w").agg(F.sum("n").alias("n"))).select("k")
    per = pairs.join(keys, "k", "left_semi").groupBy("k", "source").agg(F.max("n").alias("m"), F.sum("n").alias("t"))
    return per.groupBy("k").agg(F.count(F.lit(1)).alias("works"), F.round(F.sum("m").cast("double") / F.sum("t"), 6).alias("share"))


@query
def context_features(spark, sf):
    """X01, A26."""
    # Counted before they meet the ambiguous keys, which are the commonest words.
    return context.context_features(doc_tokens(spark, sf, around=1)).join(vocabulary.ambiguous(doc_pairs(spark, sf)).select("k"), "k", "left_semi")


@query
def holdout_totals(spark, sf):
    """A23."""
    return context.held_out(vocabulary.counts(doc_tokens(spark, sf, "source").where("source is not null"), "k", "w", "source"), ["k", "w"])


@query
def loo_outcomes(spark, sf):
    """A23-A25."""
    with passing(spark):
        choices, n = classed(cut(vocabulary.ambiguous(doc_pairs(spark, sf))), "total")
        choices = few(choices.select("k", "first", "second", "_turn"))
        toks = doc_tokens(spark, sf, "source", around=1).where("source is not null").join(choices, "k").where("w = first or w = second")
        toks = cut(toks.select("k", "source", "l1", "r1", "w", "_turn"), "_turn", "zstd")
        found = in_turns(spark, n, lambda turn: context.outcomes(context.leave_one_out(of_turn(toks, turn), of_turn(choices, turn))))
        return kept(found.groupBy("outcome").agg(F.sum("n").alias("n")))


def _by_turns(spark, sf, rows_of, **tables):
    """The rows that rows_of(first, *tables) gives for the ambiguous words of each turn; a table's tokens are stored once, by turns."""
    with passing(spark):
        first, n = classed(cut(vocabulary.ambiguous(doc_pairs(spark, sf)).select("k", "first", "total")), "total")
        first = few(first.select("k", "first", "_turn"))
        stored = [cut(toks.select("k", *kept_columns, *context.AROUND).join(first.select("k", "_turn"), "k"), "_turn", "zstd") for toks, kept_columns in tables.values()]
        return kept(in_turns(spark, n, lambda turn: rows_of(of_turn(first, turn), *(of_turn(x, turn) for x in stored))))


def _bayes_outcomes(spark, sf):
    def outcomes(first, toks):
        spots = cut(vocabulary.counts(toks, "k", "source", "w", *context.AROUND))
        return context.tried_outcomes(context.bayes_choice(spots, spots, first, "source", carry=("w", "n")))

    return _by_turns(spark, sf, outcomes, docs=(doc_tokens(spark, sf, "source", around=2).where("source is not null"), ["source", "w"]))


@query
def nb_choice(spark, sf):
    """The documents' model chooses spellings in conversations."""
    def chosen(first, toks, talk):
        found = context.bayes_choice(talk, toks.withColumn("n", F.lit(1).cast("long")), first, least=2, real=True)
        return found.select("k", *context.AROUND, "chosen", "margin", "evidence", context.at_threshold(F.lit(1.0)).alias("taken"))

    docs = doc_tokens(spark, sf, "source", around=2).where("source is not null")
    return _by_turns(spark, sf, chosen, docs=(docs, ["w"]), talk=(tokens(table(spark, sf, "conversations"), around=2), []))


@query
def nb_outcomes(spark, sf):
    """A24."""
    return _bayes_outcomes(spark, sf).groupBy("threshold", "outcome").agg(F.sum("n").alias("n"))


@query
def threshold_pick(spark, sf):
    """A25."""
    return context.threshold_pick(_bayes_outcomes(spark, sf))


@query
def foreign_islands(spark, sf):
    """Runs of words that the benchmark lacks."""
    docs = table(spark, sf, "documents").withColumn("copy", F.monotonically_increasing_id())
    return context.islands(tokens(docs, "doc_id", "copy"), bench_words(spark, sf), "doc_id", "par", copy="copy")


@query
def concordance_5(spark, sf):
    """X11: benchmark words in documents, with five words on either side."""
    names = [f"l{i}" for i in range(5, 0, -1)] + ["w"] + [f"r{i}" for i in range(1, 6)]
    return doc_tokens(spark, sf, "doc_id", around=5).join(bench_words(spark, sf), "k", "left_semi").select("doc_id", "par", "pos", "k", F.concat_ws(" ", *names).alias("line"))


@query
def suffix_candidates(spark, sf):
    """A27."""
    return suffix.suffix_candidates(doc_words(spark, sf))


@query
def root_vote(spark, sf):
    """A13."""
    words = doc_words(spark, sf)
    return suffix.root_vote(words, suffix.suffix_candidates(words))


@query
def kfold_accuracy(spark, sf):
    """A30, A31, with capitalisation as a stand-in for a learned spelling."""
    return suffix.kfold_spelling(doc_pairs(spark, sf))


@query
def train_minus_test_paragraphs(spark, sf):
    """Works whose name ends in an even digit are the test side."""
    pars = paragraphs(table(spark, sf, "documents").where("source is not null"), "doc_id", "source")
    return compare.train_minus_test(pars, "right(source, 1) in ('0', '2', '4', '6', '8')").select("doc_id", "par")


@query
def coverage_rollup(spark, sf):
    """A33, A36."""
    toks = doc_tokens(spark, sf, "lang").withColumn("lang", F.coalesce("lang", F.lit("")))
    return compare.coverage_rollup(toks, lexicons(spark, sf), "lang")


@query
def stratified_estimate(spark, sf):
    """Words of 200 uses or more are the top stratum; a word that the benchmark lacks is wrong."""
    n = vocabulary.counts(doc_tokens(spark, sf), "k")
    rows = n.join(bench_words(spark, sf).withColumn("hit", F.lit(True)), "k", "left").withColumn("wrong", F.col("hit").isNull())
    return compare.stratified_estimate(rows, "n >= 200", "wrong", "n")


@query
def line_diff_keys(spark, sf):
    """lines of documents that occur in more than one document."""
    pars = paragraphs(table(spark, sf, "documents"), "doc_id")
    return pars.groupBy(F.md5("ptext").alias("line")).agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc")).where("docs > 1")


@query
def align_tokens(spark, sf):
    """every line of each document against that of the next id, aligned; a line that one of them lacks counts as empty."""
    lines = compare.neighbour_lines(table(spark, sf, "documents"))
    return compare.align(lines.select("id", "par", F.split("a", " ").alias("a"), F.split("b", " ").alias("b")), line="par")


@query
def eastern_digit_texts(spark, sf):
    """K01, N21."""
    return table(spark, sf, "documents").select("doc_id", eastern_digits(ottoman_punctuation(F.col("text"))).alias("text"))


@query
def roman_numbers(spark, sf):
    """T10, with the numerals of NUMERALS, since texts hold few."""
    words = doc_tokens(spark, sf).select("w").union(spark.createDataFrame([(n,) for n in NUMERALS], "w string"))
    toks = words.select(roman_number(F.col("w")).cast("long").alias("value")).where("value is not null")
    return vocabulary.counts(toks, "value")


@query
def chapter_chunks(spark, sf):
    """K03."""
    lines = paragraphs(table(spark, sf, "documents"), "doc_id")
    return chapters(lines, "doc_id", "par", "ptext").select("doc_id", "chapter", "n_lines", F.md5("body").alias("body_md5"))


@query
def html_texts(spark, sf):
    """S04."""
    return table(spark, sf, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query
def registry_latest(spark, sf):
    """Conversations as a log, the last turn of each role wins."""
    rows = table(spark, sf, "conversations").where("conv_id is not null and turn is not null")
    return rows.groupBy("conv_id", "role").agg(F.max_by("text", F.struct("turn", "text")).alias("text"), F.max("turn").alias("turn"))


@query
def unknown_rank(spark, sf):
    """Words of documents that no lexicon has, with whether they occur in lower case, the most frequent 100,000."""
    n = doc_tokens(spark, sf).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("w") == F.col("k")).cast("int")).alias("lower"))
    return n.join(lexicons(spark, sf).select("k"), "k", "left_anti").orderBy(F.desc("n"), "k").limit(100_000)


@query
def verse_lookup(spark, sf):
    """(conv_id, turn) as a verse address; each row asks for the verse after it."""
    verses = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    asked = verses.select("conv_id", F.col("turn").alias("from_turn"), (F.col("turn") + 1).alias("turn"))
    return asked.join(verses, ["conv_id", "turn"])


@query
def word_forms(spark, sf):
    """The normal forms of all words."""
    words = doc_tokens(spark, sf).select("w").distinct().union(given(spark))
    k = ottoman.key_lower(F.col("w"))
    return words.select("w", k.alias("key"), ottoman.plain_key(k).alias("plain"), ottoman.hamza_less(k).alias("hamza_less"), ottoman.macron_to_circumflex(F.col("w")).alias("circumflex"),
                        ottoman.phrase_key(F.col("w")).alias("phrase"), ottoman.latin_sound_key(k).alias("sound"), ottoman.latin_consonants(F.col("w")).alias("consonants"), ottoman.latin_skeleton(F.col("w")).alias("skeleton"))


@query
def soft_stem_lookup(spark, sf):
    """J02."""
    return lexicon.soft_stems(doc_words(spark, sf), doc_words(spark, sf).where("k rlike '[kpç]$'"))


@query
def number_words(spark, sf):
    """Number words in one piece, split."""
    words = doc_words(spark, sf).union(given(spark))
    return words.select("k", F.array_join(ottoman.number_parts(F.col("k")), " ").alias("parts")).where("parts is not null")


def _spelling_types(spark, sf) -> DataFrame:
    """(source, k, w, n, hit): the spellings of each work, right where they are the majority over all works."""
    pairs = word_counts(table(spark, sf, "documents"), "source").withColumn("source", F.coalesce("source", F.lit("")))
    voted = vocabulary.majority(doc_pairs(spark, sf), 0, 1).select("k", "spelling")
    return pairs.join(voted, "k").withColumn("hit", F.col("w") == F.col("spelling"))


@query
def weighted_accuracy(spark, sf):
    """Accuracy of the majority spelling by the length of the word, and in total."""
    rows = _spelling_types(spark, sf).withColumn("size", F.least(F.length("k"), F.lit(12)))
    return evaluate.accuracy(rows, "size", "hit", "n")


@query
def work_total_rollup(spark, sf):
    """The same per work, with the total."""
    return evaluate.accuracy(_spelling_types(spark, sf), "source", "hit", "n")


@query
def diff_groups(spark, sf):
    """differences of lines of neighbouring documents, grouped."""
    return evaluate.diff_groups(align_tokens(spark, sf).withColumn("kind", F.lit("line")), "kind", "id", "par", "left_pos")
