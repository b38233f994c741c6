"""Steps that many queries share do their work once a word, and wide rows don't travel."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from divit.operators import compare, context, evaluate, phrases
from divit.operators.skew import cut, few
from divit.operators.text import paragraphs, tokens, word_counts
from divit.sources import files

TEXTS = [("a", "Iğdır İzmir IĞDIR\n \t\r\nİzmir'in ığdır"), ("b", None), ("b", ""), (None, "ÉTÉ été İI"), ("a", "x\n\nIx 12 ?"), ("a", "\t\n \r")]


def test_words_are_counted_before_they_are_lowered(spark):
    df = spark.createDataFrame(TEXTS, "source string, text string")
    want = tokens(df, "source").groupBy("k", "w", "source").count().collect()
    assert sorted(map(str, word_counts(df, "source").select("k", "w", "source", F.col("n").alias("count")).collect())) == sorted(map(str, want))


def test_keys_are_the_same_with_and_without_neighbours(spark):
    df = spark.createDataFrame(TEXTS, "source string, text string")
    assert sorted(map(str, tokens(df, around=2).select("par", "pos", "w", "k").collect())) == sorted(map(str, tokens(df).select("par", "pos", "w", "k").collect()))
    assert [r["k"] for r in tokens(df.where("text like 'Iğ%'"), around=1).orderBy("par", "pos").collect()] == ["ığdır", "izmir", "ığdır", "izmir'in", "ığdır"]


def test_cut_tables_are_files(spark):
    df = spark.range(5).withColumn("spot", F.monotonically_increasing_id())
    kept = cut(df)
    assert kept.inputFiles() and kept.count() == 5 and kept.schema.names == ["id", "spot"]
    assert cut(df.where("id < 0")).count() == 0
    assert sorted(r["id"] for r in few(df, 2).collect()) == [0, 1, 2, 3, 4]


def test_carried_occurrences_are_those_that_a_join_finds(spark):
    rows = [("k", w, s, l1, "#", "#", "#", n) for w, s, l1, n in [("k", "a", "x", 3), ("K", "a", "x", 2), ("K", "b", "y", 4), ("k", "b", "x", 1), ("k", "c", "z", 5), ("K", "c", None, 1)]]
    spots = spark.createDataFrame(rows, "k string, w string, source string, l1 string, r1 string, l2 string, r2 string, n long")
    first = spark.createDataFrame([("k", "k")], "k string, first string")
    plain = context.threshold_outcomes(spots.where("l1 is not null"), context.bayes_choice(spots, spots, first, "source"), "source")
    carried = context.tried_outcomes(context.bayes_choice(spots.where("l1 is not null"), spots, first, "source", carry=("w", "n")))
    assert sorted(map(str, plain.collect())) == sorted(map(str, carried.collect()))


def test_spellings_left_out_stand_in_columns(spark):
    toks = spark.createDataFrame([("k", w, s, "x", "y") for w, s in [("k", "a"), ("K", "b"), ("K", "b"), ("k", "c")]], "k string, w string, source string, l1 string, r1 string")
    found = context.leave_one_out(toks, spark.createDataFrame([("k", "k", "K")], "k string, first string, second string"))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["source"], r["w"]): (r["chosen"], r["majority"], r["n"]) for r in found.collect()} == {("a", "k"): ("K", "K", 1), ("b", "K"): ("k", "k", 2), ("c", "k"): ("K", "K", 1)}


def test_islands_shuffle_lines_not_tokens(spark):
    """copies of a line, long lines and places beyond 64 as a window over tokens finds them."""
    rows = [(d, c, p, "a" if p % m == 0 else "x") for d, c, m, n in [(1, 0, 7, 200), (1, 1, 5, 70), (None, 2, 3, 9), (None, 3, 300, 129), (2, 4, 1, 80), (3, 5, 64, 130)] for p in range(n)]
    toks = spark.createDataFrame(rows, "d long, copy long, pos long, k string")
    found = context.islands(toks, spark.createDataFrame([("a",)], "k string"), "d", copy="copy")
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    w = Window.partitionBy("d").orderBy("pos")
    plain = toks.where("k = 'x'").withColumn("run", F.col("pos") - F.row_number().over(w)).groupBy("d", "run").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("length")).where("length >= 2").drop("run")
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert found.schema.simpleString() == plain.schema.simpleString()


def test_pages_reach_python_a_few_megabytes_at_a_time(spark):
    """long pages, pages without text and null ones; the worker's batches are bounded by bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    pages = ["<p>Bir &amp; iki</p><script>x</script><b> üç </b>" + "<i>ğ😀</i>" * n for n in (0, 1, 200_000)] + [None, "", "<style>a</style>"]
    df = spark.createDataFrame(list(enumerate(pages * 3)), "i long, html string").coalesce(1).select("i", files.html_text(F.col("html")).alias("text"))
    assert int(spark.conf.get(name)) <= 8 << 20
    assert [r.text for r in df.orderBy("i").collect()] == [files.strip_markup(p) for p in pages * 3]


def test_only_places_where_a_phrase_begins_become_rows(spark):
    """F16: phrases of unlike length, cut off by the end of a line, with gaps of their own; also a dictionary that fills the table of bits."""
    lines = spark.createDataFrame([(1, "a b c, d'x e a  b"), (2, "b c a‐b d`in"), (3, " 12 "), (4, None), (5, "A B")], "id long, ptext string")
    some = ["a b", "b c, d", "a-b", "d", "e a b c", "x y z"]
    cut = phrases.pieces(lines, "id")
    assert [(r.id, r.words, r.gaps) for r in cut.where("id < 4").orderBy("id").collect()] == [(1, ["a", "b", "c", "d", "x", "e", "a", "b"], [" ", " ", ", ", "'", " ", " ", " ", ""]), (2, ["b", "c", "a", "b", "d", "in"], [" ", " ", "-", " ", "'", ""]), (3, [], [])]
    for more in ([], [f"a{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} q" for i in range(10_000)]):
        for asked in (some, [p for p in some if p != "d"]):
            found = phrases.candidates(cut, spark.createDataFrame([(p,) for p in asked + more], "phrase string"), "id")
            want = set()
            for r in cut.where("words is not null").collect():
                for i in range(len(r.words)):
                    for n in range(1, len(r.words) - i + 1):
                        key = "".join(w + g for w, g in zip(r.words[i:i + n], r.gaps[i:i + n - 1] + [""]))
                        if key in asked:
                            want.add((r.id, i, n, key, r.words[i + n] if r.gaps[i + n - 1] == "'" and i + n < len(r.words) else None))
            assert want and {tuple(r) for r in found.collect()} == want
    plan = phrases.candidates(cut, spark.createDataFrame([("a b",)], "phrase string"), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search("inline\\(transform\\(filter\\(", plan)  # places are left out before they become rows


def test_texts_travel_not_lines(spark):
    """neighbours' lines as a full join of lines finds them, with ids that occur twice, null texts and ids, blank and missing lines."""
    rows = [(1, "a\n\nb c\n \t"), (1, "x\ny\nb\n\nz"), (1, None), (2, "a\nb\n\n\nq  r"), (2, "a\nb\n\n\nq  r"), (3, ""), (3, "\n\n\n\n\n\nlate"), (4, None), (6, "far"), (None, "n"), (None, "n"), (7, "\r\n1"), (8, "\n1\r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = compare.neighbour_lines(docs)
    assert "FullOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
    lines = paragraphs(docs, "doc_id").select(F.col("doc_id").alias("id"), "par", F.col("ptext").alias("a"))
    ids = docs.select(F.col("doc_id").alias("id")).distinct()
    both = ids.join(ids.select((F.col("id") - 1).alias("id")), "id")
    plain = lines.join(lines.select((F.col("id") - 1).alias("id"), "par", F.col("a").alias("b")), ["id", "par"], "full").join(both, "id", "left_semi")
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and plain.count() > 20
    assert found.schema.simpleString() == plain.schema.simpleString()


def test_places_become_text_once_a_group(spark):
    """the first place as text, its null parts left out, is made after the groups are."""
    ops = spark.createDataFrame([("s", "replace", "x", "y", 10, 1), ("s", "replace", "x", "y", 9, None), ("s", "insert", "", "z", 2, 3), ("s", "equal", "a", "a", 0, 0)], "source string, op string, left string, right string, at long, pos long")
    found = evaluate.diff_groups(ops, "source", "at", "pos")
    assert [(r.left, r.right, r.n, r.place) for r in found.collect()] == [("x", "y", 2, "9"), ("", "z", 1, "2:3")]
    assert "concat_ws" not in found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1].split("\n", 1)[1]
