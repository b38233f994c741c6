import zipfile

from pyspark.sql import functions as F

from divit.functions import normalize as N
from divit.operators import compare, context, lexicon, vocabulary
from divit.operators.text import paragraphs, tokens
from divit.sources import files
from divit.streaming.arrivals import run_arrivals


def one(spark, c, value):
    return spark.createDataFrame([(value,)], "v string").select(c(F.col("v"))).first()[0]


def test_normalizers(spark):
    assert one(spark, N.turkish_lower, "IĞDIR İzmir") == "ığdır izmir"
    assert one(spark, N.flat, "kâr û") == "kar u"
    assert one(spark, N.ottoman_punctuation, "1,2,3, a; b?") == "1,2,3، a؛ b؟"
    assert one(spark, N.eastern_digits, "a07") == "a٠٧"
    assert one(spark, N.html_escape, "<a&b>") == "&lt;a&amp;b&gt;"
    assert one(spark, N.roman_number, "XIV") == 14 and one(spark, N.roman_number, "IIX") is None
    assert one(spark, N.flat, None) is None
    assert one(spark, N.format_of, "/x/A.PDF") == ".pdf"


def test_tokens_and_edges(spark):
    df = spark.createDataFrame([(1, "Ali'nin evi\n \n  İki"), (2, None), (3, "")], "id long, text string")
    assert paragraphs(df, "id").count() == 2
    rows = {(r.par, r.pos): r for r in tokens(df, "id", around=1).collect()}
    assert rows[0, 0].w == "Ali'nin" and rows[0, 0].l1 == "#" and rows[0, 0].r1 == "evi"
    assert rows[2, 0].k == "iki" and rows[2, 0].r1 == "#"


def test_majority_ties_and_thresholds(spark):
    pairs = spark.createDataFrame([("a", "A", 7), ("a", "a", 3), ("b", "b", 2), ("c", "C", 2), ("c", "c", 2)], "k string, w string, n long")
    assert [r.spelling for r in vocabulary.majority(pairs).collect()] == ["A"]
    assert [r.k for r in vocabulary.ambiguous(pairs).collect()] == ["a"]
    assert vocabulary.majority(pairs.limit(0)).count() == 0


def test_lexicon(spark):
    a = spark.createDataFrame([("x", "1")], "k string, spelling string")
    b = spark.createDataFrame([("x", "2"), ("kâr", "3")], "k string, spelling string")
    assert {(r.k, r.spelling) for r in lexicon.prioritized(a, b).collect()} == {("x", "2"), ("kâr", "3")}  # the later lexicon wins
    words = spark.createDataFrame([("kar",), ("x",), ("yok",)], "k string")
    assert {(r.k, r.how) for r in lexicon.exact_or_flat(words, b).collect()} == {("kar", "flat"), ("x", "exact"), ("yok", "none")}
    roots = spark.createDataFrame([("kita",), ("kitap",)], "k string")
    assert lexicon.longest_prefix(spark.createDataFrame([("kitaplar",)], "k string"), roots).first()[1:] == ("kitap", "lar")


def test_held_out_and_islands(spark):
    c = spark.createDataFrame([("k", "s1", 3), ("k", "s2", 4)], "k string, source string, n long")
    assert {r.source: r.others for r in context.held_out(c, ["k"]).collect()} == {"s1": 4, "s2": 3}
    toks = spark.createDataFrame([(1, p, k) for p, k in enumerate("xyaxbyx")], "d long, pos long, k string")
    found = context.islands(toks, spark.createDataFrame([("a",), ("b",)], "k string"), "d").collect()
    assert {(r.first_pos, r.length) for r in found} == {(0, 2), (5, 2)}


def test_align(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c", "d"]), (2, None, [])], "id long, a array<string>, b array<string>")
    assert [tuple(r)[1:] for r in compare.align(df).orderBy("left_pos", "right_pos").collect()] == [("equal", 0, 0, "a", "a"), ("replace", 1, 1, "b", "x"), ("equal", 2, 2, "c", "c"), ("insert", 3, 3, "", "d")]


def test_align_tokens_takes_every_line(spark, tmp_path):
    from divit.plans.catalogue import QUERIES

    spark.createDataFrame([(1, "\na b\nc"), (2, "\na x"), (4, "z")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["align_tokens"](spark, str(tmp_path)).orderBy("id", "par", "left_pos").collect()
    assert [(r.id, r.par, r.op, r.left, r.right) for r in rows] == [(1, 1, "equal", "a", "a"), (1, 1, "replace", "b", "x"), (1, 2, "delete", "c", "")]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok\xff end")
    assert files.read_txt(spark, str(tmp_path / "a.txt")).first().text == "ok end"
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("1.xhtml", "<p>One &amp; two</p><script>no</script>")
    assert files.read_epub(spark, str(tmp_path / "b.epub")).first().text == "One & two"
    (tmp_path / "l.tsv").write_text("# note\nev\tأو\tx\nshort\n\ty\n")
    assert [r.k for r in files.read_lexicon(spark, str(tmp_path / "l.tsv")).collect()] == ["ev"]


def test_arrivals(spark, tmp_path):
    spark.createDataFrame([("Bir İki",)], "text string").write.parquet(str(tmp_path / "in"))
    q = run_arrivals(spark, str(tmp_path / "in"), "text string", tokens, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_bayes_choice_by_hand(spark):
    import math

    model = spark.createDataFrame([("k", "a", "x", "#", "#", "#", 3), ("k", "b", "y", "#", "#", "#", 2)], "k string, w string, l1 string, r1 string, l2 string, r2 string, n long")
    first = spark.createDataFrame([("k", "a")], "k string, first string")
    seen = spark.createDataFrame([("k", "y", "#", "#", "#"), ("k", "x", "#", "#", "#"), ("k", "z", "#", "#", "#"), (None, "x", "#", "#", "#")], "k string, l1 string, r1 string, l2 string, r2 string")
    got = {r.l1: r for r in context.bayes_choice(seen, model, first, real=True).collect()}
    score = lambda n, side, f: math.log(n / 5) + math.log((side + 0.1) / (n + 5)) + 3 * math.log((f + 0.1) / (n + 5))
    assert set(got) == {"x", "y", "z"}
    assert (got["y"].chosen, got["y"].evidence) == ("b", 2) and abs(got["y"].margin - (score(2, 2, 2) - score(3, 0, 3))) < 2e-6
    assert (got["x"].chosen, got["x"].margin, got["x"].evidence) == ("a", 0.0, 3)
    assert got["z"].evidence == 0  # edges of lines are no evidence
    assert context.bayes_choice(seen.limit(0), model, first).count() == 0


def test_threshold_outcomes_and_pick(spark):
    around = ("x", "#", "#", "#")
    spots = spark.createDataFrame([("k", "s1", *around, "b", 4), ("k", "s1", *around, "a", 1), ("j", "s1", *around, "b", 3)], "k string, source string, l1 string, r1 string, l2 string, r2 string, w string, n long")
    choices = spark.createDataFrame([("k", "s1", *around, "a", "b", 2.5, 2), ("j", "s1", *around, "a", "b", 1.5, 9)],
                                    "k string, source string, l1 string, r1 string, l2 string, r2 string, first string, chosen string, margin double, evidence long")
    per = context.threshold_outcomes(spots, choices, "source")
    got = {(r.threshold, r.k, r.outcome): r.n for r in per.collect()}
    assert got[2.0, "k", "fixed"] == 4 and got[2.0, "k", "broken"] == 1 and got[3.0, "k", "kept_wrong"] == 4 and got[3.0, "k", "kept_right"] == 1
    assert got[1.0, "j", "fixed"] == 3 and got[2.0, "j", "kept_wrong"] == 3
    picked = {r.threshold: (r.words, r.fixed, r.picked) for r in context.threshold_pick(per).collect()}
    assert picked == {1.0: (1, 3, True), 2.0: (0, 0, False), 3.0: (0, 0, False), 4.0: (0, 0, False), 5.0: (0, 0, False)}
