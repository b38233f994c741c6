"""Hand cases of normal forms, lexicon cleaning, classes of differences, rules on neighbours and the readers of lexicon files."""

import pytest
from pyspark.sql import functions as F

from divit.functions import ottoman as O
from divit.operators import evaluate, lexicon
from divit.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("made, want", [
    (lambda: O.compared(F.lit("كِتَابۀ ‌گل،")), "كتابه كل"),
    (lambda: O.compared(F.lit("بدیع الزمان"), False), "بدیعالزمان"),
    (lambda: O.lexicon_form(F.lit(" «شِدّت  ەا»")), "شدّت ه‌ا"),
    (lambda: O.engine_spelling(F.lit("دەگَە")), "ده‌كه"),
    (lambda: O.izafet_blind(F.lit("خانەء")), "خانه"),
    (lambda: O.bare(F.lit(" ا‌بّ ")), "اب"),
    (lambda: O.nfkc(F.lit(" ﻻ ")), "لا"),
    (lambda: O.consonant_classes(F.lit("صلاة")), "صلت"),
    (lambda: O.consonant_classes(F.lit("قصد"), True), "كست"),
    (lambda: O.arabic_sound_key(F.lit("مهمیز")), "MHMZ"),
    (lambda: O.arabic_sound_key(F.lit("خانه"), False), "HN"),
    (lambda: O.latin_sound_key(F.lit("mahmuz")), "MHMZ"),
    (lambda: O.guarded_digits(F.lit("1911 COVID19 19a x 7")), "١٩١١ COVID19 19a x ٧"),
    (lambda: F.array_join(O.number_parts(F.lit("Onbirinci")), " "), "on birinci"),
    (lambda: O.number_parts(F.lit("birbiri")), None),
    (lambda: O.gate(F.lit("kısa")), "kısa"),
    (lambda: O.gate(F.lit(None).cast("string")), None),
])
def test_forms(spark, made, want):
    assert one(spark, made()) == want


def test_gate_rejects_long_foreign_texts(spark):
    with pytest.raises(Exception, match="not Turkish"):
        one(spark, O.gate(F.repeat(F.lit("abc "), F.lit(60).cast("int"))))


def test_cleaned_lexicon(spark):
    rows = [("Şifa", "شفاء", "ar"), ("iktifâen", "اكتفاء", "ar"), ("mahiyet", "ماهیة", "ar"), ("cümle", "جملة", "ar"), ("inam", "إنعام", "ar"), ("yavaş", "یاواش یاواش", "tr"),
            ("kerahet", "كراهت ، كراهیت", "ar"), ("as", "ؑ", "ar"), ("#x", "ا", "tr"), (None, "ا", None), ("çık", "چیق", "tr"), ("kitap", "کتاب", "ar")]
    out = lexicon.cleaned(spark.createDataFrame(rows, "k string, spelling string, origin string"), spark.createDataFrame([("çık",)], "k string"))
    assert {r.k: r.spelling for r in out.collect()} == {"şifa": "شفا", "iktifâen": "اكتفاء", "mahiyet": "ماهیت", "cümle": "جمله", "inam": "انعام", "yavaş": "یاواش", "kerahet": "كراهت", "kitap": "كتاب"}
    assert lexicon.cleaned(spark.createDataFrame([], "k string, spelling string, origin string")).count() == 0
    extra = spark.createDataFrame([("kādir", "قادر"), ("şifa", "شفا")], "k string, spelling string")
    assert [r.k for r in lexicon.absent_only(extra, out).collect()] == ["kâdir"]


def test_difference_classes(spark):
    rows = [("سنك", "سنك", None, False, False, "possessor"), ("اونڭ", "اونن", None, False, False, "possessor"), ("ات", "ایت", "ar", False, False, "variant"), ("ات", "ایت", "tr", False, False, "open"),
            ("تورلی", "دورلی", "tr", False, False, "variant"), ("تورلی", "دورلی", "ar", False, False, "meaning"), ("بر", "كر", None, False, True, "variant"), ("بر", "كر", None, True, True, "meaning"), ("بر", "كر", None, False, False, "meaning")]
    df = spark.createDataFrame(rows, "a string, b string, origin string, meaning boolean, variant boolean, want string")
    got = df.select("want", evaluate.difference_class(*(F.col(c) for c in ("a", "b", "origin", "meaning", "variant"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_rules_on_neighbours(spark):
    toks = spark.createDataFrame([(1, "at", "#", "bir", "koş", "#"), (2, "at", "#", "#", "al", "sat"), (3, "ev", "a", "b", "c", "d")], "id long, k string, l2 string, l1 string, r1 string, r2 string")
    rules = spark.createDataFrame([("at", 1, "A", [("L1", "b.r"), ("R1", "koş|yat")]), ("at", 2, "B", [("C", "sat")]), ("at", 3, "C", [("R1", ".*")])], "k string, rule int, spelling string, conditions array<struct<place:string,pattern:string>>")
    assert {(r.id, r.rule, r.spelling) for r in evaluate.matching_rules(toks, rules).collect()} == {(1, 1, "A"), (2, 2, "B")}


def test_accuracy_and_groups(spark):
    rows = spark.createDataFrame([("a", True, 3), ("a", False, 1), ("b", None, 4)], "g string, hit boolean, n long")
    got = {r.g: (r.is_total, r.types, r.accuracy) for r in evaluate.accuracy(rows, "g", "hit", "n").collect()}
    assert got == {"a": (0, 2, 0.75), "b": (0, 1, 0.0), None: (1, 3, 0.375)}
    ops = spark.createDataFrame([("s", "replace", "x", "y", 2), ("s", "replace", "x", "y", 1), ("s", "equal", "q", "q", 0), ("s", "insert", "", "z", 5)], "source string, op string, left string, right string, at long")
    assert [(r.left, r.right, r.n, r.place) for r in evaluate.diff_groups(ops, "source", "at").collect()] == [("x", "y", 2, "1"), ("", "z", 1, "5")]


def test_readers(spark, tmp_path):
    (tmp_path / "keys").write_text("# c\nBir\n\nbir\nIKI\n")
    assert {r.k for r in files.read_keys(spark, str(tmp_path / "keys")).collect()} == {"bir", "ıkı"}
    (tmp_path / "pairs").write_text("at\tآت\t3\nat-ev\tآت\t1\nev\tx\t2\nyol\tیول\tq\n")
    assert [(r.latin, r.spelling, r.n) for r in files.read_pairs(spark, str(tmp_path / "pairs")).collect()] == [("at", "آت", 3)]
    (tmp_path / "r1").write_text("At\tx\ty\nev\tq\n")
    (tmp_path / "r2").write_text("at\tz\n")
    got = {r.k: list(r.fields) for r in files.read_registry(spark, str(tmp_path / "r1"), str(tmp_path / "r2"), columns=3).collect()}
    assert got == {"at": ["z", ""], "ev": ["q", ""]}
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 3}\n')
    assert [(r.file, r.line, r.a) for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long").orderBy("line").collect()] == [("x.jsonl", 0, 1), ("x.jsonl", 1, None), ("x.jsonl", 2, 3)]
    html = '<p><span class="kelime-grup b" data-latince="kitap"><i>كتا</i>ب</span> <span>x</span><span class="kelime-grup">y</span>'
    df = spark.createDataFrame([(html,), (None,)], "h string").select(files.word_spans(F.col("h")).alias("s"))
    assert [[tuple(x) for x in r.s] for r in df.collect()] == [[("kitap", "كتاب")], []]
    df = spark.createDataFrame([('{"data": [{"a": 1}]}',), ('[{"a": 2}]',), ("x",)], "v string").select(files.payload(F.col("v"), "struct<a:long>").alias("p"))
    assert [r.p and [x.a for x in r.p] for r in df.collect()] == [[1], [2], None]
