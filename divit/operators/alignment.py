"""How well a Latin spelling fits one in Arabic script: a weighted alignment, and suggestions for unknown words by it.

Candidates share a phonetic key, so pairs come from an equi-join. Their costs are computed in Arrow batches: one dynamic programme runs over a whole block of pairs at once, cell by
cell, with the letter classes as tables of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from divit.functions.ottoman import arabic_sound_key, latin_sound_key

#: Letters in Arabic script that may stand for a consonant, for a long and for a short vowel.
CONSONANT = {"b": "بپ", "c": "جچ", "ç": "چج", "d": "دضذط", "f": "ف", "g": "گغكق", "ğ": "غگكی", "h": "حهخ", "j": "ژج", "k": "كقگ", "l": "ل", "m": "م", "n": "نڭ", "p": "پب", "r": "ر", "s": "سصث", "ş": "ش", "t": "تطثدة", "v": "و", "y": "ی", "z": "زذضظ"}
LONG = {"â": "اآ", "î": "ی", "û": "و"}
SHORT = {"a": "اآ", "e": "", "ı": "ی", "i": "یئ", "u": "و", "ü": "و", "o": "و", "ö": "و"}
FREE, HALF = "عءئؤأ", "اویآ"

_LATIN = {c: i + 1 for i, c in enumerate("abcçdefgğhıijklmnoöprsştuüvyzâîû")}
_ARABIC = {c: i + 1 for i, c in enumerate("ابپتثجچحخدذرزژسشصضطظعغفقكگڭلمنوهیآأإئؤءة")}
_NL, _NA = len(_LATIN) + 2, len(_ARABIC) + 2  # 0 is padding, the last code any other letter


def _codes(values: list[str], table: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(v) for v in values], np.int64)
    out = np.zeros((len(values), int(size.max(initial=0)) + 1), np.int16)
    for i, v in enumerate(values):
        out[i, : len(v)] = [table.get(c, len(table) + 1) for c in v]
    return out, size


def _set(letters: str, table: dict[str, int], n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[[table[c] for c in letters]] = True
    return out


def _pairs(classes: dict[str, str]) -> np.ndarray:
    out = np.zeros((_NL, _NA), bool)
    for c, letters in classes.items():
        out[_LATIN[c], [_ARABIC[a] for a in letters]] = True
    return out


_FITS, _VOWEL_FITS = _pairs(CONSONANT), _pairs(LONG) | _pairs(SHORT)
_SHORT, _VOWEL, _LONG = _set("".join(SHORT), _LATIN, _NL), _set("".join(SHORT) + "âîû", _LATIN, _NL), _set("âîû", _LATIN, _NL)
_FREE, _HALF = _set(FREE, _ARABIC, _NA), _set(HALF, _ARABIC, _NA)


def costs(latin: list[str], arabic: list[str]) -> np.ndarray:
    """The cost of aligning each pair: 0 for letters that may stand for one another, inner short vowels and hamzas; 1 or 2 for others left over.

    A doubled consonant may be one letter. At a word's beginning a vowel may be alef or ayn, at its end a and e may be he or ye. Costs never exceed 99.
    """
    x, n = _codes(latin, _LATIN)
    y, m = _codes(arabic, _ARABIC)
    rows, wide, high = len(n), x.shape[1] - 1, y.shape[1] - 1
    d = np.full((wide + 3, high + 2, rows), 99.0)
    d[0, 0] = 0.0
    alef, lam, dal, ye = (_ARABIC[c] for c in "الدی")
    on_alef, on_head, on_he = _set("اآ", _ARABIC, _NA), _set("اآع", _ARABIC, _NA), _set("هة", _ARABIC, _NA)
    t, e, i_, y_ = (_LATIN[c] for c in "teiy")
    aeâ, ae = _set("aeâ", _LATIN, _NL), _set("ae", _LATIN, _NL)
    for i in range(wide + 1):
        c, inside, last = x[:, i] if i < wide else np.zeros(rows, np.int16), i < n, i == n - 1
        doubled = inside & (i + 1 < n) & (x[:, min(i + 1, wide)] == c) & ~_VOWEL[c]
        skip = np.select([_SHORT[c] & ((i == 0) | last), _SHORT[c], (c == y_) & (x[:, i - 1] == i_) if i else np.zeros(rows, bool), _LONG[c]], [1.0, 0.0, 0.0, 1.0], 2.0)
        for j in range(high + 1):
            v, a = d[i, j], y[:, j]
            there, final = j < m, j == m - 1
            ok = _FITS[c, a] & ~((c == t) & (a == dal) & ~last)
            ok |= aeâ[c] & (a == ye) & final & last
            if i == 0:
                ok |= (c == e) & on_alef[a]
                if j <= 1:
                    ok |= _VOWEL[c] & on_head[a]
            ok |= _VOWEL_FITS[c, a] | (ae[c] & on_he[a] & final)
            ok &= inside & there
            d[i + 1, j + 1] = np.where(ok, np.minimum(d[i + 1, j + 1], v), d[i + 1, j + 1])
            d[i + 2, j + 1] = np.where(ok & doubled, np.minimum(d[i + 2, j + 1], v), d[i + 2, j + 1])
            d[i + 1, j] = np.where(inside, np.minimum(d[i + 1, j], v + skip), d[i + 1, j])
            after_alef = y[:, j - 1] == alef if j else np.zeros(rows, bool)
            more = np.select([_FREE[a], (a == alef) & (i == 0) & (j == 0), _HALF[a], (a == lam) & after_alef], [0.0, 0.0, 1.0, 0.0], 2.0)
            d[i, j + 1] = np.where(there, np.minimum(d[i, j + 1], v + more), d[i, j + 1])
    return np.minimum(d[n, m, np.arange(rows)], 99.0)


@F.pandas_udf(DoubleType())
def alignment_cost(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """costs() of two string columns; null where one of them is."""
    for latin, arabic in parts:
        known = latin.notna() & arabic.notna()
        out = pd.Series(np.nan, index=latin.index).astype("Float64")
        if known.any():
            out[known] = costs(latin[known].tolist(), arabic[known].tolist())
        yield out


_V = "aeıiuüâîû"


def veto(k: Column, y: Column) -> Column:
    """Why a spelling isn't taken for a word, or null: the first veto that holds."""
    yn = F.translate(y, "يى", "یی")
    double = k.rlike(f"[{_V}]{{2}}")
    many = lambda c, letters: F.length(c) - F.length(F.translate(c, letters, ""))
    return (
        F.when(F.substring(y, 2, 99_999).rlike("[عءأئؤ].") & ~double, "inner ayn")
        .when(k.rlike(f"([bcdfghjklmnprsştvyz])\\1a[^{_V}]$") & ~F.right(y, F.lit(3)).contains("ا"), "unwritten long a")
        .when(k.rlike("^k[aıu]") & y.startswith("ك"), "front k").when(k.contains("g") & ~y.rlike("[غگ]"), "no g").when(y.startswith("ال"), "article")
        .when(k.rlike("[ae]$") & ~y.rlike("[هةاءیيىع]$"), "unwritten end").when(k.endswith("e") & ~y.rlike("[هة]$"), "end without he")
        .when(k.rlike("[ae][âîû]") & ~y.rlike("[عآ]"), "no ayn between").when(~k.rlike("^[aeıioöuüâîû]") & y.rlike("^[اأآإع]"), "alef before a consonant")
        .when(y.rlike("^[اأآ][عء]"), "alef and ayn").when(k.contains("iy") & ~yn.contains("ی"), "no ye").when(k.rlike("iy+[ae]t$") & ~yn.rlike("ی[تة]$"), "-iyet")
        .when((many(k, "î") > many(yn, "ی")) | (many(k, "û") > many(yn, "و")) | (many(k, "â") > many(yn, "اآیأ")), "unwritten long vowel")
        .when(k.rlike("iy+e$") & ~yn.rlike("ی[هة]$"), "-iye").when(double & ~y.rlike("[عءأئؤ]"), "no ayn between vowels")
    )


def suggestions(words: DataFrame, entries: DataFrame, best: int = 3, most: float = 1.0) -> DataFrame:
    """(k, entry, n, cost, score, rank): for each word the `best` entries (entry, n) of its phonetic key that cost less than `most`, by the logarithm of n less three times the cost.

    Keys of fewer than two letters say too little and match nothing. Ties go to the greater n, then the greater entry. Null words and entries, and entries without occurrences, take no part;
    repeated words give one result, and of repeated entries the sum of n counts.
    """
    left = words.select("k").where("k is not null").distinct().withColumn("key", latin_sound_key(F.col("k"))).where("length(key) >= 2")
    right = entries.where("entry is not null and n > 0").groupBy("entry").agg(F.sum("n").alias("n"))
    key = arabic_sound_key(F.col("entry"))
    keys = F.array_distinct(F.array(key, F.when(F.col("entry").endswith("ه"), arabic_sound_key(F.col("entry"), False)).when(F.col("entry").endswith("ة"), F.concat(key, F.lit("D"))).otherwise(key)))
    right = right.withColumn("key", F.explode(keys))  # a final he may be a vowel, a final ta marbuta a t
    pairs = left.join(right, "key").select("k", "entry", "n").withColumn("cost", alignment_cost("k", "entry")).where(F.col("cost") < most)
    pairs = pairs.withColumn("score", F.log("n") - 3 * F.col("cost"))
    order = Window.partitionBy("k").orderBy(F.desc("score"), F.desc("n"), F.desc("entry"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("k", "entry", "n", "cost", "score", "rank")


def accepted(found: DataFrame, least: int = 100) -> DataFrame:
    """(k, entry, n): for each word its first suggestion of `least` occurrences or more that no veto meets."""
    ok = found.where(F.col("n") >= least).where(veto(F.col("k"), F.col("entry")).isNull())
    return ok.groupBy("k").agg(F.min_by(F.struct("entry", "n"), "rank").alias("b")).select("k", "b.entry", "b.n")
