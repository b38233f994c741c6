"""Normalising projections as Column expressions: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of a word, and a word with inner apostrophes.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſ"
WORD = f"[{LETTERS}]+(?:['’][{LETTERS}]+)*"

#: Circumflexed vowels and their plain forms, Eastern digits, vowels that a skeleton leaves out.
CIRCUMFLEX = ("âîûÂÎÛ", "aiuAIU")
EASTERN = ("0123456789", "٠١٢٣٤٥٦٧٨٩")
VOWELS = "aeıioöuüâîûàáäèéêëíóôùúœæ"


def turkish_lower(c: Column) -> Column:
    """Lower case in which I becomes dotless and İ dotted.

    replace() searches bytes and leaves most strings as they are; translate() would look up each letter in a map.
    """
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("I"), F.lit("ı")))


def flat(c: Column) -> Column:
    """Without circumflexes."""
    return F.translate(c, *CIRCUMFLEX)


def no_apostrophe(c: Column) -> Column:
    return F.translate(c, "'’", "")


def squeeze(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, "[ \\t\\r\\n]+", " "))


def skeleton(c: Column) -> Column:
    """Consonants only; apostrophes go too."""
    return F.translate(c, VOWELS + "'’", "")


def eastern_digits(c: Column) -> Column:
    return F.translate(c, *EASTERN)


def ottoman_punctuation(c: Column) -> Column:
    """Latin comma, semicolon and question mark to the Arabic ones; commas between digits stay."""
    marked = F.regexp_replace(c, "([0-9]),([0-9])", "$1\u0001$2")
    marked = F.regexp_replace(marked, "([0-9]),([0-9])", "$1\u0001$2")
    return F.translate(F.translate(marked, ",;?", "،؛؟"), "\u0001", ",")


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def format_of(path: Column) -> Column:
    """The lower-cased extension of a path; unknown ones raise an error."""
    ext = F.lower(F.regexp_extract(path, "\\.[^./]+$", 0))
    return F.when(ext.isin(".pdf", ".txt", ".epub", ".png", ".jpg", ".jpeg"), ext).otherwise(F.raise_error(F.concat(F.lit("unsupported format "), ext)))


#: Numerals up to twenty.
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10, "XI": 11, "XII": 12, "XIII": 13, "XIV": 14, "XV": 15, "XVI": 16, "XVII": 17, "XVIII": 18, "XIX": 19, "XX": 20}


def roman_number(c: Column) -> Column:
    """The value of a numeral I to XX, else null."""
    return F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])[c]
