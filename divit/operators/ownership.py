"""The nearest word before another within a few words of its clause, unless something stands between.

Clauses are cut out of paragraphs and looked at as arrays, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from divit.functions.normalize import LETTERS, turkish_lower

#: Endings of second-person possessives with a case, postpositions, owners of other persons, genitives that aren't, and what ends a clause.
POSSESSED = "^(?:.*[bcçdfgğhjklmnprsştvyz])[ıiuü]n(?:ı|i|u|ü|a|e|da|de|ta|te|dan|den|tan|ten|ın|in|un|ün|daki|deki|dır|dir)$"
POSTPOSITIONS = ("için", "gibi", "kadar", "ile", "göre", "karşı", "dolayı", "rağmen", "üzere", "nazaran", "ancak", "değil")
OWNERS = ("onun", "bunun", "şunun", "kendi", "onların", "bunların", "benim", "bizim")
GENITIVE, NO_GENITIVE = "(?:[’'][ıiuü]?n|[ıiuü]n|n[ıiuü]n)$", ("senin", "benin", "için", "bin", "din", "ben")
CLAUSE_END = "[.!?;:,\\n]"
_TOKEN = f"[{LETTERS}]+(?:[’'‘][{LETTERS}]+)*"


def clauses(paragraphs: DataFrame, *keep: str, text: str = "ptext") -> DataFrame:
    """keep, clause (from 0, empty ones counted), keys: the lower-cased words of each clause that has any."""
    cut = paragraphs.select(*keep, F.posexplode(F.split(F.col(text), CLAUSE_END, -1)).alias("clause", "_c"))
    return cut.select(*keep, "clause", F.transform(F.regexp_extract_all("_c", F.lit(_TOKEN), F.lit(0)), turkish_lower).alias("keys")).where(F.size("keys") > 0)


def nearest_owner(cut: DataFrame, *keep: str, target: Callable[[Column], Column], owner: Callable[[Column], Column], blocker: Callable[[Column], Column], turned: Callable[[Column], Column], reach: int = 6) -> DataFrame:
    """keep, clause, pos, k, owner_pos: targets whose nearest owner or blocker among the `reach` words before them in the clause is an owner.

    An owner that the next word turns to itself (a postposition) isn't the target's, unless that word is the target. The conditions are functions of a word's key.
    Clauses without such a target, and null keys, give no row.
    """

    def at(k: Column, i: Column) -> Column:
        low = F.greatest(i - reach, F.lit(0))
        before = F.slice("keys", low + 1, i - low)
        last = F.aggregate(F.transform(before, lambda w, j: F.when(owner(w) | blocker(w), low + j)), F.lit(-1), lambda best, j: F.coalesce(j, best))
        return F.struct(i.alias("pos"), k.alias("k"), last.alias("owner_pos"))

    found = cut.select(*keep, "clause", "keys", F.inline(F.filter(F.transform("keys", at), lambda s: target(s["k"]) & (s["owner_pos"] >= 0))))
    mine = owner(F.get("keys", F.col("owner_pos"))) & ~((F.col("owner_pos") + 1 < F.col("pos")) & turned(F.get("keys", F.col("owner_pos") + 1)))
    return found.where(mine).select(*keep, "clause", "pos", "k", "owner_pos")


def second_person(paragraphs: DataFrame, *keep: str, text: str = "ptext") -> DataFrame:
    """keep, clause, pos, k, owner_pos: words whose possessive is that of "senin" up to six words before them.

    Another owner, a genitive, or another word of the same shape in between takes the possessive away; so does a postposition right after "senin".
    """
    possessed = lambda k: k.rlike(POSSESSED)
    return nearest_owner(clauses(paragraphs, *keep, text=text), *keep, target=possessed, owner=lambda k: k == "senin", turned=lambda k: k.isin(*POSTPOSITIONS),
                         blocker=lambda k: k.isin(*OWNERS) | (k.rlike(GENITIVE) & ~k.isin(*NO_GENITIVE)) | possessed(k))
