"""Layers of claims are found once, however many plans read them."""

import re

from divit.operators import transliterate
from divit.plans import text_engine


def _cuts(df):
    return len(re.findall("regexp_extract_all", df._jdf.queryExecution().optimizedPlan().toString()))


def test_claims_of_documents_are_found_once(spark, sf):
    """before, phrases and words were looked for anew in each plan that reads them."""
    assert _cuts(text_engine.claim_layers(spark, sf)) == 0


def test_phrases_of_a_text_are_found_once(spark, monkeypatch):
    """spans of phrases and numerals are looked for once, then read."""
    held, award = [], transliterate.awarded
    monkeypatch.setattr(transliterate, "awarded", lambda layers, *line: held.extend(x for _, x in layers) or award(layers, *line))
    kind = "k string, spelling string"
    texts = spark.createDataFrame([(1, "bir iki XIV")], "id int, ptext string")
    transliterate.spelled_tokens(texts, spark.createDataFrame([("bir", "b")], kind), spark.createDataFrame([("bir iki", "x")], "phrase string, spelling string"), "id")
    assert [_cuts(x) for x in held] == [0, 0] and [x.count() for x in held] == [1, 1]
