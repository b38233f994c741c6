"""near duplicates move sets in turns, and leave no table behind that nothing reads."""

import os

import corpus_pipeline as P
from divit.llm import jaccard_join, shared
from tests.llm.test_pipeline_stages import SCHEMA, rows_of


def test_near_duplicates_in_turns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows, kept = rows_of(40, seed=5), []
    for size in (10**9, 9):
        for name in ("SETS_TURN", "PAIRS_TURN", "WANTED"):
            monkeypatch.setattr(jaccard_join, name, size)
        kept.append(sorted(r.doc_id for r in P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()))
    assert kept[0] == kept[1] and len(kept[0]) < len(rows)
    left = {n.removeprefix("divit_").split("-")[0].split("_")[0] for n in os.listdir(tmp_path / "divit")}
    assert "signatures" in left and not {"windows", "open", "star", "sets", "links", "regions", "pairs", "named", "copies", "wanted", "rows"} & left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") != "true"
