"""Copies of vectors that the subspace join makes are small and lose nothing."""

import numpy as np

from divit.llm import subspace_dedup
from divit.llm.subspace_dedup import near_duplicate_vectors


def test_vectors_travel_in_half_the_bytes_where_that_is_exact():
    short = np.float32([0.1, -2.5, 3e-40, 7.0]).astype(np.float64)
    long = np.array([0.1, 1e300, 1 / 3, -7.0])
    assert len(subspace_dedup._packed(short)) == 16 and len(subspace_dedup._packed(long)) == 32
    assert (subspace_dedup._unpacked([subspace_dedup._packed(v) for v in (short, long)], 4) == np.stack([short, long])).all()


def test_links_in_hot_cells_of_mixed_precision(spark, monkeypatch):
    monkeypatch.setattr(subspace_dedup, "CELL", 8)
    r = np.random.default_rng(5)
    base = r.standard_normal((6, 16))
    rows = base[r.integers(0, 6, 90)] + 0.12 * r.standard_normal((90, 16))
    rows[::2] = rows[::2].astype(np.float32)
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    near = unit @ unit.T >= 0.93
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(rows)], "vec_id long, label long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in near_duplicate_vectors(df).collect()}
    assert got == {i: int(near[i].sum()) - 1 for i in range(90)}
