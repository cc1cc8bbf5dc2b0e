"""Typicality against the whole reference set, in blocks."""

import numpy as np
import pytest

from driftline.operators import typicality as T


@pytest.mark.parametrize("block_rows", [2048, 200])
def test_every_row_is_reference(spark, monkeypatch, block_rows):
    monkeypatch.setattr(T, "BLOCK", block_rows)
    x = np.random.default_rng(3).normal(size=(700, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    got = {r["id"]: (r["typicality"], r["mmd_stat"]) for r in T.typicality(df, "id", "x", 4).collect()}
    t, s = T._Reference(x).score(x)
    assert sorted(got) == list(range(700))
    assert [got[i][1] for i in range(700)] == pytest.approx(s.tolist(), abs=1e-8)
    # A rank may move by one where two sums are as near as the rounding of the kernel's scale.
    assert [got[i][0] for i in range(700)] == pytest.approx(t.tolist(), abs=1.01 / 701)


def test_rows_against_another_reference(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 64)
    rng = np.random.default_rng(4)
    ref, x = rng.normal(size=(150, 3)), np.concatenate([rng.normal(size=(80, 3)), rng.normal(size=(5, 3)) + 9])
    mk = lambda m: spark.createDataFrame([(i % 7, i, v.tolist()) for i, v in enumerate(m)], "a long, b long, x array<double>")
    got = {r["b"]: (r["typicality"], r["mmd_stat"]) for r in T.typicality(mk(x), ["a", "b"], "x", 3, mk(ref).select("x")).collect()}
    t, s = T._Reference(ref).score(x)
    assert [got[i][1] for i in range(85)] == pytest.approx(s.tolist(), abs=1e-8)
    assert [got[i][0] for i in range(85)] == pytest.approx(t.tolist(), abs=1.01 / 151)
    assert min(got[i][0] for i in range(80, 85)) > 0.99
    assert T.typicality(mk(x), "b", "x", 3, mk(ref).select("x").limit(2)).agg({"typicality": "max"}).first()[0] == 0.5


@pytest.mark.parametrize("margin", [0.03, 1e-9])
def test_median_is_bracketed_by_a_sample_and_exact(spark, monkeypatch, margin):
    """All distances were told apart in three passes; a bracket that misses falls back to them."""
    monkeypatch.setattr(T, "BLOCK", 100)
    monkeypatch.setattr(T, "SAMPLE_ROWS", 150)
    monkeypatch.setattr(T, "MARGIN", margin)
    x = np.random.default_rng(6).normal(size=(600, 4))
    x[:5] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    got = {r["id"]: (r["typicality"], r["mmd_stat"]) for r in T.typicality(df, "id", "x", 4).collect()}
    t, s = T._Reference(x).score(x)
    assert [got[i][1] for i in range(600)] == pytest.approx(s.tolist(), abs=1e-8)
    assert [got[i][0] for i in range(600)] == pytest.approx(t.tolist(), abs=1.01 / 601)
