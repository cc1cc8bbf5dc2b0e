"""Queries look at all of their rows: every window, every asset, the whole series."""

import os

import __spark_entry__ as entry
import duckdb
import numpy as np
import pandas as pd
import pytest


def tables(sf, folder, events):
    """A folder with the tables of ``sf`` but for its events."""
    for name in os.listdir(sf):
        if name != "events.parquet":
            os.symlink(f"{sf}/{name}", folder / name)
    events.to_parquet(folder / "events.parquet", index=False)
    return str(folder)


@pytest.fixture(scope="module")
def long_series(sf, tmp_path_factory):
    """The events of four calibration objects as one object's."""
    e = pd.read_parquet(f"{sf}/events.parquet")
    e["user_id"] = e["user_id"].replace({6: 3, 9: 3, 12: 3})
    return tables(sf, tmp_path_factory.mktemp("long"), e)


def test_training_set_has_every_window(spark, long_series):
    """Every fifth window was kept, and of each object the last forty of those."""
    n = pd.read_parquet(f"{long_series}/events.parquet").groupby("user_id").size()
    assert n[3] > 20 + 5 * 40
    got = {(r["norad_id"], r["pos"]) for r in entry.QUERIES["m5_training_set"](spark, long_series).select("norad_id", "pos").collect()}
    assert got == {(u, p) for u, c in n.items() for p in range(20, c + 1)}


def test_class_probabilities_are_of_every_window(spark, sf):
    """The classifier saw every fifth window only, so no window between was ever scored."""
    p = entry.QUERIES["m8_class_probabilities"](spark, sf).select("pos").distinct().collect()
    assert {(r["pos"] - 20) % 5 for r in p} == set(range(5))


def test_fold_scores_set_every_asset_against_their_targets(spark, sf):
    """Only the first four assets were partners of a fold's target."""
    got = {r["pair_asset"] for r in entry.QUERIES["m4_fold_scores"](spark, sf).where("pair_asset IS NOT NULL").select("pair_asset").distinct().collect()}
    assert max(got) > 3


def test_coupling_is_over_the_whole_of_both_series(spark, sf, tmp_path):
    """Both series were read from the 240th row before their end only, and the last 120 matches used."""
    rng = np.random.default_rng(2)
    n = {28: 2500, 31: 300, 34: 60, 37: 14, 3: 900, 4: 25}  # suspects 28 to 37, assets 3 and 4
    u = np.repeat(list(n), list(n.values()))
    e = pd.read_parquet(f"{sf}/events.parquet").sample(len(u), replace=True, random_state=1).reset_index(drop=True)
    spans = rng.integers(0, 30 * 86_400_000, len(u))
    e = e.assign(user_id=u, event_id=np.arange(len(u)), ts=pd.Timestamp("2024-01-01") + pd.to_timedelta(spans, unit="ms"), value=np.round(rng.normal(size=len(u)), 3))
    e["ts"] = e["ts"].astype("datetime64[us]")
    d = tables(sf, tmp_path, e)
    con = duckdb.connect()
    for t in ("events", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = {(s, a): r for s, a, r in con.execute(entry.oracle_sql()["i17_cross_correlation"]).fetchall()}
    got = {(r["suspect_id"], r["asset_id"]): r["dcca"] for r in entry.QUERIES["i17_cross_correlation"](spark, d).collect()}
    assert {k for k in want if k[0] == 28} == {(28, 3), (28, 4)} and got.keys() == want.keys()
    assert [got[k] for k in want] == pytest.approx(list(want.values()), abs=1.1e-5)
