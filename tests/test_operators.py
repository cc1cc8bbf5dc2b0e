"""Distributed operators against local brute force, leakage, plans and state rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import forest as IF
from driftline.operators import joins as J


def steps_series(seed, n):
    rng = np.random.default_rng(seed)
    level = np.repeat(rng.normal(0, 8, n // 25 + 1), 25)[:n]
    return level + rng.normal(0, 0.4, n)


@pytest.mark.parametrize("limit", [4096, 30])
def test_changepoints_distributed_equals_local(spark, limit):
    from driftline.operators.changepoints import binary_segmentation, segment_series

    data = {k: steps_series(k, 90) for k in range(2)}
    pdf = pd.concat([pd.DataFrame({"k": k, "id": np.arange(len(v)), "v": v}) for k, v in data.items()])
    df = spark.createDataFrame(pdf).withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id)"))
    got = binary_segmentation(df, "k", "ts", "v", ["id"], limit=limit).collect()
    for k, v in data.items():
        assert sorted(r["at"] for r in got if r["k"] == k) == segment_series(v - v.mean(), 5, 10.0)


@pytest.mark.parametrize("limit", [4096, 20])
def test_simplify_distributed_equals_local(spark, limit):
    from driftline.operators.simplify import kept_indices, simplify_tracks

    t = np.linspace(0, 6, 60)
    p = np.column_stack([np.cos(t), np.sin(t), 0.1 * t]) + np.random.default_rng(1).normal(0, 0.01, (60, 3))
    df = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(p)], "k long, pos long, x double, y double, z double")
    got = sorted(r["pos"] for r in simplify_tracks(df, "k", "pos", 0.05, limit).collect())
    assert got == sorted({0, 59, *kept_indices(p, 0.05)})


def test_regime_count_of_whole_series(spark):
    from driftline.operators.regimes import alarm_count, series_regime_count

    rng = np.random.default_rng(3)
    data = {k: np.cumsum(rng.normal(0, 1, 300)) + 6 * (np.arange(300) > 150) + 5 * (np.arange(300) > 40 + k) for k in range(2)}
    df = spark.createDataFrame([(k, i + 1, float(x)) for k, v in data.items() for i, x in enumerate(v)], "k long, pos long, v double")
    got = {r["k"]: r["changes"] for r in series_regime_count(df, "k", "v").collect()}
    for k, v in data.items():
        d = np.diff(v)
        base = d[:-1]
        med = np.median(base)
        sigma = max(1.4826 * np.median(np.abs(base - med)), 0.05)
        assert got[k] == alarm_count((d - med) / sigma, 0.5, 4.0, 5)


def greedy_pairs(pred, truth, tol):
    free, hits = list(truth), 0
    for p in pred:
        for j, t in enumerate(free):
            if abs(p - t) <= tol:
                free.pop(j)
                hits += 1
                break
    return hits


def greedy_gap(at, gap):
    out = []
    for x in at:
        if not out or x - out[-1] >= gap:
            out.append(x)
    return out


def test_spaced_candidates_against_greedy(spark):
    from driftline.operators.chains import spaced

    rng = np.random.default_rng(8)
    data = {1: np.arange(3000), 2: np.unique(rng.integers(0, 4000, 900)), 3: np.array([5]), 4: np.concatenate([np.arange(40), np.arange(5000, 5050)])}
    df = spark.createDataFrame([(k, int(x)) for k, v in data.items() for x in v], "k long, i long").repartition(4)
    got = {k: [] for k in data}
    for r in spaced(df, ["k"], "i", 8, size=16).collect():
        got[r["k"]].append(r["i"])
    assert {k: sorted(v) for k, v in got.items()} == {k: greedy_gap(v.tolist(), 8) for k, v in data.items()}


def test_a_million_candidates_in_one_chain(spark):
    from driftline.operators.chains import spaced

    df = spark.range(1_000_000).select(F.lit(1).alias("k"), F.col("id").alias("i")).where("i % 11 <> 3")
    got = spaced(df, ["k"], "i", 7).agg(F.count("*").alias("n"), F.sum("i").alias("s")).first()
    want = greedy_gap([i for i in range(1_000_000) if i % 11 != 3], 7)
    assert (got["n"], got["s"]) == (len(want), sum(want))


def test_matching_by_class_in_long_runs(spark):
    rng = np.random.default_rng(9)
    rows = {(c, kind): np.unique(rng.integers(0, 3000, n)) for c, kind, n in (("a", 0, 1500), ("a", 1, 1200), ("b", 0, 300), ("b", 1, 900), ("c", 1, 5))}
    mk = lambda kind: spark.createDataFrame([(1, c, int(i)) for (c, k), v in rows.items() if k == kind for i in v], "k long, c string, i long")
    r = J.match_counts(mk(0), mk(1), "k", ["c"], "i", 6).first()
    hits = sum(greedy_pairs(rows[c, 0], rows[c, 1], 6) for c in "ab")
    assert (r["tp"], r["fp"], r["fn"]) == (hits, len(rows["a", 0]) + len(rows["b", 0]) - hits, sum(len(rows[c, 1]) for c in "abc") - hits)


def test_members_of_many_segments(spark):
    from driftline.operators.segments import members

    segs = [(1, 0, 5, "x"), (1, 5, 6, "y"), (1, 9, 30, "z"), (2, 3, 4000, "w")]
    rows = spark.range(1, 4101).select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"), F.col("id").alias("pos"))
    got = members(rows, spark.createDataFrame(segs, "k int, lo long, hi long, n string"), "k", "pos", "n")
    assert got.count() == 5 + 1 + 21 + 3997
    assert sorted((r["pos"], r["n"]) for r in got.where("k = 1").collect()) == sorted((p, n) for k, lo, hi, n in segs if k == 1 for p in range(lo + 1, hi + 1))


def test_interval_matching(spark):
    rng = np.random.default_rng(4)
    p, t = np.unique(rng.integers(0, 6000, 300)), np.unique(rng.integers(0, 6000, 300))
    mk = lambda a: spark.createDataFrame([(1, int(i)) for i in a], "k long, i long")
    r = J.match_counts(mk(p), mk(t), "k", [], "i", 6).collect()[0]
    hits = greedy_pairs(p, t, 6)
    assert (r["tp"], r["fp"], r["fn"]) == (hits, len(p) - hits, len(t) - hits)


def test_forest_ranks_outliers_first(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    x[:5] += 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, f array<double>")
    forest = IF.fit(df, ["id"], "f", trees=60).cache()
    assert forest.count() == 60 and forest.agg(F.max("n_sample")).first()[0] <= 256
    top = IF.score(df, forest, "f").orderBy(F.desc("raw_score")).limit(5).collect()
    assert {r["id"] for r in top} == {0, 1, 2, 3, 4}
    again = IF.fit(df.repartition(5), ["id"], "f", trees=60)
    assert again.join(forest, ["tree", "feature", "cut"]).count() == 60


def test_folds_never_see_the_future(spark):
    from driftline.operators.training import fold_windows

    rows = [(u, f"2024-01-{d:02d} 12:00:00", d) for u in range(4) for d in range(1, 31)]
    ends = spark.createDataFrame(rows, "u long, t string, pos long").select("u", F.col("t").cast("timestamp_ntz").alias("ts"), "pos")
    cuts = spark.sql("SELECT date'2024-01-25' AS cutoff UNION ALL SELECT date'2024-01-29'")
    got = fold_windows(ends, cuts, "u", F.lit(True)).join(ends, ["u", "pos"])
    assert got.count() > 0 and got.where(F.col("ts") >= F.col("cutoff").cast("timestamp_ntz")).count() == 0
    later = ends.where("pos < 25")
    pick = lambda e: {tuple(r) for r in fold_windows(e, cuts, "u", F.lit(True)).where("cutoff = date'2024-01-25'").collect()}
    assert pick(ends) == pick(later)


def test_asof_array_and_window_forms_agree(spark, sf):
    from driftline.operators import pairs as P
    from driftline.plans.catalogue import QUERIES
    from driftline.plans.q_pairs import pair_series

    s, a = pair_series(spark, "/root/testdata/sf0.01")
    arrays = P.aligned_tails(s, a).select("suspect_id", "asset_id", F.size("sa").cast("bigint").alias("n_aligned"))
    frame = QUERIES["c2_asof_nearest"](spark, "/root/testdata/sf0.01").select("suspect_id", "asset_id", "n_aligned")
    assert arrays.exceptAll(frame).count() == 0 and frame.exceptAll(arrays).count() == 0


def test_change_rules():
    from driftline.streaming.jobs import TRANSITIONS

    assert "OPEN" in TRANSITIONS["RESOLVED"] and "ACKNOWLEDGED" not in TRANSITIONS["RESOLVED"]
    assert set(TRANSITIONS["OPEN"]) == {"ACKNOWLEDGED", "RESOLVED", "SUPPRESSED"}


def test_catalog_rejects_commercial_anchors(spark):
    from driftline.sources.catalogs import upsert

    cols = "norad_id long, name string, role string, country string, purpose string, orbit_class string"
    cat = spark.createDataFrame([(1, "A", "asset", "US", "military", "LEO")], cols)
    new = spark.createDataFrame([(1, "B", "baseline", "US", "commercial", "LEO", 1), (2, "Starlink-9", "suspect", "US", "telecom", "LEO", 2), (3, "C", "suspect", "CN", "sigint", "GEO", 3)], cols + ", seq long")
    kept, rejected = upsert(cat, new)
    assert {(r["norad_id"], r["name"]) for r in kept.collect()} == {(1, "A"), (3, "C")}
    assert {r["norad_id"] for r in rejected.collect()} == {1, 2}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["i7_page_cusum", "i8_regime_changes", "i3_fluctuation_exponent", "h12_fuse_evidence", "j2_nearest_asset"])
def test_native_operators_have_no_python_stage(spark, sf, name):
    from driftline.plans.catalogue import QUERIES

    text = plan(QUERIES[name](spark, sf))
    assert "Python" not in text and "Pandas" not in text


def test_scans_prune_and_push_down(spark, sf):
    from driftline.plans.catalogue import QUERIES

    text = plan(QUERIES["b4_past_only"](spark, sf))
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts" in text and "props" not in text


def test_no_cross_joins(spark, sf):
    from driftline.plans.catalogue import QUERIES

    for name in ("c4_theta_pairs", "j1_ring_distance", "c7_peers_on_asset", "c8_fold_assignment"):
        text = plan(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_split_falls_back_with_its_reason(spark):
    from driftline.operators.training import split_with_fallback

    rows = [(i, f"2024-01-{1 + i // 8:02d} {i % 8:02d}:00:00", int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, t string, y int").withColumn("ts", F.col("t").cast("timestamp"))
    ok = split_with_fallback(df, "ts", "y", ["id"], 0.2, 3)
    assert {r["reason"] for r in ok.collect()} == {"temporal_purge_3d"} and ok.where("part = 'test'").count() == 40
    late = df.withColumn("y", (F.col("id") >= 170).cast("int"))  # label 1 is never in the training part
    got = split_with_fallback(late, "ts", "y", ["id"], 0.2, 3)
    assert {r["reason"] for r in got.collect()} == {"random_fallback_class"}
    per = {(r["y"], r["part"]): r["count"] for r in got.groupBy("y", "part").count().collect()}
    assert per == {(0, "test"): 34, (0, "train"): 136, (1, "test"): 6, (1, "train"): 24}
    again = split_with_fallback(late.repartition(7), "ts", "y", ["id"], 0.2, 3)
    assert sorted(map(str, got.select("id", "part").collect())) == sorted(map(str, again.select("id", "part").collect()))
    few = split_with_fallback(df.where("id < 24"), "ts", "y", ["id"], 0.2, 3)
    assert {r["reason"] for r in few.collect()} == {"random_fallback_small"} and few.where("part = 'test'").count() in (4, 5, 6)


def test_macro_f1_over_the_classes_that_occur(spark):
    from driftline.plans.q_models import classifier_metrics

    rows = [(0.0, 0.0), (0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (1.0, 0.0)]
    p = spark.createDataFrame([(y, z, [0.4, 0.1, 0.4, 0.1], "x") for y, z in rows], "label double, prediction double, proba array<double>, reason string")
    got = {r["class"]: r for r in classifier_metrics(p).collect()}
    assert got["NORMAL"]["f1"] == pytest.approx(4 / 7) and got["SUSPECT"]["f1"] == 0.5 and got["ANOMALOUS"]["f1"] == got["HOSTILE"]["f1"] == 0.0
    assert got["NORMAL"]["macro_f1"] == pytest.approx((4 / 7 + 0.5 + 0.0) / 3) and got["NORMAL"]["accuracy"] == 0.5


def test_contracts_name_every_broken_rule(spark):
    from driftline.sources import contracts as CT

    rows = [(1, "asset", 0.5, 0.5, None), (None, "boss", -0.1, None, 2.0), (3, None, float("nan"), 1.0, 0.0)]
    df = spark.createDataFrame(rows, "norad_id long, role string, anomaly_score double, attention_score double, kelly_allocation double")
    good, bad = CT.quarantine(df, CT.RISK_ROW)
    assert [r["norad_id"] for r in good.collect()] == [1] and "violations" not in good.columns
    assert {r["norad_id"]: r["violations"] for r in bad.collect()} == {
        None: ["missing norad_id", "invalid role boss", "anomaly_score below 0", "missing attention_score", "kelly_allocation above 1"],
        3: ["anomaly_score above 1"],
    }
    assert CT.check(df.drop("attention_score"), CT.RISK_ROW).where("norad_id = 1").first()["violations"] == ["missing attention_score"]


def test_neighbourhood_returns_walked_edges(spark):
    from driftline.operators.graph import neighbourhood

    edges = spark.createDataFrame([("a", "b", "x", "1"), ("b", "c", "x", "2"), ("c", "d", "x", "3"), ("b", "a", "y", "4"), ("e", "a", "x", "5"), ("a", "b", "z", "6")], "src string, dst string, type string, label string")
    nodes, walked = neighbourhood(edges, spark.createDataFrame([("a",), ("c",)], "id string"), 2)
    assert {(r["start"], r["id"], r["hop"]) for r in nodes.collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("c", "c", 0), ("c", "d", 1)}
    got = {(r["start"], r["hop"], r["src"], r["dst"], r["label"]) for r in walked.collect()}
    assert got == {("a", 1, "a", "b", "1"), ("a", 1, "a", "b", "6"), ("a", 2, "b", "c", "2"), ("a", 2, "b", "a", "4"), ("c", 1, "c", "d", "3")}
