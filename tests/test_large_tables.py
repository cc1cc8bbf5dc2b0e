"""Plans and figures that must hold on larger tables."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from driftline.operators import calibration as CAL
from driftline.operators import skew
from driftline.operators import validation as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_case_targets_are_not_broadcast(spark, sf):
    """Parsed cases look like a few bytes to Spark, which sent all of them to the driver."""
    from driftline.plans.q_reports import case_folds

    folds = case_folds(spark, sf)
    for df in (folds, V.target_panels(folds, 0.3, 5), entry.QUERIES["g16_case_series"](spark, sf), entry.QUERIES["c12_nearest_fold"](spark, sf)):
        assert "BroadcastHashJoin" not in plan(df) and "SortMergeJoin" in plan(df)


def test_mirrored_ring_points_are_told_as_a_plain_search_tells_them(spark):
    """Rings of one inclination are equally close at mirrored places; rounding decides as it does in SQL."""
    import numpy as np
    from driftline.operators import pairs as P

    rows = [(1, 7350.2824, 65.01412, 172.0, 7100.2824, 65.01412, 232.0), (2, 7350.2824, 65.01412, 292.0, 7100.2824, 65.01412, 232.0), (3, 7001.5, 51.25, 10.0, 7100.0, 80.5, 190.0)]
    df = spark.createDataFrame(rows, "id long, sma double, inc double, raan double, a_sma double, a_inc double, a_raan double")
    me, it = ({c: F.col(p + n) for c, n in (("a", "sma"), ("inc", "inc"), ("raan", "raan"))} for p in ("", "a_"))
    got = {r["id"]: r for r in P.crossing(df, ["id"], me, it).collect()}
    ph = np.arange(120) * 2 * np.pi / 120

    def ring(a, i, o):
        i, o = np.radians(i), np.radians(o)
        return np.stack([a * np.cos(ph) * np.cos(o) - a * np.sin(ph) * np.cos(i) * np.sin(o), a * np.cos(ph) * np.sin(o) + a * np.sin(ph) * np.cos(i) * np.cos(o), a * np.sin(ph) * np.sin(i)])

    for key, *e in rows:
        d2 = ((ring(*e[:3])[:, :, None] - ring(*e[3:])[:, None, :]) ** 2).sum(axis=0)
        assert abs(got[key]["range_km"] - np.sqrt(d2.min())) < 1e-9
        assert d2[got[key]["i"], got[key]["j"]] - d2.min() < 1e-11


def test_closest_approach_in_time_is_hashed(spark, sf):
    """Its grid was sorted before the least distance was taken, a task's memory with it."""
    from driftline.operators import pairs as P

    e = "id long, sma double, inc double, raan double, mm double, ts timestamp"
    df = spark.createDataFrame([], e + ", " + e.split(", ", 1)[1].replace(", ", ", a_").replace("sma", "a_sma", 1))
    from driftline.plans.q_pairs import IT, ME

    assert "SortAggregate" not in plan(P.temporal_closest(df, ["id"], ME(), IT(), F.lit("2024-01-31").cast("timestamp")))


def test_nearest_rows_read_no_frame_twice(spark, sf):
    assert "unboundedfollowing" not in plan(entry.QUERIES["c2_asof_nearest"](spark, sf))


def test_two_places_are_those_of_c(spark):
    from driftline.functions.scalars import two_places

    values = [k / 200 for k in range(0, 401)] + [0.1250000001, 0.12499999, 1234567.885, -0.575, -0.125, -0.001, 999.995]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", two_places(F.col("v")).alias("t"))
    assert [(r["v"], r["t"]) for r in df.collect() if r["t"] != f"{r['v']:.2f}"] == []


def test_rows_of_few_groups_are_counted_where_they_are(spark):
    """A class of an exact quantile was sorted into one task to meet its bracket."""
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = skew.exact_quantiles(df, ["k"], "v", {"p": 0.5}, few=True)
        assert "SortMergeJoin" not in plan(q)
        assert {r["k"]: r["p"] for r in q.collect()} == {"0": 499.5, "1": 499.0, "2": 500.0}
        # What is left merges the classes' statistics.
        assert plan(CAL.calibration_table(df, "k", "v")).count("SortMergeJoin") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_objects_are_dealt_over_tasks(spark):
    """Folders of objects were written by as few tasks as their rows fill, here one."""
    import glob
    import os

    from driftline.session import scratch_path, shared_dir

    sf = scratch_path(spark, "objects")
    ts = F.lit("2024-01-01").cast("timestamp_ntz")
    spark.range(300).select(F.col("id").alias("user_id"), ts.alias("ts"), F.col("id").alias("event_id"), F.lit(1.0).alias("value")).write.parquet(f"{sf}/events.parquet")
    root = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/driftline-corpus-*"))
    assert entry.QUERIES["a24_object_csv_corpus"](spark, sf).count() == 300
    (made,) = set(glob.glob(f"{root}/driftline-corpus-*")) - before
    files = glob.glob(f"{made}/ephemeris/user_id=*/*.csv")
    assert len(files) == 300 and len({os.path.basename(f)[:10] for f in files}) == 3


def test_fold_targets_are_not_broadcast(spark, sf):
    from driftline.operators import joins as J
    from driftline.plans.inputs import events
    from driftline.plans.q_models import fold_table

    ends = events(spark, sf).select(F.col("user_id").alias("norad_id"), "ts", F.col("event_id").alias("pos"))
    assert "BroadcastHashJoin [norad_id" not in plan(J.assign_folds(fold_table(spark, sf), ends, ends, 1))


def test_typicality_shuffles_no_vectors(spark, monkeypatch):
    """Every block of vectors was shuffled once for every block of the other side."""
    import numpy as np

    from driftline.operators import typicality as T

    monkeypatch.setattr(T, "BLOCK", 16)
    z = spark.range(100).repartition(3).select(F.col("id").alias("__row"), F.col("id").cast("double").alias("v"))
    z = z.mapInPandas(lambda ps: (p.assign(z=[np.array([v, 0.0]).tobytes() for v in p["v"]])[["__row", "z"]] for p in ps), "__row long, z binary")
    blocks = T._blocks(z, 100, "blocks")
    pairs = T._Pairs(blocks, blocks, 2)
    assert "CartesianProduct" in plan(pairs.pairs) and "Exchange" not in plan(pairs.pairs)
    # Of distances 1 to 99, both ways, as every pair of blocks is looked at once.
    assert pairs.total(lambda g: np.array([(g > 0).sum(), g.sum()]), 2).tolist() == [9900, sum(2 * (100 - k) * k * k for k in range(100))]
    near = {r["__row"]: r["k"] for r in pairs.sums(lambda a, b: (np.abs(a.z[:, :1] - b.z[:, 0]) <= 1).sum(axis=1).astype(float), "k", "double").collect()}
    assert near == {i: 2.0 if i in (0, 99) else 3.0 for i in range(100)}


def test_window_and_pair_statistics_take_whole_batches():
    """Rings, position clouds, parses and alignments were worked out one row at a time."""
    import numpy as np
    import pandas as pd

    from driftline.functions import arrow as A

    rng = np.random.default_rng(5)
    e = [rng.uniform(6900, 7400, 40), rng.uniform(0, 90, 40), rng.uniform(0, 360, 40)]
    f = [rng.uniform(6900, 7400, 40), rng.uniform(0, 90, 40), rng.uniform(0, 360, 40)]

    def ring(a, inc, raan, n):
        ph, i, o = 2 * np.pi * np.arange(n) / n, np.radians(inc), np.radians(raan)
        c, s = np.cos(ph), np.sin(ph)
        return a * np.stack([c * np.cos(o) - s * np.cos(i) * np.sin(o), c * np.sin(o) + s * np.cos(i) * np.cos(o), s * np.sin(i)], axis=1)

    want = [np.sqrt(((ring(*p, 36)[:, None] - ring(*q, 18)[None]) ** 2).sum(axis=2)).min() for p, q in zip(zip(*e), zip(*f))]
    assert np.allclose(A.ring_ranges(*e, *f, 36, 18), want, atol=1e-5)
    assert np.isnan(A.ring_ranges(np.array([np.nan]), *[c[:1] for c in e[1:]], *[c[:1] for c in f], 36, 18)).all()

    a, inc, raan, ecc = rng.uniform(6900, 7400, 20), rng.uniform(0, 90, 20), rng.uniform(0, 360, 20), np.where(np.arange(20) % 2, 0.0, 0.1)
    ph, i, o = 2 * np.pi * np.arange(20) / 19, np.radians(inc), np.radians(raan)
    r = a * (1 - ecc**2) / (1 + ecc * np.cos(ph))
    c, s = r * np.cos(ph), r * np.sin(ph)
    p = np.stack([c * np.cos(o) - s * np.cos(i) * np.sin(o), c * np.sin(o) + s * np.cos(i) * np.cos(o), s * np.sin(i)], axis=1)
    p -= p.mean(axis=0)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))[np.triu_indices(20, 1)] / np.sqrt((p**2).sum(axis=1)).mean()
    h0, h1 = A.cloud_spread(*[x[None] for x in (a, inc, raan, ecc)])
    q = np.quantile(d, [0.1, 0.25, 0.75])
    assert h0[0] == pytest.approx(q[0]) and h1[0] == pytest.approx(q[2] - q[1])

    def phrases(s):
        at = n = 0
        while at < len(s):
            size = 1
            while at + size <= len(s) and s.find(s[at : at + size], 0, at + size - 1) >= 0:
                size += 1
            at, n = at + size, n + 1
        return n

    tokens = rng.integers(0, 3, (50, 19))
    assert A.parse_counts(tokens).tolist() == [phrases("".join(map(str, r))) for r in tokens]

    hour = 3600 * 10**6
    # Times so far apart that row and time do not fit one number.
    for spread in (1, 10**6):
        ta = [np.sort(rng.integers(0, 400, n)) * hour * spread for n in (0, 3, 30, 30)]
        tb = [t[::2] + hour for t in ta[:3]] + [ta[3][:0]]
        va, vb = [rng.normal(size=len(t)) for t in ta], [rng.normal(size=len(t)) for t in tb]
        at, to, n = A._matches(np.concatenate(ta), np.array([len(t) for t in ta]), np.concatenate(tb), np.array([len(t) for t in tb]), 10)
        old = A.align_nearest.func(*[pd.Series(c) for c in (ta, va, tb, vb)], pd.Series([10] * 4))
        ends = np.cumsum(n)[:-1]
        for flat, by in ((np.concatenate(va)[at], old["sa"]), (np.concatenate(vb)[to], old["sb"])):
            assert [p.tolist() for p in np.split(flat, ends)] == [list(p) for p in by]


def test_aligned_series_do_not_leave_their_batch(spark, sf):
    """Aligned arrays went through pandas twice, in batches of 10,000 pairs."""
    for name in ("i17_cross_correlation", "j6_pair_score"):
        assert "align_nearest" not in plan(entry.QUERIES[name](spark, sf))


def test_retrieval_cuts_words_once_and_counts_pairs_in_place(spark, sf):
    """Headings were cut into words for every word of their text, and pairs of sections and items were shuffled to be counted."""
    import re

    from driftline.functions.scalars import STOP_WORDS
    from driftline.sources import text as TX

    p = plan(entry.QUERIES["h9_keyword_retrieval"](spark, sf)).split("Initial Plan")[-1]
    assert "hashpartitioning(path" in p and not re.search(r"hashpartitioning\(item_id#\d+L?, path", p)
    assert p.count("regexp_extract_all(") == 3 and p.count("split(concat(") == 1  # headings, texts, items; sections

    chunks = [("a", 0, "Red fox red", "the fox and a bird"), ("a", 1, "", "red red bird"), ("b", 0, "lone", "owl"), ("b", 1, "bird", "")]
    asked = [(1, "Red BIRD the"), (2, "owl fox"), (3, "the of")]
    words = lambda t: {w for w in re.findall("[a-z0-9]{3,}", t.lower()) if w not in STOP_WORDS}
    want = set()
    for i, q in asked:
        scored = [(-len(words(h + " " + t) & words(q)) - 2 * bool(words(h) & words(q)), p, n) for p, n, h, t in chunks if words(h + " " + t) & words(q)]
        want |= {(i, p, n, -s, r) for r, (s, p, n) in enumerate(sorted(scored)[:2], 1)}
    c, q = spark.createDataFrame(chunks, "path string, n int, heading string, text string"), spark.createDataFrame(asked, "id int, text string")
    assert {tuple(r) for r in TX.retrieve_all(c, q, "id", "text", ["path", "n"], "heading", "text", 2).select("id", "path", "n", "score", "rank").collect()} == want


def test_regime_alarms_are_counted_without_a_call_for_every_piece(spark):
    """Every piece of a series was a pandas group of its own."""
    from driftline.operators.regimes import series_regime_count

    df = spark.range(200).select((F.col("id") % 2).alias("k"), (F.floor(F.col("id") / 2) + 1).alias("pos"), (F.col("id") % 13 + F.when(F.col("id") > 100, 60).otherwise(0)).cast("double").alias("v"))
    got = series_regime_count(df, "k", "v")
    assert "InPandas" not in plan(got)
    assert {r["k"] for r in got.collect()} == {0, 1}
