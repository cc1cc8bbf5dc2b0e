"""Balanced building blocks equal plain per-key windows, also when one key holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.operators import skew
from driftline.operators import windows as W


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(7)
    key = np.where(rng.random(1500) < 0.6, 0, rng.integers(1, 8, 1500))
    pdf = pd.DataFrame({"k": key, "s": rng.integers(0, 40, 1500), "id": np.arange(1500), "v": rng.normal(size=1500).round(3)})
    pdf.loc[pdf["id"] % 4 == 0, "v"] = np.nan
    return spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).cache()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_positions_and_total(hot):
    got = skew.positions(hot, ["k"], ["s", "id"], F.floor(F.col("s") / 3), total="n").select("id", "pos", "n")
    w = Window.partitionBy("k")
    want = hot.select("id", F.row_number().over(w.orderBy("s", "id")).alias("pos"), F.count("*").over(w).alias("n"))
    assert rows(got, "id") == rows(want, "id")


@pytest.mark.parametrize("how,fn", [("sum", F.sum), ("min", F.min), ("max", F.max), ("last", lambda c: F.last(c, ignorenulls=True))])
def test_running(hot, how, fn):
    num = skew.positions(hot, ["k"], ["s", "id"], F.col("s"))
    got = skew.running(num, ["k"], "pos", F.col("v"), "r", how, size=16).select("id", F.round("r", 6).alias("r"))
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    want = num.select("id", F.round(fn(F.col("v")).over(w), 6).alias("r"))
    assert rows(got, "id") == rows(want, "id")


def test_halo_blocks_equal_plain_frame(hot):
    num = skew.positions(hot, ["k"], ["s", "id"], F.col("s"))
    w = skew.block_window(["k"])
    got = skew.owned(
        skew.halo_blocks(num, before=5, after=2, size=8).select("*", F.lag("id", 5).over(w).alias("a"), F.lead("id", 2).over(w).alias("b"))
    ).select("id", "a", "b")
    p = Window.partitionBy("k").orderBy("pos")
    want = num.select("id", F.lag("id", 5).over(p).alias("a"), F.lead("id", 2).over(p).alias("b"))
    assert rows(got, "id") == rows(want, "id")


@pytest.mark.parametrize("accuracy", [10000, 100])
def test_exact_quantiles(hot, accuracy):
    got = {r["k"]: r for r in skew.exact_quantiles(hot, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}, accuracy).collect()}
    pdf = hot.toPandas().dropna()
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose([got[k]["a"], got[k]["b"], got[k]["c"]], np.quantile(g["v"], [0.05, 0.5, 0.95]), atol=1e-9)


def test_curated_list_is_size_checked(spark, hot):
    small = spark.range(3).withColumnRenamed("id", "x")
    assert hot.select(F.explode(skew.curated(small, "x"))).count() == 3 * 1500
    with pytest.raises(Exception, match="exceeds 2 rows"):
        hot.select(F.explode(skew.curated(small, "x", limit=2))).collect()


def test_fill_gaps(hot):
    num = skew.positions(hot, ["k"], ["s", "id"], F.col("s"))
    got = {r["id"]: r["v"] for r in W.fill_gaps(num, ["k"], "pos", "v").collect()}
    pdf = num.toPandas().sort_values(["k", "pos"])
    want = pdf.groupby("k")["v"].transform(lambda x: x.ffill().bfill())
    assert all(abs(got[i] - v) < 1e-12 for i, v in zip(pdf["id"], want))


def test_window_end_sample_matches_spaced_ranks(spark):
    df = spark.range(1, 60).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id") - 1)).alias("r"))
    kept = df.where(W.window_end_kept(F.col("r"), F.col("n"), 10)).groupBy("n").agg(F.sort_array(F.collect_list("r")).alias("r"))
    want = spark.range(1, 60).select(F.col("id").alias("n"), F.sort_array(W.spaced_ranks(F.col("id"), 10)).alias("r"))
    assert rows(kept, "n") == rows(want, "n")
