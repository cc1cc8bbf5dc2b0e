"""Score distributions, thresholds and rank tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators import skew

PROBS = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def distribution(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """n, mean, population deviation, quantiles and maximum per key, of which there are few; nulls and NaN left out."""
    ok = df.where(F.col(score).isNotNull() & ~F.isnan(score)).select(*keys, score)
    q = skew.exact_quantiles(ok, keys, score, PROBS, few=True)
    m = (ok.groupBy(*keys) if keys else ok.groupBy()).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.max(score).alias("max")
    )
    if keys:
        return q.join(m, keys)
    return q.withColumn("__m", m.select(F.struct("mean", "std", "max")).scalar()).select("*", "__m.*").drop("__m")


def calibration_table(df: DataFrame, orbit: str, score: str, floor: float = 0.5) -> DataFrame:
    """Distribution and threshold per orbit class and overall (``ALL``); unknown classes are LEO."""
    cls = F.upper(F.coalesce(F.col(orbit), F.lit("UNK")))
    known = F.when(cls.isin("LEO", "MEO", "GEO"), cls).otherwise("LEO")
    both = df.select(F.explode(F.array(known, F.lit("ALL"))).alias("orbit"), F.col(score).alias("score"))
    return distribution(both, ["orbit"], "score").withColumn("thr", F.greatest(F.lit(float(floor)), F.col("p95")))


def mann_whitney_u(df: DataFrame, group: str, value: str) -> DataFrame:
    """U of group ``true`` over group ``false`` with average ranks for ties, and both sizes.

    Equal values collapse to counts first; prefix counts run bin by bin over value order, so no
    task orders the whole table. Also returns the tie term for the normal approximation.
    """
    counts = df.groupBy(value).agg(
        F.count_if(F.col(group)).alias("a"), F.count_if(~F.col(group)).alias("b")
    )
    binned = skew.value_bins(counts, value)
    per = binned.groupBy("__bin").agg(F.sum("b").alias("__b"))
    below = per.select("__bin", (F.sum("__b").over(Window.orderBy("__bin")) - F.col("__b")).alias("__below"))
    w = Window.partitionBy("__bin").orderBy(value)
    inside = F.sum("b").over(w) - F.col("b")
    # A row per bin.
    j = binned.join(F.broadcast(below), "__bin").withColumn("__lo", F.col("__below") + inside)
    t = F.col("a") + F.col("b")
    return j.agg(
        F.sum(F.col("a") * (F.col("__lo") + F.col("b") / 2)).alias("u"),
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"),
        F.sum(t * t * t - t).cast("double").alias("ties"),
    )


def exact_tail(n: int, m: int, u: int) -> float:
    """P(U >= u) for sizes n and m without ties, by counting arrangements."""
    ways = [[[0] * (n * m + 1) for _ in range(m + 1)] for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 or j == 0:
                ways[i][j][0] = 1
                continue
            for k in range(i * j + 1):
                up = ways[i - 1][j][k - j] if k >= j else 0
                ways[i][j][k] = up + ways[i][j - 1][k]
    return sum(ways[n][m][u:]) / math.comb(n + m, n)


def upper_p(n: int, m: int, u: float, ties: float, exact: bool | None = None) -> float:
    """One-sided p, exact or normal with tie and continuity correction.

    ``exact`` picks the method; left open, it is exact where one group has eight rows or fewer and no
    value is tied. With ties it is always the normal one.
    """
    if min(n, m) < 1:
        return float("nan")
    if ties == 0 and (min(n, m) <= 8 if exact is None else exact):
        return exact_tail(n, m, math.ceil(u))
    total = n + m
    var = n * m / 12.0 * (total + 1 - ties / (total * (total - 1)))
    if var <= 0:
        return 1.0
    return 0.5 * math.erfc((u - n * m / 2.0 - 0.5) / math.sqrt(var) / math.sqrt(2))


def with_p_value(u_rows: DataFrame) -> DataFrame:
    """Add ``p_value`` to ``mann_whitney_u`` rows (a handful of rows)."""

    @F.pandas_udf(T.DoubleType())
    def p(n: pd.Series, m: pd.Series, u: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([upper_p(int(a), int(b), float(c), float(d)) for a, b, c, d in zip(n, m, u, t)])

    return u_rows.withColumn("p_value", p("n_a", "n_b", "u", "ties"))
