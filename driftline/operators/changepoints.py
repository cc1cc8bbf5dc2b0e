"""Offline change points by binary segmentation, all entities at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators import skew
from driftline.operators.segments import LOCAL_ROWS, members, split_rounds
from driftline.operators.windows import numbered
from driftline.session import materialize


def _cost(n: np.ndarray, var: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where((n < 2) | (var <= 0), 0.0, n * np.log(var))


def segment_series(x: np.ndarray, min_size: int, pen: float) -> list[int]:
    """Accepted split indices of one bounded segment."""
    c1 = np.concatenate([[0.0], np.cumsum(x)])
    c2 = np.concatenate([[0.0], np.cumsum(x * x)])
    out, stack = [], [(0, len(x))]
    while stack:
        lo, hi = stack.pop()
        n = hi - lo
        if n < 2 * min_size:
            continue
        i = np.arange(lo + min_size, hi - min_size + 1)
        stats = lambda a, b: ((c1[b] - c1[a]) / (b - a), (c2[b] - c2[a]) / (b - a) - ((c1[b] - c1[a]) / (b - a)) ** 2)
        m, v = stats(np.array(lo), np.array(hi))
        if v <= 1e-15:
            continue
        (ml, vl), (mr, vr) = stats(lo, i), stats(i, hi)
        k = int(((i - lo) * (ml - m) ** 2 + (hi - i) * (mr - m) ** 2).argmax())
        gain = _cost(n, v) - _cost(i[k] - lo, vl[k]) - _cost(hi - i[k], vr[k])
        if gain >= pen:
            out.append(int(i[k]))
            stack += [(lo, int(i[k])), (int(i[k]), hi)]
    return sorted(out)


def _distributed_split(min_size: int, pen: float, key: str):
    """Best split of every large segment from prefix sums joined at its ends."""

    def run(rows: DataFrame, seg: DataFrame) -> DataFrame:
        at = lambda side, tag: rows.select(
            key, F.col("pos").alias(side), F.col("s1").alias(f"{tag}1"), F.col("s2").alias(f"{tag}2")
        )
        edges = seg.join(at("hi", "b"), [key, "hi"]).join(at("lo", "a"), [key, "lo"], "left").fillna(0.0, ["a1", "a2"])
        n, nl = F.col("hi") - F.col("lo"), F.col("pos") - F.col("lo")
        mean = lambda u, v, k: (F.col(v) - F.col(u)) / k
        m, ml, mr = mean("a1", "b1", n), mean("a1", "s1", nl), mean("s1", "b1", n - nl)
        gain = nl * (ml - m) * (ml - m) + (n - nl) * (mr - m) * (mr - m)
        inside = (F.col("pos") >= F.col("lo") + min_size) & (F.col("pos") <= F.col("hi") - min_size)
        best = (
            members(rows, edges, key, "pos", "a1", "a2", "b1", "b2").where(inside)
            .groupBy(key, "lo", "hi", "a1", "a2", "b1", "b2")
            .agg(F.max(F.struct(gain.alias("g"), (-F.col("pos")).alias("np"), "s1", "s2")).alias("p"))
        )

        def cost(k, u1, u2):
            v = u2 / k - (u1 / k) * (u1 / k)
            return F.when((k < 2) | (v <= 0), 0.0).otherwise(k * F.ln(v))

        cut = -F.col("p.np")
        whole = cost(n, F.col("b1") - F.col("a1"), F.col("b2") - F.col("a2"))
        left = cost(cut - F.col("lo"), F.col("p.s1") - F.col("a1"), F.col("p.s2") - F.col("a2"))
        right = cost(F.col("hi") - cut, F.col("b1") - F.col("p.s1"), F.col("b2") - F.col("p.s2"))
        return best.where(whole - left - right >= pen).select(key, "lo", "hi", cut.alias("at"))

    return run


def binary_segmentation(
    df: DataFrame, key: str, ts: str, value: str, tie: Sequence[str] = (), min_size: int = 5, pen: float = 10.0,
    limit: int = LOCAL_ROWS,
) -> DataFrame:
    """Change points per entity: position of the last row before each change.

    Output: ``key``, ``at``. Values are centred per entity before any squared sums.
    """
    rows = numbered(df.select(key, ts, *tie, value), key, ts, tie)
    centre = df.groupBy(key).agg(F.avg(value).alias("__m"))
    x = materialize(rows.join(centre, key).select(key, "pos", (F.col(value) - F.col("__m")).alias("x")), "series")
    whole = x.groupBy(key).agg(F.lit(0).cast("bigint").alias("lo"), F.max("pos").alias("hi"))
    sums = skew.running(x, [key], "pos", F.col("x"), "s1")
    sums = skew.running(sums, [key], "pos", F.col("x") * F.col("x"), "s2")
    small, found = split_rounds(sums, whole, key, _distributed_split(min_size, pen, key), limit)

    schema = T.StructType([x.schema[key], T.StructField("at", T.LongType())])

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        cuts = segment_series(pdf["x"].to_numpy(), min_size, pen)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(cuts), "at": [int(pdf["lo"].iloc[0]) + c for c in cuts]})

    member = members(x, small, key, "pos")
    out = member.groupBy(key, "lo").applyInPandas(local, schema)
    return out if found is None else out.unionByName(found)
