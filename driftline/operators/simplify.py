"""Polyline simplification (farthest-point splitting) for many tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.segments import LOCAL_ROWS, members, split_rounds
from driftline.session import materialize


def chord_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each point to the line through a and b (to a when they coincide)."""
    d = b - a
    l2 = float(d @ d)
    t = (p - a) @ d / l2 if l2 > 0 else np.zeros(len(p))
    return np.linalg.norm(p - a - t[:, None] * d, axis=1)


def kept_indices(p: np.ndarray, eps: float) -> list[int]:
    """Kept inner indices of one bounded track."""
    out, stack = [], [(0, len(p) - 1)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2:
            continue
        d = chord_distance(p[lo + 1 : hi], p[lo], p[hi])
        k = int(d.argmax())
        if d[k] > eps:
            out.append(lo + 1 + k)
            stack += [(lo, lo + 1 + k), (lo + 1 + k, hi)]
    return out


def _farthest(key: str, pos: str, eps: float):
    def run(rows: DataFrame, seg: DataFrame) -> DataFrame:
        end = lambda side, tag: rows.select(key, F.col(pos).alias(side), F.struct("x", "y", "z").alias(tag))
        edges = seg.join(end("lo", "a"), [key, "lo"]).join(end("hi", "b"), [key, "hi"])
        j = members(rows, edges, key, pos, "a", "b").where(F.col(pos) < F.col("hi"))
        ax = "xyz"
        dot = lambda u, v: sum((u[c] * v[c] for c in "yz"), u["x"] * v["x"])
        ab = {c: F.col(f"b.{c}") - F.col(f"a.{c}") for c in ax}
        ap = {c: F.col(c) - F.col(f"a.{c}") for c in ax}
        l2 = dot(ab, ab)
        t = F.when(l2 > 0, dot(ap, ab) / l2).otherwise(0.0)
        off = {c: ap[c] - t * ab[c] for c in ax}
        best = j.groupBy(key, "lo", "hi").agg(
            F.max(F.struct(F.sqrt(dot(off, off)).alias("d"), (-F.col(pos)).alias("np"))).alias("p")
        )
        return best.where(F.col("p.d") > eps).select(key, "lo", "hi", (-F.col("p.np")).alias("at"))

    return run


def simplify_tracks(points: DataFrame, key: str, pos: str, eps: float, limit: int = LOCAL_ROWS) -> DataFrame:
    """Kept positions per track. ``points`` has ``key``, dense ``pos``, ``x``, ``y``, ``z``."""
    p = materialize(points, "points")
    ends = p.groupBy(key).agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"))
    small, found = split_rounds(p, ends, key, _farthest(key, pos, eps), limit)
    schema = T.StructType([p.schema[key], T.StructField(pos, T.LongType())])

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        inner = kept_indices(pdf[["x", "y", "z"]].to_numpy(), eps)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(inner), pos: pdf[pos].to_numpy()[inner].astype("int64")})

    # Neighbouring segments share a point: it ends the one and is fetched for the other.
    first = p.join(small.withColumn(pos, F.col("lo")), [key, pos])
    member = members(p, small, key, pos).unionByName(first)
    kept = member.groupBy(key, "lo").applyInPandas(local, schema)
    if found is not None:
        kept = kept.unionByName(found.select(key, F.col("at").alias(pos)))
    edges = ends.select(key, F.explode(F.array_distinct(F.array("lo", "hi"))).alias(pos))
    return kept.unionByName(edges)
