"""Mamdani max-min scoring of six inputs with ten rules and a centroid on a 101-point grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.series import clip, let

# Membership corners (a, b, c, d) per input term, with the input's range.
INPUTS = {
    "score": ((0.0, 1.0), {"low": (0, 0, 0.3, 0.5), "medium": (0.3, 0.5, 0.5, 0.7), "high": (0.5, 0.7, 1, 1)}),
    "shannon": ((0.0, 3.0), {"predictable": (0, 0, 0.5, 1.0), "chaotic": (1.5, 2.0, 3.0, 3.0)}),
    "age": ((0.0, 168.0), {"fresh": (0, 0, 24, 48), "stale": (72, 120, 168, 168)}),
    "dist": ((0.0, 500.0), {"critical": (0, 0, 10, 25), "near": (10, 50, 50, 100)}),
    "lz": ((0.0, 1.0), {"simple": (0, 0, 0.2, 0.4), "complex": (0.6, 0.8, 1, 1)}),
    "dfa": ((0.0, 1.0), {"trend": (0.5, 0.7, 1, 1)}),
}
# Membership corners of the output classes.
OUTPUT = {
    "NORMAL": (0, 0, 0.2, 0.35),
    "ANOMALOUS": (0.2, 0.4, 0.4, 0.55),
    "SUSPECT": (0.4, 0.6, 0.6, 0.8),
    "HOSTILE": (0.65, 0.8, 1, 1),
}
# Rules as (conditions, class); conditions are joined by minimum.
RULES = (
    ("score.low shannon.predictable", "NORMAL"),
    ("score.medium age.stale", "ANOMALOUS"),
    ("score.high age.fresh dist.critical dfa.trend", "HOSTILE"),
    ("shannon.chaotic lz.complex dfa.trend", "SUSPECT"),
    ("shannon.chaotic age.fresh dist.near", "SUSPECT"),
    ("lz.complex score.high", "HOSTILE"),
    ("age.stale", "ANOMALOUS"),
    ("dist.critical", "SUSPECT"),
    ("score.low lz.simple", "NORMAL"),
    ("shannon.chaotic lz.complex dist.critical age.fresh", "HOSTILE"),
)


def membership(x: Column, corners) -> Column:
    a, b, c, d = (float(v) for v in corners)
    up = F.lit(1.0) if a == b else (x - a) / (b - a)
    down = F.lit(1.0) if c == d else (F.lit(d) - x) / (d - c)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), up, down))


def _grid_membership(x: float, corners) -> float:
    a, b, c, d = corners
    up = 1.0 if a == b else (x - a) / (b - a)
    down = 1.0 if c == d else (d - x) / (d - c)
    return max(0.0, min(1.0, up, down))


def fuzzy_threat(inputs: dict[str, Column]) -> Column:
    """Struct of threat level, class, confidence and ambiguity; no active rule gives 0.5."""
    terms = {
        f"{k}.{t}": membership(clip(inputs[k], lo, hi), corners)
        for k, ((lo, hi), parts) in INPUTS.items()
        for t, corners in parts.items()
    }
    low = lambda cs: cs[0] if len(cs) == 1 else F.least(*cs)
    fired = {c: [low([terms[t] for t in cond.split()]) for cond, out in RULES if out == c] for c in OUTPUT}
    act = F.struct(*[(v[0] if len(v) == 1 else F.greatest(*v)).alias(c) for c, v in fired.items()])
    grid = F.array(
        *[
            F.struct(
                F.lit(i / 100).alias("x"), *[F.lit(_grid_membership(i / 100, k)).alias(c) for c, k in OUTPUT.items()]
            )
            for i in range(101)
        ]
    )
    start = F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", "area", "moment")])

    def centroid(a):
        def step(acc, g):
            y = F.greatest(*[F.least(a[c], g[c]) for c in OUTPUT])
            h = g["x"] - acc["x"]
            area = h * (acc["y"] + y) / 2
            moment = h * (acc["x"] * (acc["y"] * 2 + y) + g["x"] * (acc["y"] + y * 2)) / 6
            return F.struct(
                g["x"].alias("x"), y.alias("y"), (acc["area"] + area).alias("area"), (acc["moment"] + moment).alias("moment")
            )

        return F.aggregate(
            grid, start, step,
            lambda r: F.when(r["area"] > 0, r["moment"] / r["area"]).otherwise(0.5),
        )

    def finish(t):
        name = F.when(t < 0.35, "NORMAL").when(t < 0.55, "ANOMALOUS").when(t < 0.8, "SUSPECT").otherwise("HOSTILE")
        conf = (
            F.when(t < 0.35, membership(t, OUTPUT["NORMAL"]))
            .when(t < 0.55, membership(t, OUTPUT["ANOMALOUS"]))
            .when(t < 0.8, membership(t, OUTPUT["SUSPECT"]))
            .otherwise(membership(t, OUTPUT["HOSTILE"]))
        )
        return F.struct(
            t.alias("threat_level"), name.alias("classification"), conf.alias("confidence"), (F.lit(1.0) - conf).alias("ambiguity")
        )

    return let(act, lambda a: let(centroid(a), finish))
