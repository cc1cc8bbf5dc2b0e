"""Regime-change counts over whole series of any length."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import skew
from driftline.operators.windows import steps
from driftline.session import materialize


def alarm_count(z: np.ndarray, k: float, h: float, refractory: int) -> int:
    """Alarms of the two-sided chart with reset, from a quiet start; the rule that :func:`series_regime_count` follows."""
    p = n = 0.0
    count, last = 0, -refractory
    for i, v in enumerate(z):
        p, n = max(0.0, p + v - k), max(0.0, n - v - k)
        if (p >= h or n >= h) and i - last >= refractory:
            count, last, p, n = count + 1, i, 0.0, 0.0
    return count


def series_regime_count(rows: DataFrame, key: str, value: str, k: float = 0.5, h: float = 4.0, refractory: int = 5, floor: float = 0.05) -> DataFrame:
    """Alarms per entity over its whole numbered series; under 8 differences: 0.

    The chart without resets is a running sum less its running minimum, so its zeros come from
    two-level scans. It never lies below the chart with resets; where it stayed at zero on both
    sides for ``refractory`` rows no earlier alarm matters. The series is cut there, and pieces are
    counted independently.
    """
    # Each scan reads its input twice, so inputs used again are written once.
    d = materialize(steps(rows, key, value).select(key, "i", "step"), "steps")
    n = d.groupBy(key).agg(F.max("i").alias("last_i"))
    base = d.join(n, key).where(F.col("i") < F.col("last_i"))
    med = skew.exact_quantiles(base, [key], "step", {"med": 0.5}).select(key, "med")
    med = materialize(med, "median")
    dev = base.join(med, key).withColumn("dev", F.abs(F.col("step") - F.col("med")))
    mad = skew.exact_quantiles(dev, [key], "dev", {"mad": 0.5}).select(key, "mad")
    std = base.groupBy(key).agg(F.stddev_pop("step").alias("sd"))
    stats = med.join(mad, key).join(std, key).join(n, key)
    core = F.col("mad") * 1.4826
    sigma = F.greatest(F.when(core < 1e-12, F.greatest("sd", F.lit(1e-9))).otherwise(core), F.lit(floor))
    z = d.join(stats, key).where(F.col("last_i") >= 7).select(key, "i", ((F.col("step") - F.col("med")) / sigma).alias("z")).withColumn("pos", F.col("i") + 1)
    z = materialize(z, "innovations")
    for side, sign in (("up", 1.0), ("dn", -1.0)):
        z = skew.running(z, [key], "pos", F.col("z") * sign - k, f"{side}_s", "sum")
        z = materialize(z, "sums")
        z = materialize(skew.running(z, [key], "pos", F.col(f"{side}_s"), f"{side}_m", "min"), "mins")
    quiet = (F.col("up_s") <= F.least(F.lit(0.0), F.col("up_m"))) & (F.col("dn_s") <= F.least(F.lit(0.0), F.col("dn_m")))
    q = z.withColumn("quiet", quiet.cast("int"))
    w = skew.block_window([key]).rowsBetween(-refractory, -1)
    cuts = skew.owned(skew.halo_blocks(q, before=refractory).withColumn("calm", F.sum("quiet").over(w)))
    start = F.when((F.col("pos") == 1) | (F.col("calm") == refractory), F.col("pos"))
    cuts = materialize(cuts.withColumn("start", start), "cuts")
    pieces = materialize(skew.running(cuts, [key], "pos", F.col("start"), "piece", "last"), "pieces")
    # Quiet pieces without any alarm-sized sum are dropped before any is gathered.
    peak = pieces.groupBy(key, "piece").agg(
        F.greatest(F.max(F.col("up_s") - F.least(F.lit(0.0), F.col("up_m"))), F.max(F.col("dn_s") - F.least(F.lit(0.0), F.col("dn_m")))).alias("peak")
    ).where(F.col("peak") >= h - 1e-9)
    live = pieces.select(key, "piece", "pos", "z").join(peak.select(key, "piece"), [key, "piece"])

    # One array a piece; a missing value leaves the chart at zero, as in alarm_count.
    known = F.when(~F.isnan("z"), F.col("z"))
    listed = live.groupBy(key, "piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", known.alias("z")))), lambda x: x["z"]).alias("zs"))

    def alarms(a, x):
        p, n = (F.greatest(F.lit(0.0), side - k) for side in (a["p"] + x, a["n"] - x))
        hit = ((p >= h) | (n >= h)) & (a["since"] >= refractory)
        return F.struct(
            F.when(hit, 0.0).otherwise(p).alias("p"), F.when(hit, 0.0).otherwise(n).alias("n"),
            (a["c"] + hit.cast("bigint")).alias("c"), (F.when(hit, 0).otherwise(a["since"]) + 1).alias("since"),
        )

    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n"), F.lit(0).cast("bigint").alias("c"), F.lit(refractory).alias("since"))
    per = listed.groupBy(key).agg(F.sum(F.aggregate("zs", zero, alarms)["c"]).alias("changes"))
    return rows.select(key).distinct().join(per, key, "left").select(key, F.coalesce("changes", F.lit(0).cast("bigint")).alias("changes"))
