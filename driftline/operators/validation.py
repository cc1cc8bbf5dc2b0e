"""Walk-forward metrics, panel summaries, claims, detection scores and ablation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators import skew


def target_metrics(folds: DataFrame, thr: float, hit_days: int = 45) -> DataFrame:
    """Metrics per (case, target) over its as-of scores.

    ``folds``: id, norad_id, panel, type, t_peak, asof (dates), score, is_hit.
    """
    dt = F.datediff("asof", "t_peak")
    near = F.abs(dt) <= hit_days
    soft = F.col("score") >= max(0.45, thr - 0.1)
    m = folds.groupBy("id", "norad_id", "panel", "type", "t_peak").agg(
        F.count("*").alias("n_folds"),
        F.avg("score").alias("score_mean"),
        F.max("score").alias("score_max"),
        F.min_by("score", F.struct(F.abs(dt), F.col("asof"))).alias("score_at_peak"),
        F.count_if(F.col("is_hit") & near).alias("n_hits"),
        (F.count_if(soft & near) > 0).alias("soft_hit"),
        F.min(F.when(F.col("is_hit") & (dt <= 0), F.col("asof"))).alias("first_hit"),
        F.min("asof").alias("first_fold"),
        F.count_if((F.col("score") >= thr) & (dt < 0)).alias("n_above_pre_peak"),
    )
    return (
        m.withColumn("hit", F.col("n_hits") > 0)
        .withColumn("first_fold_hit", F.coalesce(F.col("first_hit") == F.col("first_fold"), F.lit(False)))
        .withColumn("lead_days", F.datediff("t_peak", "first_hit").cast("double"))
        .withColumn("is_placebo", F.col("type").startswith("placebo"))
    )


def pre_peak_noise(folds: DataFrame, thr: float) -> DataFrame:
    """Early against late thirds of the scores before the peak (folds of a case are few)."""
    w = Window.partitionBy("id", "norad_id")
    pre = folds.where(F.col("asof") < F.col("t_peak")).select(
        "id", "norad_id", "score", F.row_number().over(w.orderBy("asof")).alias("__r"), F.count("*").over(w).alias("__n")
    )
    third = F.greatest(F.lit(1), F.floor(F.col("__n") / 3))
    p = pre.groupBy("id", "norad_id").agg(
        F.count("*").alias("n_pre"),
        F.avg("score").alias("pre_mean"),
        F.max("score").alias("pre_max"),
        F.avg(F.when(F.col("__r") <= third, F.col("score"))).alias("early_mean"),
        F.avg(F.when(F.col("__r") > F.col("__n") - third, F.col("score"))).alias("late_mean"),
    )
    return p.withColumn("ramp", F.col("late_mean") - F.col("early_mean")).withColumn(
        "elevated", (F.col("late_mean") >= max(0.42, thr - 0.12)) | (F.col("pre_max") >= thr)
    )


def target_panels(folds: DataFrame, thr: float, hit_days: int = 45) -> DataFrame:
    """Target metrics with the pre-peak columns, merged by target: there are as many as cases, so neither side is broadcast."""
    return target_metrics(folds, thr, hit_days).hint("merge").join(pre_peak_noise(folds, thr), ["id", "norad_id"], "left")


def panel_summary(metrics: DataFrame) -> DataFrame:
    """Rates, means, median lead and p95 of the maximum per panel and over all (``ALL``).

    ``metrics``: target metrics joined with the pre-peak columns.
    """
    both = metrics.withColumn("panel", F.explode(F.array("panel", F.lit("ALL"))))
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    agg = both.groupBy("panel").agg(
        F.count("*").alias("n_targets"),
        F.countDistinct("norad_id").alias("n_unique"),
        rate("hit").alias("hit_rate"),
        rate("soft_hit").alias("soft_hit_rate"),
        rate("first_fold_hit").alias("first_fold_rate"),
        rate("elevated").alias("elevated_rate"),
        F.avg("score_max").alias("mean_max"),
        F.avg("pre_mean").alias("mean_pre_peak"),
        F.avg("ramp").alias("mean_ramp"),
        F.avg("lead_days").alias("mean_lead"),
    )
    p95 = skew.exact_quantiles(both, ["panel"], "score_max", {"p95_max": 0.95}, few=True).drop("n")
    med = skew.exact_quantiles(both, ["panel"], "lead_days", {"median_lead": 0.5}, few=True).drop("n")
    return agg.join(p95, "panel", "left").join(med, "panel", "left")


def claims(summary: DataFrame, control: str, thr: float) -> DataFrame:
    """Interest panels against the control panel: gap, and whether either claim holds."""
    ctl = summary.where(F.col("panel") == control).select(F.struct("hit_rate", "mean_max")).scalar()
    s = summary.where(~F.col("panel").isin(control, "ALL")).withColumn("__c", ctl)
    return s.select(
        "panel", "n_targets", "n_unique", "hit_rate", "mean_max", "mean_pre_peak",
        F.col("__c.hit_rate").alias("control_hit_rate"), F.col("__c.mean_max").alias("control_mean_max"),
        (F.col("mean_max") - F.col("__c.mean_max")).alias("gap"),
        ((F.col("hit_rate") >= 0.55) & (F.col("mean_max") >= thr)).alias("interest_supported"),
        ((F.col("__c.hit_rate") <= 0.15) & (F.col("__c.mean_max") < F.col("mean_max"))).alias("control_supported"),
    )


def f2_scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f2 = F.when(p * 4 + r > 0, p * r * 5 / (p * 4 + r)).otherwise(0.0)
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f2, 4).alias("f2")]


def separation(scores: DataFrame, block: str, full: str, key: list[str]) -> DataFrame:
    """Mean score over the full model's top 5 % less its lower half, per block, and correlation."""
    base = scores.where(F.col(block) == full).select(*key, F.col("score").alias("s0"))
    q = skew.exact_quantiles(base, [], "s0", {"p95": 0.95, "p50": 0.5}).select(F.struct("p95", "p50")).scalar()
    j = scores.join(base.withColumn("__q", q), key)
    hi, lo = F.col("s0") >= F.col("__q.p95"), F.col("s0") <= F.col("__q.p50")
    per = j.groupBy(block).agg(
        F.count("*").alias("n"),
        (F.avg(F.when(hi, F.col("score"))) - F.avg(F.when(lo, F.col("score")))).alias("sep"),
        (F.avg(F.when(hi, F.col("s0"))) - F.avg(F.when(lo, F.col("s0")))).alias("full_sep"),
        # A constant block has no correlation.
        (F.covar_pop("score", "s0") / F.nullif(F.stddev_pop("score") * F.stddev_pop("s0"), F.lit(0.0))).alias("corr"),
    )
    return per.select(
        block, "n", F.round("sep", 6).alias("separation"), F.round(F.col("full_sep") - F.col("sep"), 6).alias("separation_drop"), F.round("corr", 6).alias("corr_with_full")
    )
