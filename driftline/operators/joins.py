"""Join patterns: as-of day, fold assignment, capped peers, interval matching, pair merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.series import clip
from driftline.operators import skew
from driftline.operators.chains import matched
from driftline.session import materialize


def asof_day(rows: DataFrame, daily: DataFrame, day: str, defaults: dict[str, float], until: Column | None = None) -> DataFrame:
    """The day's values or those of the nearest earlier day, else defaults.

    ``daily`` has one row per day: each row gets the span of days it is valid for, exploded to a
    dense calendar (bounded by the calendar), so the big side needs one equi-join. ``until`` is the
    last day that occurs in ``rows``; without it ``rows`` is evaluated once more to find it.
    """
    w = Window.orderBy(day)
    nxt = F.lead(day).over(w)
    span = rows.agg(F.max(day)).scalar() if until is None else until
    last = F.greatest(F.coalesce(F.date_sub(nxt, 1), span), F.col(day))
    dense = daily.select("*", F.sequence(F.col(day), last).alias("__days")).withColumn(
        day, F.explode("__days")
    ).drop("__days")
    j = rows.join(dense, day, "left")
    return j.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def previous_day(scores: DataFrame, key: str, day: str, score: str) -> DataFrame:
    """Change against exactly the day before (null when that day is missing)."""
    prev = scores.select(key, F.date_add(day, 1).alias(day), F.col(score).alias("prev_score"))
    return scores.join(prev, [key, day], "left").withColumn("delta", F.col(score) - F.col("prev_score"))


def merge_pairs(alerts: DataFrame, best: DataFrame) -> DataFrame:
    """Best pair onto alerts: attention, hot-pair status for suspects, reset for baselines.

    ``best(norad_id, p_level, p_risk)`` holds one row per suspect.
    """
    m = alerts.join(best, "norad_id", "left")
    base = F.col("role") == "baseline"
    hot = F.coalesce(
        F.col("reliable") & (F.col("role") == "suspect")
        & ((F.col("p_level") == "CRITICAL")
           | ((F.col("p_level") == "ELEVATED") & (F.col("p_risk") >= 0.65) & (F.col("score") >= 0.35))),
        F.lit(False),
    )
    fused = F.when(F.col("reliable"), clip(F.col("score") * 0.45 + F.col("p_risk") * 0.55, 0, 1)).otherwise(F.col("score"))
    status = (
        F.when(base, F.when(F.col("status") == "UNRELIABLE_DATA", F.col("status")).otherwise("CALIBRATION_BASELINE"))
        .when(hot & F.col("status").isin("NOMINAL", "CALIBRATION_BASELINE"), "PAIR_ELEVATED")
        .otherwise(F.col("status"))
    )
    return (
        m.withColumn("attention", F.when(F.col("p_risk").isNotNull(), fused).when(base, F.col("score") * 0.35))
        .withColumn("status", status)
        .withColumn("is_anomaly", ~base & (F.col("is_anomaly") | hot))
        .withColumn("is_detection", ~base & (F.col("is_detection") | hot))
    )


def top_peers(pairs: DataFrame, key: str, group: str, score: str, k: int, carry: Sequence[str] = ()) -> DataFrame:
    """Up to ``k`` best-scored other members of each member's group, with their ``carry`` columns as ``peer_<name>``.

    Only the group's top ``k + 1`` can be anyone's peers, so a group of any size is joined with
    ``k + 1`` rows and its pairs are never formed.
    """
    top = skew.latest_rows(pairs, [group], [F.desc(score), F.asc(key)], k + 1).select(
        group, F.col(key).alias("peer"), F.col(score).alias("peer_score"), *[F.col(c).alias(f"peer_{c}") for c in carry]
    )
    j = pairs.join(top, group).where(F.col(key) != F.col("peer"))
    w = Window.partitionBy(key, group).orderBy(F.desc("peer_score"), F.asc("peer"))
    return j.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def same_peak(cases: DataFrame, k: int) -> DataFrame:
    """Up to ``k`` placebo targets sharing a case's peak day, never the target itself."""
    pl = cases.where(F.col("type").startswith("placebo")).select(
        "t_peak", F.col("id").alias("placebo_id"), F.col("norad_id").alias("placebo")
    )
    # A target can appear in several placebo cases of a day; all of its rows are excluded for it.
    per = pl.withColumn("__r", F.dense_rank().over(Window.partitionBy("t_peak").orderBy("placebo"))).where(F.col("__r") <= k + 1)
    few = per.withColumn("__n", F.row_number().over(Window.partitionBy("t_peak", "placebo").orderBy("placebo_id"))).where(F.col("__n") <= k)
    j = cases.select("id", "norad_id", "t_peak").join(few, "t_peak").where(F.col("norad_id") != F.col("placebo"))
    w = Window.partitionBy("id", "norad_id").orderBy("placebo", "placebo_id")
    return j.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select(
        "id", "norad_id", "placebo_id", "placebo", "rank"
    )


def explode_folds(cases: DataFrame, step_days: int) -> DataFrame:
    """One row per (case, target, as-of day)."""
    days = F.sequence("t_start", "t_end", F.expr(f"INTERVAL {int(step_days)} DAY"))
    return cases.withColumn("norad_id", F.explode("norad_ids")).withColumn("asof", F.explode(days))


def daily_folds(cases: DataFrame, scores: DataFrame, key: str, day: str) -> DataFrame:
    """Every case target with its object's scores of the days from ``t_start`` to ``t_end``.

    ``scores`` has a row per ``key`` (the target's ``norad_id``) and ``day``. Spark takes parsed cases for a
    few bytes each and would send all of them to the driver as a broadcast, hence the merge join.
    """
    targets = cases.withColumn(key, F.explode("norad_ids"))
    return targets.hint("merge").join(scores, key).where(F.col(day).between(F.col("t_start"), F.col("t_end")))


def assign_folds(folds: DataFrame, anchors: DataFrame, ends: DataFrame, holdout_days: int) -> DataFrame:
    """Per fold: number of training windows ended before ``asof - holdout``; last target window.

    Windows are first counted per day (and per entity and day), so folds meet day tables by
    equi-join instead of a range join over all windows.
    """
    per_day = anchors.groupBy(F.date_add(F.to_date("ts"), holdout_days + 1).alias("asof")).agg(F.count("*").alias("__n"))
    grid = folds.select("asof").distinct().withColumn("__n", F.lit(0).cast("bigint")).unionByName(per_day)
    w = Window.orderBy("asof").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    days = grid.groupBy("asof").agg(F.sum("__n").alias("__n")).withColumn("n_train", F.sum("__n").over(w)).drop("__n")

    # A window at 00:00:00 sharp of the as-of day still counts as "at or before".
    at = F.to_date(F.col("ts").cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND"))
    daily = ends.groupBy("norad_id", F.date_add(at, 1).alias("asof")).agg(F.max("pos").alias("__p"))
    want = folds.select("norad_id", "asof").distinct().withColumn("__p", F.lit(None).cast("bigint"))
    per = Window.partitionBy("norad_id").orderBy("asof")
    both = daily.unionByName(want).groupBy("norad_id", "asof").agg(F.max("__p").alias("__p"))
    target = both.select("norad_id", "asof", F.max("__p").over(per).alias("target_pos"))
    return (
        folds.join(F.broadcast(days), "asof", "left").hint("merge").join(target, ["norad_id", "asof"], "left")
        .withColumn("n_train", F.coalesce("n_train", F.lit(0).cast("bigint")))
    )


def match_counts(pred: DataFrame, truth: DataFrame, key: str, classes: Sequence[str], i: str, tol: int) -> DataFrame:
    """True/false positives and false negatives per key by greedy one-to-one matching within ``classes``.

    Equal places of one key, class and kind count once. See ``chains.matched``.
    """
    group = [key, *classes]
    # Both are counted and matched.
    pred, truth = (materialize(d.select(*group, i).distinct(), "match-input") for d in (pred, truth))
    hits = matched(pred, truth, group, i, tol).groupBy(key).agg(F.sum("tp").alias("tp"))
    counts = pred.select(key, F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select(key, F.lit(0).alias("p"), F.lit(1).alias("t")))
    tot = counts.groupBy(key).agg(F.sum("p").alias("n_pred"), F.sum("t").alias("n_truth")).join(hits, key, "left")
    tp = F.coalesce("tp", F.lit(0).cast("bigint"))
    return tot.select(key, tp.alias("tp"), (F.col("n_pred") - tp).alias("fp"), (F.col("n_truth") - tp).alias("fn"))
