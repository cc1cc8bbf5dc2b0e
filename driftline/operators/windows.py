"""Count windows, fills, onsets and peaks over entity series (see ``skew`` for the balancing)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import series as S
from driftline.operators import skew
from driftline.operators.chains import spaced
from driftline.session import materialize

WINDOW = 20


def day_slot(ts: str) -> Column:
    return F.to_date(F.col(ts))


def numbered(df: DataFrame, key: str, ts: str, tie: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Row number ``pos`` per entity by time."""
    return skew.positions(df, [key], [ts, *tie], day_slot(ts), total=total)


def sliding_windows(
    df: DataFrame,
    key: str,
    ts: str,
    values: Sequence[str],
    tie: Sequence[str] = (),
    size: int = WINDOW,
    step: int = 1,
    total: str | None = None,
    trail: Sequence[str] = (),
    trail_size: int = WINDOW,
) -> DataFrame:
    """Full windows of ``size`` rows ending at every ``step``-th row.

    Keeps the input columns of the window's last row and adds ``pos`` and one array per value
    column (``<name>_w``), and for ``trail`` the last ``trail_size`` or fewer values (``<name>_l``).
    """
    rows = numbered(df, key, ts, tie, total)
    blocks = skew.halo_blocks(rows, before=max(size, trail_size if trail else size) - 1)
    w = skew.block_window([key]).rowsBetween(-(size - 1), 0)
    longer = skew.block_window([key]).rowsBetween(-(trail_size - 1), 0)
    full = (F.col("pos") >= size) & ((F.col("pos") - size) % step == 0)
    out = blocks.select(
        "*", *[F.collect_list(F.col(v)).over(w).alias(f"{v}_w") for v in values], *[F.collect_list(F.col(v)).over(longer).alias(f"{v}_l") for v in trail]
    )
    return skew.owned(out.where(full))


def latest_windows(
    df: DataFrame, key: str, ts: str, values: Sequence[str], tie: Sequence[str] = (), size: int = WINDOW
) -> DataFrame:
    """Each entity's last ``size`` rows as arrays; entities with fewer rows are left out.

    Only ``size`` rows per entity leave each map task.
    """
    order = [F.col(c).desc() for c in (ts, *tie)]
    tail = skew.latest_rows(df, [key], order, size)
    rows = F.array_sort(F.collect_list(F.struct(ts, *tie, *[v for v in values if v not in (ts, *tie)])))
    grouped = tail.groupBy(key).agg(rows.alias("__w")).where(F.size("__w") == size)
    return grouped.select(
        key,
        F.element_at("__w", -1)[ts].alias(ts),
        *[F.col("__w")[v].alias(f"{v}_w") for v in values],
    )


def window_end_kept(rank: Column, n: Column, cap: int, mode: str = "hybrid") -> Column:
    """Whether the window with 0-based ``rank`` of ``n`` is in the sample of at most ``cap``.

    ``recent`` keeps the last ones, ``full`` spaces them evenly, ``hybrid`` does half and half.
    """
    if mode == "recent":
        chosen = rank >= n - cap
    elif mode == "full":
        chosen = _evenly_spaced(rank, n, cap)
    else:
        recent = max(1, cap // 2)
        chosen = rank >= n - recent
        if cap > recent:
            chosen = chosen | _evenly_spaced(rank, n - recent, cap - recent)
    return (n <= cap) | chosen


def _evenly_spaced(rank: Column, n: Column, m: int) -> Column:
    """Rank equals ``floor(i (n-1) / (m-1))`` for some i in 0..m-1."""
    if m == 1:
        return rank == 0
    span = F.greatest(n - 1, F.lit(1))
    i = F.ceil(rank * (m - 1) / span)
    return (rank < n) & (i <= m - 1) & (F.floor(i * (n - 1) / (m - 1)) == rank)


def spaced_ranks(n: Column, cap: int) -> Column:
    """Array of the kept 0-based ranks in ``hybrid`` mode; used to fetch windows by rank."""
    recent = max(1, cap // 2)
    span = cap - recent
    older = n - recent
    tail = F.sequence(n - recent, n - 1)
    head = F.transform(
        F.sequence(F.lit(0), F.lit(max(span - 1, 0))),
        lambda i: F.floor(i * (older - 1) / max(span - 1, 1)),
    )
    many = F.concat(head, tail) if span else tail
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(
        n <= cap, F.sequence(F.lit(0).cast("bigint"), n - 1)
    ).otherwise(many)


def fill_gaps(df: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Forward fill, then backward fill what is left at the start."""
    total = "__last_pos"
    ends = df.groupBy(*keys).agg(F.max(pos).alias(total))
    fwd = skew.running(df, keys, pos, F.col(value), "__f", how="last")
    # First known value per key reaches back to the start.
    head = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min_by(value, pos).alias("__h")
    )
    return (
        fwd.join(ends.join(head, list(keys), "left"), list(keys))
        .withColumn(value, F.coalesce("__f", "__h"))
        .drop("__f", "__h", total)
    )


def trailing_context(daily: DataFrame, day: str, value: str, days: int = 7, storm: float = 30.0) -> DataFrame:
    """Mean, max, first-to-last change and storm flag over ``[day - days, day]``.

    ``daily`` has one row per calendar day, so one ordered pass is bounded by the calendar.
    """
    w = Window.orderBy(F.unix_date(day)).rangeBetween(-days, 0)
    return daily.select(
        "*",
        F.avg(value).over(w).alias("mean_7d"),
        F.max(value).over(w).alias("max_7d"),
        (F.last(value).over(w) - F.first(value).over(w)).alias("delta_7d"),
        F.when(F.max(value).over(w) >= storm, 1.0).otherwise(0.0).alias("storm"),
    )


def offsets(df: DataFrame, key: str, ts: str, value: str, tie: Sequence[str] = (), window: int = WINDOW) -> DataFrame:
    """Change against the 7th-last row and the first row of the window ending at each row."""
    rows = numbered(df, key, ts, tie)
    w = skew.block_window([key])
    out = skew.halo_blocks(rows, before=window - 1).select(
        "*",
        (F.col(value) - F.lag(value, 6).over(w)).alias("delta_7"),
        (F.col(value) - F.lag(value, window - 1).over(w)).alias("delta_window"),
    )
    return skew.owned(out)


def gaps(df: DataFrame, key: str, ts: str, value: str, tie: Sequence[str] = ()) -> DataFrame:
    """Hours and absolute step since the entity's previous row."""
    rows = numbered(df, key, ts, tie)
    w = skew.block_window([key])
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    out = skew.halo_blocks(rows, before=1).select(
        "*",
        ((micros - F.lag(micros).over(w)) / 3.6e9).alias("gap_hours"),
        F.abs(F.col(value) - F.lag(value).over(w)).alias("step"),
    )
    return skew.owned(out)


def data_quality(df: DataFrame, key: str, ts: str, value: str, rate: str, reference: Column, tie: Sequence[str] = (), min_rows: int = WINDOW) -> DataFrame:
    """Quality score, issue list and reliability per entity (age, gaps, jumps, rate bounds)."""
    last = F.struct(*[F.col(c) for c in (ts, *tie)])
    per = gaps(df, key, ts, value, tie).groupBy(key).agg(
        F.count("*").alias("n"),
        F.max("gap_hours").alias("max_gap"),
        F.max("step").alias("max_step"),
        F.max_by(rate, last).alias("rate"),
        F.max(ts).alias("last_ts"),
    )
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = F.greatest(F.lit(0.0), (micros(reference) - micros(F.col("last_ts"))) / 3.6e9)
    per = per.withColumn("age_hours", age)
    short = F.col("n") < min_rows
    gap, step = F.coalesce("max_gap", F.lit(0.0)), F.coalesce("max_step", F.lit(0.0))
    oob = ~((F.col("rate") > 0.5) & (F.col("rate") < 20))
    score = (
        F.lit(1.0)
        - F.when(F.col("age_hours") > 72, 0.35).when(F.col("age_hours") > 36, 0.15).otherwise(0.0)
        - F.when(gap > 168, 0.3).when(gap > 72, 0.15).otherwise(0.0)
        - F.when(step > 200, 0.25).otherwise(0.0)
        - F.when(oob, 0.4).otherwise(0.0)
    )
    issues = F.array_compact(
        F.array(
            F.when(F.col("age_hours") > 72, "stale").when(F.col("age_hours") > 36, "aging"),
            F.when(gap > 72, "gap"),
            F.when(step > 200, "jump"),
            F.when(oob, "rate_out_of_bounds"),
        )
    )
    return per.withColumn(
        "score", F.when(short, 0.0).otherwise(S.clip(score, 0, 1))
    ).withColumn(
        "issues", F.when(short, F.array(F.lit("insufficient_history"))).otherwise(issues)
    ).withColumn("reliable", F.col("score") >= 0.45)


def series_onset(df: DataFrame, key: str, ts: str, value: str, tie: Sequence[str] = (), window: int = 30, z: float = 3.0) -> DataFrame:
    """First time a value leaves the median of its previous ``window`` rows by ``z`` MADs."""
    rows = numbered(df, key, ts, tie)
    w = skew.block_window([key]).rowsBetween(-window, -1)
    base = skew.owned(
        skew.halo_blocks(rows, before=window)
        .select("*", F.collect_list(value).over(w).alias("__b"))
        .where(F.col("pos") > window)
    ).withColumn("__m", S.median(F.col("__b")))
    mad = S.median(S.with_const(F.col("__b"), F.col("__m"), lambda x, m: F.abs(x - m)))
    scored = base.withColumn("__mad", mad).withColumn(
        "__z",
        F.abs(F.col(value) - F.col("__m"))
        / F.when(F.col("__mad") < 1e-9, 1e-6).otherwise(F.col("__mad")),
    )
    return scored.where(F.col("__z") >= z).groupBy(key).agg(
        F.min(ts).alias("onset_ts"), F.count("*").alias("n_breaks")
    )


def sustained_onset(
    scores: DataFrame, key: str, ts: str, pos: str, score: str, hard: Column | float, soft: Column | float, fallback: DataFrame | None = None,
    sustained: int = 2, history: DataFrame | None = None, least: int = WINDOW,
) -> DataFrame:
    """First sustained rise: a hard score followed by ``sustained - 1`` soft ones; else first soft; else fallback.

    ``scores`` is numbered by ``pos``; ``fallback`` is a ``series_onset`` result. ``history(key, n_rows)``
    lists all entities: those with fewer than ``least`` rows are not scanned, and have the fallback
    (``sma_only``) or nothing (``insufficient_history``); the others without scores have no maximum.
    """
    need = max(1, sustained)
    w = skew.block_window([key], pos)
    ahead = [F.coalesce(F.lead(score, k).over(w) >= soft, F.lit(False)).alias(f"__s{k}") for k in range(1, need)]
    nxt = skew.owned(skew.halo_blocks(scores, pos=pos, after=need - 1).select("*", *ahead)) if ahead else scores
    held = F.col(score) >= hard
    for k in range(1, need):
        held = held & F.col(f"__s{k}")
    per = nxt.groupBy(key).agg(
        F.min(F.when(held, F.col(ts))).alias("__hard"), F.min(F.when(F.col(score) >= soft, F.col(ts))).alias("__soft"),
        F.max(score).alias("max_score"), F.count("*").alias("n_scored"),
    )
    if fallback is not None:
        per = per.join(fallback.select(key, F.col("onset_ts").alias("__fb")), key, "full" if history is not None else "left")
    else:
        per = per.withColumn("__fb", F.lit(None).cast(scores.schema[ts].dataType))
    short = F.lit(False)
    if history is not None:
        per = history.select(key, "n_rows").join(per, key, "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0).cast("bigint")))
        short = F.col("n_rows") < least
    scanned = lambda c: F.when(~short, F.col(c))
    method = (
        F.when(short, F.when(F.col("__fb").isNotNull(), "sma_only").otherwise("insufficient_history"))
        .when(F.col("__hard").isNotNull(), "if_sustained")
        .when(F.col("__soft").isNotNull(), "if_first_soft")
        .when(F.col("__fb").isNotNull(), "sma_change_fallback")
        .otherwise("no_onset_detected")
    )
    return per.select(
        key, F.coalesce(scanned("__hard"), scanned("__soft"), F.col("__fb")).alias("first_elevated_at"), method.alias("method"),
        scanned("max_score").alias("max_score"), F.when(short, F.lit(0).cast("bigint")).otherwise(F.col("n_scored")).alias("n_scored"),
    )


def steps(df: DataFrame, key: str, value: str, pos: str = "pos") -> DataFrame:
    """Signed step to the entity's previous row, at the 0-based difference index."""
    w = skew.block_window([key], pos)
    out = skew.owned(
        skew.halo_blocks(df, pos=pos, before=1).select(
            "*", (F.col(value) - F.lag(value).over(w)).alias("step")
        )
    )
    return out.where(F.col(pos) > 1).withColumn("i", F.col(pos) - 2)


def candidate_peaks(df: DataFrame, key: str, value: str, pos: str = "pos", factor: float = 4.0, min_gap: int = 8) -> DataFrame:
    """Large steps (``factor`` times the entity's median step), at least ``min_gap`` apart, with their class.

    ``node`` is ``IK`` where the mean of the step and its neighbours is still above the threshold, else ``ID``.
    """
    # The steps feed the median and the filter, and are written once.
    d = steps(df, key, value, pos).select(key, (F.col("i") + 1).alias("pos"), F.abs("step").alias("d"))
    w = skew.block_window([key]).rowsBetween(-1, 1)
    d = skew.owned(skew.halo_blocks(d, before=1, after=1).select("*", F.avg("d").over(w).alias("near")))
    d = materialize(d.select(key, (F.col("pos") - 1).alias("i"), "d", "near"), "steps")
    med = skew.exact_quantiles(d, [key], "d", {"med": 0.5})
    thr = F.greatest(F.col("med") * factor, F.lit(1e-6))
    cand = d.join(med.select(key, "med"), key).where((F.col("i") >= 1) & (F.col("d") >= thr))
    cand = materialize(cand.select(key, "i", F.when(F.col("near") > thr, "IK").otherwise("ID").alias("node")), "candidates")
    return spaced(cand, [key], "i", min_gap).join(cand, [key, "i"])
