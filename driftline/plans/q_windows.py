"""Window operators and onsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import series as S
from driftline.operators import skew
from driftline.operators import windows as W
from driftline.plans.inputs import EV_SQL, W20_SQL, events, micros, windows20
from driftline.plans.registry import query
from driftline.session import table


@query(
    "e1_keep_last",
    """SELECT user_id, epoch_us(date_trunc('hour', ts)) AS t_us, max_by(value, event_id) AS value FROM events GROUP BY user_id, date_trunc('hour', ts)""",
)
def e1(spark, sf):
    e = events(spark, sf).withColumn("t", F.date_trunc("hour", "ts"))
    return skew.keep_last(e, ["user_id", "t"], [F.desc("event_id")]).select("user_id", micros("t").alias("t_us"), "value")


@query(
    "e2_sliding_windows",
    f"WITH {W20_SQL} SELECT user_id, pos, round(list_sum(v), 6) AS total, v[1] AS first_v, v[20] AS last_v FROM w WHERE (pos - 20) % 3 = 0",
)
def e2(spark, sf):
    w = windows20(spark, sf, step=3)
    return w.select(
        "user_id", "pos", F.round(S.total(F.col("v")), 6).alias("total"),
        F.element_at("v", 1).alias("first_v"), F.element_at("v", -1).alias("last_v"),
    )


@query(
    "e3_window_end_sample",
    f"""WITH {EV_SQL}, e AS (SELECT user_id, pos, pos - 20 AS r, n - 19 AS m FROM ev WHERE pos >= 20),
    h AS (SELECT *, m - 8 AS older, unnest([true]) AS x FROM e),
    s AS (SELECT DISTINCT user_id, (i*(older - 1)) // 7 AS r FROM (SELECT DISTINCT user_id, older, m FROM h WHERE m > 16), (SELECT unnest(range(0, 8)) AS i))
    SELECT user_id, pos FROM h WHERE m <= 16 OR r >= m - 8 OR (user_id, r) IN (SELECT (user_id, r) FROM s)""",
)
def e3(spark, sf):
    ends = W.numbered(events(spark, sf), "user_id", "ts", ["event_id"], total="n").where("pos >= 20")
    keep = W.window_end_kept(F.col("pos") - 20, F.col("n") - 19, 16, "hybrid")
    return ends.where(keep).select("user_id", "pos")


@query(
    "e4_fill_gaps",
    f"""WITH {EV_SQL}, g AS (SELECT user_id, pos, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM ev)
    SELECT user_id, pos, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos),
      first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM g""",
)
def e4(spark, sf):
    rows = W.numbered(events(spark, sf), "user_id", "ts", ["event_id"]).withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return W.fill_gaps(rows, ["user_id"], "pos", "v").select("user_id", "pos", "v")


@query(
    "e5_trailing_context",
    """WITH d AS (SELECT o_orderdate::DATE AS d, count(*)::DOUBLE AS ap FROM orders WHERE dayofweek(o_orderdate) <> 3 GROUP BY 1)
    SELECT strftime(d, '%Y-%m-%d') AS day, round(avg(ap) OVER w, 6) AS mean_7d, max(ap) OVER w AS max_7d,
      last_value(ap) OVER w - first_value(ap) OVER w AS delta_7d, CASE WHEN max(ap) OVER w >= 12 THEN 1.0 ELSE 0.0 END::DOUBLE AS storm
    FROM d WINDOW w AS (ORDER BY d RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)""",
)
def e5(spark, sf):
    d = table(spark, sf, "orders").where("dayofweek(o_orderdate) <> 4").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").cast("double").alias("ap"))
    c = W.trailing_context(d, "d", "ap", storm=12.0)
    return c.select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.round("mean_7d", 6).alias("mean_7d"), "max_7d", "delta_7d", "storm")


@query(
    "e6_offsets",
    f"""WITH {EV_SQL} SELECT event_id, round(value - lag(value, 6) OVER w, 6) AS delta_7, round(value - lag(value, 19) OVER w, 6) AS delta_window
    FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos)""",
)
def e6(spark, sf):
    o = W.offsets(events(spark, sf), "user_id", "ts", "value", ["event_id"])
    return o.select("event_id", F.round("delta_7", 6).alias("delta_7"), F.round("delta_window", 6).alias("delta_window"))


@query(
    "e7_gaps",
    """WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER w)/3.6e9 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, round(max(gap), 6) AS max_gap_hours, round(avg(gap), 6) AS mean_gap_hours, count(gap) AS n_gaps FROM g GROUP BY 1""",
)
def e7(spark, sf):
    g = W.gaps(events(spark, sf), "user_id", "ts", "value", ["event_id"])
    return g.groupBy("user_id").agg(
        F.round(F.max("gap_hours"), 6).alias("max_gap_hours"), F.round(F.avg("gap_hours"), 6).alias("mean_gap_hours"), F.count("gap_hours").alias("n_gaps")
    )


ONSET_SQL = EV_SQL + """, bs AS (SELECT user_id, ts, pos, value, list(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS b FROM ev),
  md AS (SELECT user_id, ts, pos, value, b, list_median(b) AS m FROM bs WHERE pos > 30),
  mz AS (SELECT *, list_median(list_transform(b, lambda x: abs(x - m))) AS mad FROM md),
  oz AS (SELECT user_id, min(ts) AS onset, count(*) AS n_breaks FROM mz WHERE abs(value - m)/CASE WHEN mad < 1e-9 THEN 1e-6 ELSE mad END >= 3 GROUP BY 1)"""


@query("e8_series_onset", f"WITH {ONSET_SQL} SELECT user_id, epoch_us(onset) AS onset_us, n_breaks FROM oz")
def e8(spark, sf):
    o = W.series_onset(events(spark, sf), "user_id", "ts", "value", ["event_id"])
    return o.select("user_id", micros("onset_ts").alias("onset_us"), "n_breaks")


@query(
    "e9_sustained_onset",
    f"""WITH {ONSET_SQL}, sc AS (SELECT user_id, ts, pos, value/500 AS s, lead(value/500) OVER (PARTITION BY user_id ORDER BY pos) AS nx FROM ev),
    g AS (SELECT user_id, min(ts) FILTER (WHERE s >= 0.55 AND nx >= 0.3) AS hard, min(ts) FILTER (WHERE s >= 0.45) AS soft, max(s) AS mx, count(*) AS n_scored FROM sc GROUP BY 1)
    SELECT user_id, epoch_us(coalesce(hard, soft_ok, onset)) AS first_us, CASE WHEN hard IS NOT NULL THEN 'if_sustained' WHEN soft_ok IS NOT NULL THEN 'if_first_soft'
      WHEN onset IS NOT NULL THEN 'sma_change_fallback' ELSE 'no_onset_detected' END AS method, round(mx, 6) AS max_score, n_scored
    FROM (SELECT *, CASE WHEN false THEN soft ELSE (SELECT min(ts) FROM sc s2 WHERE s2.user_id = g.user_id AND s2.s >= 0.3) END AS soft_ok FROM g) LEFT JOIN oz USING (user_id)""",
)
def e9(spark, sf):
    e = events(spark, sf)
    fb = W.series_onset(e, "user_id", "ts", "value", ["event_id"])
    sc = W.numbered(e, "user_id", "ts", ["event_id"]).withColumn("s", F.col("value") / 500)
    o = W.sustained_onset(sc, "user_id", "ts", "pos", "s", 0.55, 0.3, fb)
    return o.select("user_id", micros("first_elevated_at").alias("first_us"), "method", F.round("max_score", 6).alias("max_score"), "n_scored")


@query(
    "e10_kernel_smooth",
    f"""WITH {W20_SQL}, t AS (SELECT user_id, pos, unnest(v) AS y, unnest(range(0, 20)) AS i FROM w WHERE (pos - 20) % 10 = 0)
    SELECT a.user_id, a.pos, a.i, round(sum(b.y*exp(-0.5*((a.i-b.i)/1.5)**2))/sum(exp(-0.5*((a.i-b.i)/1.5)**2)), 6) AS smooth
    FROM t a JOIN t b ON a.user_id = b.user_id AND a.pos = b.pos GROUP BY ALL""",
)
def e10(spark, sf):
    w = windows20(spark, sf, step=10)
    return w.select("user_id", "pos", F.posexplode(S.kernel_smooth(F.col("v"), 20)).alias("i", "y")).select(
        "user_id", "pos", F.col("i").cast("bigint").alias("i"), F.round("y", 6).alias("smooth")
    )


@query(
    "e11_latest_board",
    """WITH l AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1)
    SELECT user_id, event_id, value, rank() OVER (ORDER BY value DESC) AS rank FROM l""",
)
def e11(spark, sf):
    last = skew.keep_last(events(spark, sf), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return ranked(last.select("user_id", "event_id", "value"), "value")


def ranked(df, value: str):
    """Global rank (ties share) without one ordering task; see ``skew.value_bins``."""
    from pyspark.sql import Window

    b = skew.value_bins(df, value)
    counts = b.groupBy("__bin").agg(F.count("*").alias("__n"))
    above = counts.select("__bin", (F.sum("__n").over(Window.orderBy(F.desc("__bin"))) - F.col("__n")).alias("__above"))
    w = Window.partitionBy("__bin").orderBy(F.desc(value))
    return b.join(above, "__bin").withColumn("rank", F.col("__above") + F.rank().over(w)).drop("__bin", "__above")


@query(
    "e12_candidate_peaks",
    f"""WITH RECURSIVE {EV_SQL}, s0 AS (SELECT user_id, pos - 2 AS i, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) AS d FROM ev),
    s AS (SELECT *, avg(d) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM s0 WHERE d IS NOT NULL),
    m AS (SELECT user_id, greatest(4*median(d), 1e-6) AS thr FROM s WHERE d IS NOT NULL GROUP BY 1),
    c AS (SELECT s.user_id, i FROM s JOIN m USING (user_id) WHERE i >= 1 AND d >= thr),
    r AS (SELECT user_id, min(i) AS i FROM c GROUP BY 1 UNION ALL
      SELECT user_id, (SELECT min(c.i) FROM c WHERE c.user_id = r.user_id AND c.i >= r.i + 8) AS i FROM r WHERE r.i IS NOT NULL)
    SELECT user_id, i, CASE WHEN near > thr THEN 'IK' ELSE 'ID' END AS node FROM r JOIN s USING (user_id, i) JOIN m USING (user_id)""",
)
def e12(spark, sf):
    rows = W.numbered(events(spark, sf), "user_id", "ts", ["event_id"])
    return W.candidate_peaks(rows, "user_id", "value")
