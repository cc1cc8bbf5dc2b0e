"""Lookups, as-of, fold assignment, peers, matching and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import joins as J
from driftline.plans.inputs import BOARD_SQL, STATUS_SQL, board, events, micros, status_board
from driftline.plans.q_sources import CASES_SQL, CAT_SQL, event_cases, watchlist
from driftline.plans.registry import query
from driftline.session import table
from driftline.sources import catalogs as C


@query(
    "c1_catalog_lookup",
    f"""WITH {CAT_SQL}, u AS (SELECT DISTINCT user_id * 12 AS norad_id FROM events)
    SELECT norad_id, coalesce(name, norad_id::VARCHAR) AS name, coalesce(role, 'unknown') AS role, coalesce(country, 'UNKNOWN') AS country,
      coalesce(purpose, 'unknown') AS purpose FROM u LEFT JOIN cat USING (norad_id)""",
)
def c1(spark, sf):
    u = events(spark, sf, "user_id").select((F.col("user_id") * 12).alias("norad_id")).distinct()
    return C.with_meta(u, watchlist(spark, sf)).select("norad_id", "name", "role", "country", "purpose")


@query(
    "c3_asof_day",
    """WITH d AS (SELECT o_orderdate::DATE + 10000 AS d, count(*)::DOUBLE AS f FROM orders WHERE month(o_orderdate) IN (1, 3, 8) AND o_orderkey % 5 = 0 GROUP BY 1),
    r AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, l_shipdate::DATE + 10000 AS d FROM lineitem)
    SELECT l_orderkey, line, coalesce(f, 120.0) AS f10_7 FROM r ASOF LEFT JOIN d ON r.d >= d.d""",
)
def c3(spark, sf):
    o = table(spark, sf, "orders").where("month(o_orderdate) IN (1, 3, 8) AND o_orderkey % 5 = 0")
    day = lambda c: F.date_add(F.to_date(c), 10000)
    daily = o.groupBy(day("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("f10_7"))
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), day("l_shipdate").alias("day"))
    return J.asof_day(li, daily, "day", {"f10_7": 120.0}).select("l_orderkey", "line", "f10_7")


@query(
    "c5_merge_pairs",
    f"""WITH {STATUS_SQL}, best AS (SELECT norad_id, risk_level AS lv, pair_risk AS pr FROM b WHERE asset_norad IS NOT NULL),
    m AS (SELECT sb.*, lv, pr, coalesce(reliable AND role = 'suspect' AND (lv = 'CRITICAL' OR (lv = 'ELEVATED' AND pr >= 0.65 AND score >= 0.35)), false) AS pair_hot
      FROM sb LEFT JOIN best USING (norad_id))
    SELECT norad_id, CASE WHEN role = 'baseline' THEN CASE WHEN status = 'UNRELIABLE_DATA' THEN status ELSE 'CALIBRATION_BASELINE' END
        WHEN pair_hot AND status IN ('NOMINAL','CALIBRATION_BASELINE') THEN 'PAIR_ELEVATED' ELSE status END AS status,
      role <> 'baseline' AND (is_anomaly OR pair_hot) AS is_anomaly, role <> 'baseline' AND (is_detection OR pair_hot) AS is_detection,
      round(CASE WHEN pr IS NOT NULL THEN CASE WHEN reliable THEN least(1, 0.45*score + 0.55*pr) ELSE score END
        WHEN role = 'baseline' THEN score*0.35 END, 6) AS attention FROM m""",
)
def c5(spark, sf):
    b = status_board(spark, sf)
    best = b.where("asset_norad IS NOT NULL").select("norad_id", F.col("risk_level").alias("p_level"), F.col("pair_risk").alias("p_risk"))
    return J.merge_pairs(b.drop("attention"), best).select(
        "norad_id", "status", "is_anomaly", "is_detection", F.round("attention", 6).alias("attention")
    )


DAY_SCORES_SQL = """ds AS (SELECT user_id, ts::DATE AS d, round(avg(value)/500, 9) AS score FROM events GROUP BY ALL)"""


def day_scores(spark, sf):
    return events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.avg("value") / 500, 9).alias("score"))


@query(
    "c6_previous_day_delta",
    f"""WITH {DAY_SCORES_SQL} SELECT a.user_id, strftime(a.d, '%Y-%m-%d') AS day, round(a.score, 6) AS score, round(a.score - b.score, 6) AS delta
    FROM ds a LEFT JOIN ds b ON a.user_id = b.user_id AND b.d = a.d - 1""",
)
def c6(spark, sf):
    d = J.previous_day(day_scores(spark, sf), "user_id", "day", "score")
    return d.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("score", 6).alias("score"), F.round("delta", 6).alias("delta"))


@query(
    "c7_peers_on_asset",
    f"""WITH {BOARD_SQL}, p AS (SELECT norad_id, asset_norad, pair_risk, row_number() OVER (PARTITION BY asset_norad ORDER BY pair_risk DESC, norad_id) AS r
      FROM b WHERE asset_norad IS NOT NULL),
    q AS (SELECT a.norad_id, a.asset_norad, o.norad_id AS peer, row_number() OVER (PARTITION BY a.norad_id ORDER BY o.r) AS rank
      FROM p a JOIN p o ON a.asset_norad = o.asset_norad AND a.norad_id <> o.norad_id)
    SELECT norad_id, asset_norad, peer, rank FROM q WHERE rank <= 4""",
)
def c7(spark, sf):
    p = board(spark, sf).where("asset_norad IS NOT NULL").select("norad_id", "asset_norad", "pair_risk")
    return J.top_peers(p, "norad_id", "asset_norad", "pair_risk", 4).select("norad_id", "asset_norad", "peer", "rank")


@query(
    "c8_fold_assignment",
    f"""WITH {CASES_SQL}, f AS (SELECT id, norad_id, t_peak, unnest(generate_series(t_start::TIMESTAMP, t_end::TIMESTAMP, INTERVAL 3 DAY)) AS as_of FROM cases),
    ev AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
    w AS (SELECT user_id, ts, pos FROM ev WHERE pos >= 20),
    cuts AS (SELECT DISTINCT as_of FROM f),
    tr AS (SELECT as_of, count(*) AS n_train FROM cuts JOIN w ON w.ts < as_of - INTERVAL 1 DAY AND w.user_id % 3 <> 1 AND (w.pos - 20) % 3 = 0 GROUP BY 1),
    tg AS (SELECT norad_id, as_of, max(pos) AS target_pos FROM (SELECT DISTINCT norad_id, as_of FROM f) JOIN w ON w.user_id = norad_id AND w.ts <= as_of GROUP BY ALL)
    SELECT id, norad_id, strftime(as_of, '%Y-%m-%d') AS asof, coalesce(n_train, 0) AS n_train, target_pos
    FROM f LEFT JOIN tr USING (as_of) LEFT JOIN tg USING (norad_id, as_of)""",
)
def c8(spark, sf):
    from driftline.operators.windows import numbered
    from driftline.plans.inputs import role

    folds = J.explode_folds(event_cases(spark, sf), step_days=3)
    ends = numbered(events(spark, sf), "user_id", "ts", ["event_id"]).where("pos >= 20").select(
        F.col("user_id").alias("norad_id"), "ts", "pos"
    )
    anchors = ends.where((role(F.col("norad_id")) != "suspect") & ((F.col("pos") - 20) % 3 == 0))
    out = J.assign_folds(folds, anchors, ends, holdout_days=1)
    return out.select("id", "norad_id", F.date_format("asof", "yyyy-MM-dd").alias("asof"), "n_train", "target_pos")


@query(
    "c9_same_peak_placebos",
    f"""WITH {CASES_SQL}, pl AS (SELECT norad_id, id, t_peak, row_number() OVER (PARTITION BY t_peak ORDER BY norad_id, id) AS r FROM cases WHERE type LIKE 'placebo%'),
    j AS (SELECT c.id, c.norad_id, p.id AS placebo_id, p.norad_id AS placebo, row_number() OVER (PARTITION BY c.id, c.norad_id ORDER BY p.r) AS rank
      FROM cases c JOIN pl p ON c.t_peak = p.t_peak AND c.norad_id <> p.norad_id)
    SELECT id, norad_id, placebo_id, placebo, rank FROM j WHERE rank <= 3""",
)
def c9(spark, sf):
    c = event_cases(spark, sf).select("id", F.explode("norad_ids").alias("norad_id"), "t_peak", "type")
    return J.same_peak(c, 3)


@query(
    "c10_new_today",
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE ts::DATE = '2024-01-20'), b AS (SELECT DISTINCT user_id FROM events WHERE ts::DATE = '2024-01-19')
    SELECT user_id FROM a WHERE user_id NOT IN (SELECT user_id FROM b)""",
)
def c10(spark, sf):
    e = events(spark, sf, "user_id", "ts")
    day = lambda d: e.where(
        (F.col("ts") >= F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz")) & (F.col("ts") < F.lit(f"2024-01-{d + 1} 00:00:00").cast("timestamp_ntz"))
    ).select("user_id").distinct()
    return day(20).join(day(19), "user_id", "left_anti")


@query(
    "c11_interval_match",
    """WITH RECURSIVE e AS (SELECT user_id, event_id % 2 AS cls, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    p AS (SELECT user_id, cls, i, row_number() OVER (PARTITION BY user_id, cls ORDER BY i) AS k FROM e WHERE event_type = 'error'),
    t AS (SELECT user_id, cls, i FROM e WHERE event_type = 'signup'),
    r AS (SELECT user_id, cls, 0::BIGINT AS k, -1000::BIGINT AS last, 0::BIGINT AS tp FROM p WHERE k = 1
      UNION ALL SELECT user_id, cls, k, coalesce(hit, last), tp + (hit IS NOT NULL)::INT FROM (
        SELECT r.user_id, r.cls, p.k, any_value(r.last) AS last, any_value(r.tp) AS tp, min(t.i) AS hit
        FROM r JOIN p ON p.user_id = r.user_id AND p.cls = r.cls AND p.k = r.k + 1
          LEFT JOIN t ON t.user_id = r.user_id AND t.cls = r.cls AND t.i > r.last AND t.i BETWEEN p.i - 6 AND p.i + 6 GROUP BY r.user_id, r.cls, p.k)),
    h AS (SELECT user_id, sum(tp) AS tp FROM (SELECT user_id, cls, max(tp) AS tp FROM r GROUP BY ALL) GROUP BY 1),
    c AS (SELECT user_id, count_if(event_type = 'error') AS np, count_if(event_type = 'signup') AS nt FROM e WHERE event_type IN ('error', 'signup') GROUP BY 1)
    SELECT user_id, coalesce(tp, 0)::BIGINT AS tp, (np - coalesce(tp, 0))::BIGINT AS fp, (nt - coalesce(tp, 0))::BIGINT AS fn FROM c LEFT JOIN h USING (user_id)""",
)
def c11(spark, sf):
    """Greedy one-to-one match of two event types of a user within six positions."""
    from driftline.operators.windows import numbered

    e = numbered(events(spark, sf, "user_id", "ts", "event_id", "event_type"), "user_id", "ts", ["event_id"])
    pred = e.where("event_type = 'error'").select("user_id", (F.col("event_id") % 2).alias("cls"), F.col("pos").alias("i"))
    truth = e.where("event_type = 'signup'").select("user_id", (F.col("event_id") % 2).alias("cls"), F.col("pos").alias("i"))
    return J.match_counts(pred, truth, "user_id", ["cls"], "i", 6)


@query(
    "c12_nearest_fold",
    f"""WITH {CASES_SQL}, {DAY_SCORES_SQL}, j AS (SELECT id, norad_id, t_peak, d, score FROM cases JOIN ds ON norad_id = user_id AND d BETWEEN t_start AND t_end)
    SELECT id, norad_id, round(min_by(score, (abs(d - t_peak), d)), 6) AS score_at_peak FROM j GROUP BY ALL""",
)
def c12(spark, sf):
    j = J.daily_folds(event_cases(spark, sf), day_scores(spark, sf), "user_id", "day")
    near = F.struct(F.abs(F.datediff("day", "t_peak")), F.col("day"))
    return j.groupBy("id", F.col("user_id").alias("norad_id")).agg(F.round(F.min_by("score", near), 6).alias("score_at_peak"))


@query(
    "c13_triage_overlay",
    f"""WITH {BOARD_SQL}, t AS (SELECT user_id, max_by(event_type, event_id) AS st FROM events GROUP BY 1)
    SELECT norad_id, coalesce(upper(st), 'OPEN') AS triage FROM b LEFT JOIN t ON norad_id = user_id""",
)
def c13(spark, sf):
    t = events(spark, sf, "user_id", "event_id", "event_type").groupBy(F.col("user_id").alias("norad_id")).agg(
        F.upper(F.max_by("event_type", "event_id")).alias("triage")
    )
    return board(spark, sf).select("norad_id").join(t, "norad_id", "left").select("norad_id", F.coalesce("triage", F.lit("OPEN")).alias("triage"))


@query(
    "k1_union_dedup",
    """WITH u AS (SELECT user_id, date_trunc('hour', ts) AS t, value, 1 AS p, event_id FROM events WHERE event_type = 'view'
      UNION ALL SELECT user_id, date_trunc('hour', ts), value, 2, event_id FROM events WHERE event_type = 'click')
    SELECT user_id, epoch_us(t) AS t_us, max_by(value, (p, event_id)) AS value FROM u GROUP BY user_id, t""",
)
def k1(spark, sf):
    from driftline.operators.skew import keep_last

    e = events(spark, sf, "user_id", "ts", "value", "event_id", "event_type").withColumn("t", F.date_trunc("hour", "ts"))
    u = e.where("event_type = 'view'").withColumn("p", F.lit(1)).unionByName(e.where("event_type = 'click'").withColumn("p", F.lit(2)))
    return keep_last(u, ["user_id", "t"], [F.desc("p"), F.desc("event_id")]).select("user_id", micros("t").alias("t_us"), "value")


@query(
    "k2_id_set_algebra",
    """(SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 UNION SELECT c_custkey FROM customer WHERE c_nationkey = 4)
    INTERSECT SELECT user_id FROM events""",
)
def k2(spark, sf):
    c = table(spark, sf, "customer")
    ids = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id")).union(c.where("c_nationkey = 4").select("c_custkey")).distinct()
    return ids.intersect(events(spark, sf, "user_id"))


@query(
    "k3_missing_ids",
    "SELECT c_custkey AS id FROM customer EXCEPT SELECT user_id FROM events",
)
def k3(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).subtract(events(spark, sf, "user_id"))
