"""Board orderings, top-k, distributions, walk-forward metrics, panels and claims (F, G, J8, V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import scalars as X
from driftline.operators import calibration as CAL
from driftline.operators import joins as J
from driftline.operators import skew
from driftline.operators import validation as V
from driftline.operators import windows as W
from driftline.plans.inputs import BOARD_SQL, ROLE_SQL, STATUS_SQL, Z20_SQL, board, events, micros, status_board
from driftline.plans.q_joins import DAY_SCORES_SQL, day_scores
from driftline.plans.q_policy import RISK_SQL, TIER_IN, facet_filter, label_inputs
from driftline.plans.q_sources import CASES_SQL, CAT_SQL, event_cases, watchlist
from driftline.plans.registry import query
from driftline.session import table

SORT_COLS = ("norad_id", "is_detection", "is_anomaly", "score")


@query("f1_board_sort", f"WITH {STATUS_SQL} SELECT norad_id, is_detection, is_anomaly, score FROM sb ORDER BY is_detection DESC, is_anomaly DESC, score DESC, norad_id")
def f1(spark, sf):
    return status_board(spark, sf).select(*SORT_COLS).orderBy(F.desc("is_detection"), F.desc("is_anomaly"), F.desc("score"), "norad_id")


def risk_rows(spark, sf):
    """Scored (suspect, asset) rows: supplier against part, risk from the line's formula."""
    r = X.pair_risk(F.col("dist"), F.col("coint"), F.col("lz") - 0.5, F.col("dfa"))
    return label_inputs(spark, sf).select(
        "l_suppkey", "dist", F.round(r["pair_risk"], 6).alias("risk"), (F.col("l_orderkey") * 10 + F.col("line")).alias("pair")
    )


RISK_ROWS_SQL = RISK_SQL + """, rr AS (SELECT l_orderkey*10 + line AS pair, l_suppkey, dist, round(risk, 6) AS risk FROM r3)"""


@query(
    "f2_top_assets_per_suspect",
    f"""WITH {RISK_ROWS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY risk DESC, dist, pair) AS r FROM rr)
    SELECT l_suppkey, pair, risk, dist FROM t WHERE r <= 3 ORDER BY risk DESC, dist, pair LIMIT 80""",
)
def f2(spark, sf):
    top = skew.latest_rows(risk_rows(spark, sf), ["l_suppkey"], [F.desc("risk"), F.asc("dist"), F.asc("pair")], 3)
    return top.orderBy(F.desc("risk"), "dist", "pair").limit(80).select("l_suppkey", "pair", "risk", "dist")


@query(
    "f3_best_pair",
    f"""WITH {RISK_ROWS_SQL} SELECT l_suppkey, max_by(pair, (risk, -dist, -pair)) AS pair, max(risk) AS risk FROM rr GROUP BY 1""",
)
def f3(spark, sf):
    order = F.struct("risk", -F.col("dist"), -F.col("pair"))
    return risk_rows(spark, sf).groupBy("l_suppkey").agg(F.max_by("pair", order).alias("pair"), F.max("risk").alias("risk"))


@query(
    "f4_tier_sort",
    f"""WITH {STATUS_SQL}, t AS (SELECT *, CASE WHEN status = 'CALIBRATION_BASELINE' OR is_calibration THEN 3
      WHEN status = 'PAIR_ELEVATED' AND (risk_level = 'CRITICAL' OR attention >= 0.65 OR pair_risk >= 0.9) THEN 0
      WHEN status = 'PAIR_ELEVATED' OR pair_risk >= 0.55 OR is_detection THEN 1
      WHEN is_anomaly OR status IN ('ANOMALY','ASSET_REGIME_NOISE','CHANGE_RELEVANT','UNRELIABLE_DATA') OR is_health_flag THEN 2 ELSE 3 END AS tier FROM sb)
    SELECT norad_id, tier, is_detection, round(attention, 6) AS attention FROM t ORDER BY is_detection DESC, tier, attention DESC, norad_id""",
)
def f4(spark, sf):
    b = status_board(spark, sf)
    tier = X.threat_rank(X.threat_tier({k: F.col(k) for k in TIER_IN}))
    return b.select("norad_id", tier.alias("tier"), "is_detection", F.round("attention", 6).alias("attention")).orderBy(
        F.desc("is_detection"), "tier", F.desc("attention"), "norad_id"
    )


@query(
    "f5_alert_list",
    f"""WITH {STATUS_SQL} SELECT norad_id, status, round(greatest(0, (attention*25 - (1-attention))/25*0.5), 9) AS kelly FROM sb WHERE status <> 'NOMINAL' ORDER BY kelly DESC, norad_id""",
)
def f5(spark, sf):
    k = X.half_kelly(F.col("attention"), F.lit(25.0))
    return status_board(spark, sf).where("status <> 'NOMINAL'").select("norad_id", "status", F.round(k, 9).alias("kelly")).orderBy(F.desc("kelly"), "norad_id")


@query("f6_top_scores", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def f6(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("f7_last_log_entries", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 80")
def f7(spark, sf):
    return events(spark, sf, "event_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(80).select("event_id", "event_type")


@query(
    "f8_object_search",
    """WITH s AS (SELECT c_custkey, c_name, CASE WHEN c_custkey::VARCHAR = '12' THEN 0 WHEN starts_with(c_custkey::VARCHAR, '12') THEN 1 WHEN contains(upper(c_name), '12') THEN 2 END AS rank FROM customer)
    SELECT c_custkey, rank::BIGINT AS rank FROM s WHERE rank IS NOT NULL ORDER BY rank, c_custkey LIMIT 8""",
)
def f8(spark, sf):
    return search(table(spark, sf, "customer"), "c_custkey", "c_name", "12").select("c_custkey", F.col("rank").cast("bigint").alias("rank"))


@query(
    "f8_name_search",
    """WITH s AS (SELECT p_partkey, CASE WHEN contains(upper(p_name), 'RE') THEN 2 WHEN regexp_matches(upper(p_name), 'R.*E') THEN 3 END AS rank FROM part)
    SELECT p_partkey, rank::BIGINT AS rank FROM s WHERE rank IS NOT NULL ORDER BY rank DESC, p_partkey LIMIT 40""",
)
def f8_name(spark, sf):
    """Search by letters: names that hold the text, or its letters in order; the loosest hits are shown."""
    hits = ranked_hits(table(spark, sf, "part"), "p_partkey", "p_name", "re")
    return hits.orderBy(F.desc("rank"), "p_partkey").limit(40).select("p_partkey", F.col("rank").cast("bigint").alias("rank"))


def ranked_hits(df, key: str, name: str, text: str):
    """Exact id, id prefix, name contains, then name subsequence (letters in order): ``rank`` 0 to 3."""
    import re

    q = text.strip().upper()
    ident = F.col(key).cast("string")
    up = F.upper(name)
    rank = F.when(F.lit(q.isdigit()) & (ident == q), 0).when(F.lit(q.isdigit()) & ident.startswith(q), 1).when(up.contains(q), 2)
    if not q.isdigit():
        rank = rank.when(up.rlike(".*".join(re.escape(c) for c in q)), 3)
    return df.withColumn("rank", rank).where("rank IS NOT NULL")


def search(df, key: str, name: str, text: str, n: int = 8):
    return ranked_hits(df, key, name, text).orderBy("rank", key).limit(n)


# --- distributions and calibration ------------------------------------------------------


@query(
    "g1_score_distribution",
    """SELECT count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
      round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99,
      max(l_extendedprice) AS max FROM lineitem""",
)
def g1(spark, sf):
    d = CAL.distribution(table(spark, sf, "lineitem").select("l_extendedprice"), [], "l_extendedprice")
    return d.select("n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p50", "p90", "p95", "p99")], "max")


CAL_SQL = """sc AS (SELECT l_extendedprice/100000 AS s, CASE l_returnflag WHEN 'R' THEN 'LEO' WHEN 'A' THEN 'GEO' ELSE 'LEO' END AS o FROM lineitem),
    cal AS (SELECT coalesce(o, 'ALL') AS orbit, count(*) AS n, avg(s) AS mean, stddev_pop(s) AS std, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.95) AS p95,
       greatest(0.5, quantile_cont(s, 0.95)) AS thr FROM sc GROUP BY GROUPING SETS ((o), ()))"""


def price_scores(spark, sf):
    li = table(spark, sf, "lineitem")
    o = F.when(F.col("l_returnflag") == "R", "leo").when(F.col("l_returnflag") == "A", "GEO").otherwise("odd")
    return li.select((F.col("l_extendedprice") / 100000).alias("s"), o.alias("o"))


@query(
    "g2_calibration_table",
    f"WITH {CAL_SQL} SELECT orbit, n, round(mean, 6) AS mean, round(std, 6) AS std, round(p50, 6) AS p50, round(p95, 6) AS p95, round(thr, 6) AS thr FROM cal",
)
def g2(spark, sf):
    c = CAL.calibration_table(price_scores(spark, sf), "o", "s")
    return c.select("orbit", "n", *[F.round(x, 6).alias(x) for x in ("mean", "std", "p50", "p95", "thr")])


@query(
    "g3_threshold_lookup",
    f"""WITH {CAL_SQL}, {BOARD_SQL} SELECT norad_id, round(coalesce((SELECT thr FROM cal WHERE orbit = orbit_class), (SELECT thr FROM cal WHERE orbit = 'ALL'), 0.5), 6) AS thr FROM b""",
)
def g3(spark, sf):
    c = CAL.calibration_table(price_scores(spark, sf), "o", "s").select(F.col("orbit").alias("orbit_class"), "thr")
    glob = c.where("orbit_class = 'ALL'").select("thr").scalar()
    b = board(spark, sf).select("norad_id", "orbit_class").join(c, "orbit_class", "left")
    return b.select("norad_id", F.round(F.coalesce("thr", glob, F.lit(0.5)), 6).alias("thr"))


FACETS = {"role": ["suspect", "asset"], "country": ["N1", "N2", "N3", "N4"], "orbit_class": ["LEO"]}


@query(
    "g4_facet_histograms",
    f"""WITH {BOARD_SQL} SELECT 'role' AS facet, role AS value, count(*) AS n FROM b WHERE country IN ('N1','N2','N3','N4') AND orbit_class = 'LEO' GROUP BY 2
    UNION ALL SELECT 'country', country, count(*) FROM b WHERE role IN ('suspect','asset') AND orbit_class = 'LEO' GROUP BY 2
    UNION ALL SELECT 'orbit_class', orbit_class, count(*) FROM b WHERE role IN ('suspect','asset') AND country IN ('N1','N2','N3','N4') GROUP BY 2""",
)
def g4(spark, sf):
    """Each facet counted under all other facets; one pass over the board."""
    b = board(spark, sf)
    parts = []
    for f in FACETS:
        ok = F.lit(True)
        for other, vals in FACETS.items():
            if other != f and vals:
                ok = ok & F.col(other).isin(*vals)
        parts.append(F.when(ok, F.struct(F.lit(f).alias("facet"), F.col(f).alias("value"))))
    return b.select(F.inline(F.array_compact(F.array(*parts)))).groupBy("facet", "value").agg(F.count("*").alias("n")).orderBy("facet", F.desc("n"), "value")


@query(
    "g5_catalog_summary",
    f"""WITH {CAT_SQL}, m AS (SELECT role, count(*) AS n, count(DISTINCT country) AS n_countries FROM cat GROUP BY 1),
    e AS (SELECT CASE user_id % 4 WHEN 0 THEN 'asset' WHEN 1 THEN 'suspect' ELSE 'baseline' END AS role, list_sort(list(epoch_us(ts))) AS l FROM events GROUP BY 1)
    SELECT role, n, n_countries, l[len(l)//2 + 1] AS median_us FROM m JOIN e USING (role)""",
)
def g5(spark, sf):
    m = watchlist(spark, sf).groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("country").alias("n_countries"))
    k = F.col("user_id") % 4
    r = F.when(k == 0, "asset").when(k == 1, "suspect").otherwise("baseline")
    e = events(spark, sf, "user_id", "ts", "event_id").select(r.alias("role"), "ts", "event_id")
    # Upper median of an unbounded group: rows are numbered slot by slot, one position is picked.
    n = skew.positions(e, ["role"], ["ts", "event_id"], F.to_date("ts"), total="total")
    med = n.where(F.col("pos") == F.floor(F.col("total") / 2) + 1).select("role", micros("ts").alias("median_us"))
    return m.join(med, "role")


@query(
    "g6_report_counters",
    f"""WITH {STATUS_SQL} SELECT count(*) AS n_scored, count_if(is_anomaly) AS n_anomalies, count_if(is_detection) AS n_detections, count_if(is_health_flag) AS n_health,
      count_if(outlier) AS n_outliers, count_if(change) AS n_changes, count_if(NOT reliable) AS n_unreliable, count_if(risk_level IN ('ELEVATED','CRITICAL')) AS n_elevated,
      round(sum(greatest(0, (attention*25 - (1-attention))/25*0.5)), 4) AS budget FROM sb""",
)
def g6(spark, sf):
    c = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return status_board(spark, sf).agg(
        F.count("*").alias("n_scored"), c("is_anomaly", "n_anomalies"), c("is_detection", "n_detections"), c("is_health_flag", "n_health"),
        c("outlier", "n_outliers"), c("change", "n_changes"), c("NOT reliable", "n_unreliable"), c("risk_level IN ('ELEVATED','CRITICAL')", "n_elevated"),
        F.round(F.sum(X.half_kelly(F.col("attention"), F.lit(25.0))), 4).alias("budget"),
    )


DRIFT_SQL = f"""{DAY_SCORES_SQL}, ds1 AS (SELECT d, count(*) AS n, avg(score) AS mean, list_sort(list(score)) AS l, max(score) AS mx FROM ds GROUP BY 1),
    ds2 AS (SELECT d, n, round(mean, 4) AS mean, round(l[floor(0.95*(n-1))::INT + 1], 4) AS p95, round(mx, 4) AS mx FROM ds1)"""


def day_stats(spark, sf):
    """Per day: n, mean, nearest-rank p95 and maximum, with changes against the day before."""
    s = day_scores(spark, sf)
    stats = s.groupBy("day").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.max("score"), 4).alias("max"))
    ranked = skew.positions(s, ["day"], ["score", "user_id"], F.floor(F.col("score") * 200), total="total")
    p95 = ranked.where(F.col("pos") == F.floor((F.col("total") - 1) * 0.95) + 1).select("day", F.round("score", 4).alias("p95"))
    d = stats.join(p95, "day")
    prev = d.select(F.date_add("day", 1).alias("day"), F.col("mean").alias("__m"), F.col("p95").alias("__p"))
    return d.join(prev, "day", "left").withColumn("mean_delta", F.round(F.col("mean") - F.col("__m"), 4)).withColumn(
        "p95_delta", F.round(F.col("p95") - F.col("__p"), 4)
    ).drop("__m", "__p")


@query(
    "g7_day_drift",
    f"""WITH {DRIFT_SQL} SELECT strftime(a.d, '%Y-%m-%d') AS day, a.n, a.mean, a.p95, a.mx AS max, round(a.mean - b.mean, 4) AS mean_delta, round(a.p95 - b.p95, 4) AS p95_delta,
      a.p95 > 0.5 AS exceeds FROM ds2 a LEFT JOIN ds2 b ON b.d = a.d - 1""",
)
def g7(spark, sf):
    return day_stats(spark, sf).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "mean", "p95", "max", "mean_delta", "p95_delta", (F.col("p95") > 0.5).alias("exceeds")
    )


@query(
    "g8_history_tail",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
    SELECT user_id, count(*) AS n, max_by(value, r) AS first_v, min_by(value, r) AS last_v, round(min_by(value, r) - max_by(value, r), 6) AS delta, round(avg(value), 6) AS mean FROM t WHERE r <= 7 GROUP BY 1""",
)
def g8(spark, sf):
    t = skew.latest_rows(events(spark, sf), ["user_id"], [F.desc("ts"), F.desc("event_id")], 7)
    o = F.struct("ts", "event_id")
    return t.groupBy("user_id").agg(
        F.count("*").alias("n"), F.min_by("value", o).alias("first_v"), F.max_by("value", o).alias("last_v"),
        F.round(F.max_by("value", o) - F.min_by("value", o), 6).alias("delta"), F.round(F.avg("value"), 6).alias("mean"),
    )


@query(
    "g9_coverage",
    """WITH g AS (SELECT user_id, count(*) AS n, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1)
    SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_ids, count_if(n >= 60) AS n_full, epoch_us(min(a)) AS first_us, epoch_us(max(b)) AS last_us FROM g""",
)
def g9(spark, sf):
    g = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return g.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_ids"), F.count_if(F.col("n") >= 60).alias("n_full"),
        micros(F.min("a")).alias("first_us"), micros(F.max("b")).alias("last_us"),
    )


# --- walk-forward metrics ---------------------------------------------------------------

THR, HIT_DAYS = 0.3, 5
FOLD_SQL = f"""{CASES_SQL}, {DAY_SCORES_SQL}, f AS (SELECT id, norad_id, panel, type, t_peak, d AS as_of, score, score >= {THR} AS is_hit
    FROM cases JOIN ds ON user_id = norad_id AND d BETWEEN t_start AND t_end)"""


def case_folds(spark, sf):
    """Daily as-of scores of every case target inside its window."""
    s = day_scores(spark, sf).select(F.col("user_id").alias("norad_id"), F.col("day").alias("asof"), "score")
    f = J.daily_folds(event_cases(spark, sf), s, "norad_id", "asof")
    return f.select("id", "norad_id", "panel", "type", "t_peak", "asof", "score", (F.col("score") >= THR).alias("is_hit"))


G10_SQL = f"""{FOLD_SQL}, m AS (SELECT id, norad_id, panel, type, t_peak, count(*) AS n_folds, avg(score) AS score_mean, max(score) AS score_max,
      min_by(score, (abs(as_of - t_peak), as_of)) AS score_at_peak, count_if(is_hit AND abs(as_of - t_peak) <= {HIT_DAYS}) AS n_hits,
      count_if(score >= 0.45 AND abs(as_of - t_peak) <= {HIT_DAYS}) > 0 AS soft_hit, min(CASE WHEN is_hit AND as_of <= t_peak THEN as_of END) AS first_hit,
      min(as_of) AS first_fold, count_if(score >= {THR} AND as_of < t_peak) AS n_above FROM f GROUP BY ALL),
    mm AS (SELECT *, n_hits > 0 AS hit, coalesce(first_hit = first_fold, false) AS first_fold_hit, (t_peak - first_hit)::DOUBLE AS lead_days FROM m)"""


@query(
    "g10_target_metrics",
    f"""WITH {G10_SQL} SELECT id, norad_id, n_folds, round(score_mean, 8) AS score_mean, round(score_max, 8) AS score_max, round(score_at_peak, 8) AS score_at_peak, n_hits, hit, soft_hit,
      first_fold_hit, lead_days, n_above FROM mm""",
)
def g10(spark, sf):
    m = V.target_metrics(case_folds(spark, sf), THR, HIT_DAYS)
    return m.select(
        "id", "norad_id", "n_folds", *[F.round(c, 8).alias(c) for c in ("score_mean", "score_max", "score_at_peak")], "n_hits", "hit", "soft_hit",
        "first_fold_hit", "lead_days", F.col("n_above_pre_peak").alias("n_above"),
    )


G11_SQL = f"""pre AS (SELECT id, norad_id, score, row_number() OVER (PARTITION BY id, norad_id ORDER BY as_of) AS r, count(*) OVER (PARTITION BY id, norad_id) AS n
      FROM f WHERE as_of < t_peak),
    pp AS (SELECT id, norad_id, count(*) AS n_pre, avg(score) AS pre_mean, max(score) AS pre_max, avg(CASE WHEN r <= greatest(1, n//3) THEN score END) AS early_mean,
      avg(CASE WHEN r > n - greatest(1, n//3) THEN score END) AS late_mean FROM pre GROUP BY ALL),
    pq AS (SELECT *, late_mean - early_mean AS ramp, late_mean >= 0.42 OR pre_max >= {THR} AS elevated FROM pp)"""


@query(
    "g11_pre_peak_noise",
    f"WITH {FOLD_SQL}, {G11_SQL} SELECT id, norad_id, n_pre, round(pre_mean, 8) AS pre_mean, round(early_mean, 8) AS early_mean, round(late_mean, 8) AS late_mean, round(ramp, 8) AS ramp, elevated FROM pq",
)
def g11(spark, sf):
    p = V.pre_peak_noise(case_folds(spark, sf), THR)
    return p.select("id", "norad_id", "n_pre", *[F.round(c, 8).alias(c) for c in ("pre_mean", "early_mean", "late_mean", "ramp")], "elevated")


def panel_metrics(spark, sf):
    """Metrics of every target, written once: panels and their quantiles read them several times."""
    from driftline.session import materialize

    f = materialize(case_folds(spark, sf), "case-folds")
    return materialize(V.target_panels(f, THR, HIT_DAYS), "target-metrics")


PANEL_SQL = f"""{G10_SQL}, {G11_SQL}, pm AS (SELECT * FROM mm LEFT JOIN pq USING (id, norad_id)),
    ps AS (SELECT coalesce(panel, 'ALL') AS panel, count(*) AS n_targets, count(DISTINCT norad_id) AS n_unique, avg(hit::INT) AS hit_rate, avg(soft_hit::INT) AS soft_hit_rate,
      avg(first_fold_hit::INT) AS first_fold_rate, avg(coalesce(elevated, false)::INT) AS elevated_rate, avg(score_max) AS mean_max, avg(pre_mean) AS mean_pre_peak, avg(ramp) AS mean_ramp,
      avg(lead_days) AS mean_lead, quantile_cont(lead_days, 0.5) AS median_lead, quantile_cont(score_max, 0.95) AS p95_max FROM pm GROUP BY GROUPING SETS ((panel), ()))"""
PANEL_COLS = ("hit_rate", "soft_hit_rate", "first_fold_rate", "elevated_rate", "mean_max", "mean_pre_peak", "mean_ramp", "mean_lead", "median_lead", "p95_max")


@query("g12_panel_summary", f"WITH {PANEL_SQL} SELECT panel, n_targets, n_unique, {', '.join(f'round({c}, 8) AS {c}' for c in PANEL_COLS)} FROM ps")
def g12(spark, sf):
    return V.panel_summary(panel_metrics(spark, sf)).select("panel", "n_targets", "n_unique", *[F.round(c, 8).alias(c) for c in PANEL_COLS])


@query(
    "g13_claims",
    f"""WITH {PANEL_SQL} SELECT a.panel, a.n_targets, round(a.hit_rate, 8) AS hit_rate, round(a.mean_max, 8) AS mean_max, round(a.mean_max - c.mean_max, 8) AS gap,
      a.hit_rate >= 0.55 AND a.mean_max >= {THR} AS interest_supported, c.hit_rate <= 0.15 AND c.mean_max < a.mean_max AS control_supported
    FROM ps a, ps c WHERE c.panel = 'control' AND a.panel NOT IN ('control', 'ALL')""",
)
def g13(spark, sf):
    c = V.claims(V.panel_summary(panel_metrics(spark, sf)), "control", THR)
    return c.select("panel", "n_targets", *[F.round(x, 8).alias(x) for x in ("hit_rate", "mean_max", "gap")], "interest_supported", "control_supported")


@query(
    "g14_detection_f2",
    """WITH t AS (SELECT l_returnflag AS grp, sum(CASE WHEN l_linestatus = 'O' AND l_tax > 0.04 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN l_linestatus = 'O' AND l_tax <= 0.04 THEN 1 ELSE 0 END)::DOUBLE AS fp,
      sum(CASE WHEN l_linestatus = 'F' AND l_tax > 0.04 THEN 1 ELSE 0 END)::DOUBLE AS fn FROM lineitem GROUP BY 1),
    s AS (SELECT *, tp/(tp+fp) AS p, tp/(tp+fn) AS r FROM t)
    SELECT grp, tp::BIGINT AS tp, round(p, 4) AS precision, round(r, 4) AS recall, round(5*p*r/(4*p+r), 4) AS f2 FROM s""",
)
def g14(spark, sf):
    on, hot = F.col("l_linestatus") == "O", F.col("l_tax") > 0.04
    t = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(
        F.count_if(on & hot).alias("tp"), F.count_if(on & ~hot).alias("fp"), F.count_if(~on & hot).alias("fn")
    )
    return t.select("grp", "tp", *V.f2_scores(F.col("tp"), F.col("fp"), F.col("fn")))


@query(
    "g15_separation",
    """WITH x AS (SELECT o_orderkey AS k, o_totalprice/500000 AS s0, (o_custkey % 50)/50.0::DOUBLE AS a, (o_orderkey % 10)/10.0::DOUBLE AS b FROM orders),
    q AS (SELECT quantile_cont(s0, 0.95) AS p95, quantile_cont(s0, 0.5) AS p50, avg(s0) FILTER (WHERE true) AS m FROM x),
    y AS (SELECT 'full' AS block, s0 AS s, s0 FROM x UNION ALL SELECT 'cust', a, s0 FROM x UNION ALL SELECT 'order', b, s0 FROM x),
    z AS (SELECT block, count(*) AS n, avg(s) FILTER (WHERE s0 >= p95) - avg(s) FILTER (WHERE s0 <= p50) AS sep, avg(s0) FILTER (WHERE s0 >= p95) - avg(s0) FILTER (WHERE s0 <= p50) AS fs, corr(s, s0) AS c FROM y, q GROUP BY 1)
    SELECT block, n, round(sep, 6) AS separation, round(fs - sep, 6) AS separation_drop, round(c, 6) AS corr_with_full FROM z""",
)
def g15(spark, sf):
    c = F.col
    x = table(spark, sf, "orders").select(
        c("o_orderkey").alias("k"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("block"), v.alias("score")) for n, v in (("full", c("o_totalprice") / 500000), ("cust", (c("o_custkey") % 50) / 50.0), ("order", (c("o_orderkey") % 10) / 10.0))])),
    )
    return V.separation(x, "block", "full", ["k"])


@query(
    "g16_case_series",
    f"""WITH {FOLD_SQL} SELECT id, norad_id, strftime(as_of, '%Y-%m-%d') AS asof, round(score, 8) AS score, round(max(score) OVER w, 8) AS max_score,
      round(avg(CASE WHEN as_of < t_peak THEN score END) OVER w, 8) AS pre_mean, as_of < t_peak AS shaded FROM f WINDOW w AS (PARTITION BY id, norad_id)""",
)
def g16(spark, sf):
    from pyspark.sql import Window

    pre = F.col("asof") < F.col("t_peak")
    w = Window.partitionBy("id", "norad_id")  # the days of one case
    f = case_folds(spark, sf).withColumn("mx", F.max("score").over(w)).withColumn("pm", F.avg(F.when(pre, F.col("score"))).over(w))
    return f.select(
        "id", "norad_id", F.col("asof").cast("string").alias("asof"), F.round("score", 8).alias("score"), F.round("mx", 8).alias("max_score"), F.round("pm", 8).alias("pre_mean"), pre.alias("shaded")
    )


@query(
    "g17_case_citations",
    f"""WITH {CASES_SQL}, r AS (SELECT norad_id, id, t_peak, type, sources, row_number() OVER (PARTITION BY norad_id ORDER BY t_peak, id) AS r FROM cases WHERE type NOT LIKE 'placebo%')
    SELECT norad_id, id, strftime(t_peak, '%Y-%m-%d') AS t_peak, type, list_aggregate(sources[1:3], 'string_agg', '; ') AS sources FROM r WHERE r <= 3""",
)
def g17(spark, sf):
    c = event_cases(spark, sf).where(~F.col("type").startswith("placebo")).select("id", F.explode("norad_ids").alias("norad_id"), "t_peak", "type", "sources")
    top = skew.latest_rows(c, ["norad_id"], [F.asc("t_peak"), F.asc("id")], 3)
    return top.select("norad_id", "id", F.col("t_peak").cast("string").alias("t_peak"), "type", F.concat_ws("; ", F.slice("sources", 1, 3)).alias("sources"))


# --- board report, validation -----------------------------------------------------------


@query(
    "j8_board_report",
    f"""WITH {STATUS_SQL}, k AS (SELECT *, CASE purpose WHEN 'household' THEN 25.0 ELSE 25.0 END::DOUBLE AS sev FROM sb)
    SELECT norad_id, role, status, round(score, 6) AS anomaly_score, round(attention, 6) AS attention_score, round(greatest(0, (attention*sev - (1-attention))/sev*0.5), 9) AS kelly,
      asset_norad AS pair_asset, CASE WHEN asset_norad IS NOT NULL THEN risk_level END AS pair_level, count(*) OVER () AS n_scored, count_if(is_detection) OVER () AS n_detections FROM k""",
)
def j8(spark, sf):
    b = status_board(spark, sf)
    tot = b.agg(F.count("*").alias("n_scored"), F.count_if("is_detection").alias("n_detections")).select(F.struct("n_scored", "n_detections")).scalar()
    kelly = X.half_kelly(F.col("attention"), X.severity(F.col("purpose")))
    return b.withColumn("t", tot).select(
        "norad_id", "role", "status", F.round("score", 6).alias("anomaly_score"), F.round("attention", 6).alias("attention_score"), F.round(kelly, 9).alias("kelly"),
        F.col("asset_norad").alias("pair_asset"), F.when(F.col("asset_norad").isNotNull(), F.col("risk_level")).alias("pair_level"), "t.n_scored", "t.n_detections",
    )


@query(
    "v1_mann_whitney",
    """WITH x AS (SELECT l_extendedprice AS v, l_returnflag = 'R' AS g FROM lineitem), r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1)/2.0::DOUBLE AS rk FROM x)
    SELECT count_if(g) AS n_a, count_if(NOT g) AS n_b, sum(CASE WHEN g THEN rk END) - count_if(g)*(count_if(g) + 1)/2.0::DOUBLE AS u FROM r""",
)
def v1(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("v"), (F.col("l_returnflag") == "R").alias("g"))
    return CAL.mann_whitney_u(x, "g", "v").select("n_a", "n_b", "u")


@query("v1_mann_whitney_p")
def v1p(spark, sf):
    """Interest against control: maxima of the case targets, with the one-sided p-value."""
    from driftline.session import materialize

    # Ranks read the maxima twice.
    m = materialize(V.target_metrics(case_folds(spark, sf), THR, HIT_DAYS).select("score_max", "is_placebo"), "target-maxima")
    u = CAL.mann_whitney_u(m.select(F.col("score_max").alias("v"), (~F.col("is_placebo")).alias("g")), "g", "v")
    return CAL.with_p_value(u).select("n_a", "n_b", "u", F.round("p_value", 8).alias("p_value"))


@query("v2_walk_forward")
def v2(spark, sf):
    """Whole walk-forward: folds, past-only forests, target scores, metrics, panels."""
    from driftline.plans.q_models import fold_scores
    from driftline.session import materialize

    f = materialize(fold_scores(spark, sf).select("id", "norad_id", "panel", "type", "t_peak", "asof", "score", "is_hit"), "walk-forward")
    m = materialize(V.target_panels(f, 0.5, 45), "target-metrics")
    return V.panel_summary(m).select("panel", "n_targets", "n_unique", *[F.round(c, 6).alias(c) for c in PANEL_COLS])


@query("v3_detection_benchmark")
def v3(spark, sf):
    """Candidate peaks capped by each object's regime count, matched to labels of their own class, pooled F2."""
    from driftline.operators.regimes import series_regime_count
    from driftline.session import materialize

    rows = W.numbered(events(spark, sf, "user_id", "ts", "event_id", "value", "event_type"), "user_id", "ts", ["event_id"])
    rows = materialize(rows, "benchmark-rows")
    peaks = materialize(W.candidate_peaks(rows, "user_id", "value"), "peaks")
    cap = series_regime_count(rows, "user_id", "value", h=3.0).select("user_id", F.greatest(F.lit(1), F.col("changes") + 1).alias("cap"))
    numbered = skew.positions(peaks, ["user_id"], ["i"], F.floor(F.col("i") / 4096), "k")
    # Direction and type of a candidate are constants, so its class is the node.
    pred = numbered.join(cap, "user_id").where(F.col("k") <= F.col("cap")).select("user_id", "node", "i")
    node = F.when(F.col("event_id") % 2 == 0, "IK").otherwise("ID")
    truth = rows.where("event_type = 'error' AND event_id % 3 = 0").select("user_id", node.alias("node"), F.col("pos").alias("i"))
    per = J.match_counts(materialize(pred, "pred"), truth, "user_id", ["node"], "i", 6)
    t = per.agg(F.count("*").alias("objects"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return t.select("objects", "tp", "fp", "fn", *V.f2_scores(F.col("tp"), F.col("fp"), F.col("fn")))


@query(
    "v4_health_record",
    f"""WITH {DRIFT_SQL}, det AS (SELECT user_id, d FROM ds WHERE score >= 0.6),
    nw AS (SELECT a.d, count(*) AS n_new FROM det a WHERE NOT EXISTS (SELECT 1 FROM det b WHERE b.user_id = a.user_id AND b.d = a.d - 1) GROUP BY 1)
    SELECT strftime(a.d, '%Y-%m-%d') AS day, substr(sha256('mean|p95|max'), 1, 16) AS schema_hash, a.mean, a.p95, round(a.mean - b.mean, 4) AS mean_delta, coalesce(n_new, 0) AS n_new, a.p95 > 0.5 AS exceeds
    FROM ds2 a LEFT JOIN ds2 b ON b.d = a.d - 1 LEFT JOIN nw ON nw.d = a.d""",
)
def v4(spark, sf):
    """Daily health: provenance hash, score statistics, drift and newly detected objects."""
    det = day_scores(spark, sf).where("score >= 0.6").select("user_id", "day")
    new = det.join(det.select("user_id", F.date_add("day", 1).alias("day")), ["user_id", "day"], "left_anti").groupBy("day").agg(F.count("*").alias("n_new"))
    h = X.schema_hash(F.array(*[F.lit(c) for c in ("mean", "p95", "max")]))
    return day_stats(spark, sf).join(new, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), h.alias("schema_hash"), "mean", "p95", "mean_delta", F.coalesce("n_new", F.lit(0).cast("bigint")).alias("n_new"), (F.col("p95") > 0.5).alias("exceeds")
    )


@query(
    "flagship_change_board",
    f"""WITH {Z20_SQL}, l AS (SELECT * FROM zz WHERE pos = n),
    x AS (SELECT user_id, unnest(z) AS z, unnest(range(1, 20)) AS i FROM l),
    p AS (SELECT user_id, i, sum(z - 0.5) OVER w AS up, sum(-z - 0.5) OVER w AS dn, 0.2*pow(0.8, i)*sum(z*pow(0.8, -i)) OVER w AS e FROM x WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    s AS (SELECT user_id, up - least(0, min(up) OVER w) AS sp, dn - least(0, min(dn) OVER w) AS sn, e FROM p WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    m AS (SELECT user_id, least(1, greatest(max(sp), max(sn))/4)::DOUBLE AS cusum, least(1, max(abs(e))/(3*sqrt(0.2::DOUBLE/1.8)))::DOUBLE AS ewma FROM s GROUP BY 1),
    t AS (SELECT *, (cusum + ewma)/2 AS score, greatest(0.5, quantile_cont((cusum + ewma)/2, 0.95) OVER ()) AS thr, {ROLE_SQL} AS role FROM m)
    SELECT user_id, role, round(cusum, 6) AS cusum, round(ewma, 6) AS ewma, round(score, 6) AS score, round(thr, 6) AS thr, score >= thr AS outlier FROM t""",
)
def flagship(spark, sf):
    """Dedup, minimum history, latest 20-row window, change detectors, threshold, ranking."""
    from driftline.functions import series as S
    from driftline.plans.inputs import role
    from driftline.plans.q_policy import min_history
    from driftline.session import materialize

    e = skew.keep_last(events(spark, sf), ["user_id", "ts"], [F.desc("event_id")])
    w = W.latest_windows(min_history(e, "user_id", 20), "user_id", "ts", ["value"], ["event_id"])
    z = S.robust_innovations(w, "value_w")
    d = z.select(
        "user_id", S.page_cusum(F.col("z")).alias("cusum"), S.ewma_chart(F.col("z")).alias("ewma")
    ).withColumn("score", (F.col("cusum") + F.col("ewma")) / 2)
    # Scores feed the threshold and the board; they are computed once.
    d = materialize(d, "flagship")
    p95 = skew.exact_quantiles(d, [], "score", {"p95": 0.95}).select("p95").scalar()
    b = d.withColumn("thr", F.greatest(F.lit(0.5), p95)).withColumn("role", role(F.col("user_id")))
    return b.select(
        "user_id", "role", F.round("cusum", 6).alias("cusum"), F.round("ewma", 6).alias("ewma"), F.round("score", 6).alias("score"), F.round("thr", 6).alias("thr"),
        (F.col("score") >= F.col("thr")).alias("outlier"),
    ).orderBy(F.desc("score"), "user_id")
