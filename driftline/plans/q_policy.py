"""Filters, rules and scalar formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import scalars as X
from driftline.functions import series as S
from driftline.operators import windows as W
from driftline.plans.inputs import BOARD_SQL, EL_SQL, STATUS_SQL, board, elements, events, status_board
from driftline.plans.q_sources import CAT_SQL, CHUNK_SQL, marked_documents, watchlist
from driftline.plans.registry import query
from driftline.session import table
from driftline.sources import catalogs as C
from driftline.sources import text as TX


@query(
    "b1_filter_ids",
    f"""WITH {CAT_SQL} SELECT norad_id, role FROM cat WHERE role IN ('asset','suspect') AND norad_id IN (SELECT user_id FROM events)""",
)
def b1(spark, sf):
    c = watchlist(spark, sf).where(F.col("role").isin("asset", "suspect"))
    ids = events(spark, sf, "user_id").select(F.col("user_id").alias("norad_id")).distinct()
    return c.join(ids, "norad_id", "left_semi").select("norad_id", "role")


@query(
    "b2_training_ids",
    f"""WITH {CAT_SQL} SELECT norad_id FROM cat WHERE role IN ('baseline','asset') AND purpose <> 'commercial'
    AND NOT contains(upper(name), 'STARLINK') AND norad_id IN (SELECT user_id FROM events)""",
)
def b2(spark, sf):
    avail = events(spark, sf, "user_id").select(F.col("user_id").alias("norad_id"))
    return C.training_ids(watchlist(spark, sf), avail)


@query(
    "b3_min_history",
    "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 65)",
)
def b3(spark, sf):
    return min_history(events(spark, sf, "event_id", "user_id"), "user_id", 65)


def min_history(df, key: str, n: int):
    """Rows of entities with at least ``n`` rows; counts are combined map-side."""
    enough = df.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= n)
    return df.join(enough.select(key), key, "left_semi")


@query(
    "b4_past_only",
    """SELECT event_id, user_id, value FROM events WHERE ts < TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-05'""",
)
def b4(spark, sf):
    return past_only(events(spark, sf), "ts", "2024-01-20 00:00:00", "2024-01-05 00:00:00").select(
        "event_id", "user_id", "value"
    )


def past_only(df, ts: str, before: str | None = None, after: str | None = None):
    lit = lambda s: F.lit(s).cast(df.schema[ts].dataType)
    if before:
        df = df.where(F.col(ts) < lit(before))
    if after:
        df = df.where(F.col(ts) >= lit(after))
    return df


@query(
    "b5_facet_filter",
    f"WITH {BOARD_SQL} SELECT norad_id FROM b WHERE role IN ('suspect','asset') AND orbit_class IN ('LEO')",
)
def b5(spark, sf):
    return facet_filter(board(spark, sf), {"role": ["suspect", "asset"], "country": [], "orbit_class": ["LEO"]}).select("norad_id")


def facet_filter(df, facets, skip: str | None = None):
    """Conjunction of facet lists; an empty list sets no limit."""
    for c, values in facets.items():
        if values and c != skip:
            df = df.where(F.col(c).isin(*values))
    return df


@query(
    "b6_data_quality",
    f"""WITH {EL_SQL}, g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER w)/3.6e9 AS gap, abs(sma - lag(sma) OVER w) AS st
        FROM el WINDOW w AS (PARTITION BY norad_id ORDER BY ts, event_id)),
    p AS (SELECT norad_id, count(*) AS n, max(gap) AS gap, max(st) AS st, max_by(mm, (ts, event_id)) AS mm,
        greatest(0, (epoch_us(TIMESTAMP '2024-02-01 12:00:00') - epoch_us(max(ts)))/3.6e9) AS age FROM g GROUP BY 1),
    s AS (SELECT *, 1 - CASE WHEN age > 72 THEN 0.35 WHEN age > 36 THEN 0.15 ELSE 0 END - CASE WHEN gap > 168 THEN 0.3 WHEN gap > 72 THEN 0.15 ELSE 0 END
        - CASE WHEN st > 200 THEN 0.25 ELSE 0 END - CASE WHEN NOT (mm > 0.5 AND mm < 20) THEN 0.4 ELSE 0 END AS sc FROM p)
    SELECT norad_id, round(CASE WHEN n < 20 THEN 0 ELSE sc END, 6)::DOUBLE AS score, round(gap, 4) AS max_gap,
      concat_ws(',', CASE WHEN age > 72 THEN 'stale' WHEN age > 36 THEN 'aging' END, CASE WHEN gap > 72 THEN 'gap' END) AS issues,
      sc >= 0.45 AS reliable FROM s""",
)
def b6(spark, sf):
    ref = F.lit("2024-02-01 12:00:00").cast("timestamp")
    q = W.data_quality(elements(spark, sf), "norad_id", "ts", "sma", "mm", ref, ["event_id"])
    return q.select(
        "norad_id", F.round("score", 6).alias("score"), F.round("max_gap", 4).alias("max_gap"),
        F.concat_ws(",", "issues").alias("issues"), "reliable",
    )


LABEL_SQL = """f AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, l_suppkey, (l_quantity*7) % 300 AS dist, (l_extendedprice % 600)/100 AS dl,
      (l_partkey % 100)/100.0::DOUBLE AS dfa, (l_suppkey % 12)/10.0::DOUBLE AS lz, l_discount*10 AS cusum, l_tax*2 AS coint,
      l_linenumber % 4 AS ch, (l_partkey % 30)/10.0::DOUBLE AS sh, (l_orderkey % 10)/10.0::DOUBLE AS sc,
      CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS storm, (l_suppkey % 40)::DOUBLE AS ap, 100 + (l_partkey % 100)::DOUBLE AS f107 FROM lineitem),
    g AS (SELECT *, storm >= 0.5 OR ap >= 30 OR f107 >= 180 AS drag FROM f)"""


def label_inputs(spark, sf):
    li = table(spark, sf, "lineitem")
    c = F.col
    return li.select(
        "l_orderkey", c("l_linenumber").cast("bigint").alias("line"), "l_suppkey", ((c("l_quantity") * 7) % 300).alias("dist"),
        ((c("l_extendedprice") % 600) / 100).alias("delta"), ((c("l_partkey") % 100) / 100.0).alias("dfa"),
        ((c("l_suppkey") % 12) / 10.0).alias("lz"), (c("l_discount") * 10).alias("cusum"), (c("l_tax") * 2).alias("coint"),
        (c("l_linenumber") % 4).alias("changes"), ((c("l_partkey") % 30) / 10.0).alias("shannon"),
        ((c("l_orderkey") % 10) / 10.0).alias("score"), F.when(c("l_returnflag") == "R", 1.0).otherwise(0.0).alias("storm"),
        (c("l_suppkey") % 40).cast("double").alias("ap"), (F.lit(100.0) + c("l_partkey") % 100).alias("f107"),
    )


LABEL_KEYS = ("dist", "delta", "dfa", "lz", "cusum", "coint", "changes", "shannon", "score", "storm", "ap", "f107")


@query(
    "b7_weak_labels",
    f"""WITH {LABEL_SQL} SELECT l_orderkey, line, CASE
      WHEN dist < 25 AND (dl > CASE WHEN drag THEN 3.0 ELSE 2.0 END OR dfa > 0.6 OR coint < 0.05 OR sc > 0.55)
        AND NOT (drag AND dl <= 2.5 AND coint >= 0.05 AND dist >= 15) THEN 3
      WHEN dl > CASE WHEN drag THEN 5.0 ELSE 4.0 END AND dist < 80 THEN 3
      WHEN coint < 0.05 AND dist < 40 AND dfa > 0.55 THEN 3
      WHEN dist < 150 AND (dl > 1 OR dfa > 0.7 OR coint < 0.08) THEN 2
      WHEN dl > CASE WHEN drag THEN 2.5 ELSE 2.0 END AND dist < 200 THEN 2
      WHEN dfa > 0.65 AND lz > 0.9 AND dist < 250 THEN 2
      WHEN ch >= 2 AND dist < 120 THEN 2
      WHEN coint < 0.05 AND dist < 80 THEN 2
      WHEN dfa > 0.7 AND sh > 1.5 AND dl > 1 THEN 2
      WHEN drag AND dl < 1.2 AND dist > 150 AND cusum < 0.9 THEN 0
      WHEN cusum >= 0.7 AND dl > 0.8 THEN 1
      WHEN dl > CASE WHEN drag THEN 2.0 ELSE 1.5 END THEN 1
      WHEN ch >= 2 AND dl > 0.5 THEN 1
      WHEN sc > 0.55 AND dist > 200 THEN 1 ELSE 0 END AS label FROM g""",
)
def b7(spark, sf):
    f = label_inputs(spark, sf)
    return f.select("l_orderkey", "line", X.weak_label({k: F.col(k) for k in LABEL_KEYS}).alias("label"))


@query(
    "b8_status",
    f"WITH {STATUS_SQL} SELECT norad_id, status, is_detection, is_health_flag, is_anomaly FROM sb",
)
def b8(spark, sf):
    return status_board(spark, sf).select("norad_id", "status", "is_detection", "is_health_flag", "is_anomaly")


@query(
    "b9_relevance",
    f"""WITH {BOARD_SQL} SELECT norad_id, score >= CASE orbit_class WHEN 'GEO' THEN 0.6 WHEN 'MEO' THEN 0.55 ELSE 0.5 END AS outlier,
    coalesce(score - prev_score >= 0.08 AND score >= 0.85*0.55, false) AS change FROM b""",
)
def b9(spark, sf):
    o = F.col("orbit_class")
    thr = F.when(o == "GEO", 0.6).when(o == "MEO", 0.55).otherwise(0.5)
    return relevance(board(spark, sf), thr, F.lit(0.55)).select("norad_id", "outlier", "change")


def relevance(df, threshold, elevated, delta: float = 0.08):
    """Score at or above its threshold; day-over-day rise while near the elevated level."""
    rise = (F.col("score") - F.col("prev_score") >= delta) & (F.col("score") >= elevated * 0.85)
    return df.withColumn("outlier", F.col("score") >= threshold).withColumn("change", F.coalesce(rise, F.lit(False)))


@query(
    "b10_thresholds",
    """WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0.7 END::DOUBLE AS explicit, CASE WHEN o_orderkey % 3 = 0 THEN 0.6 END::DOUBLE AS rec,
      CASE WHEN o_orderkey % 2 = 0 THEN 0.58 END::DOUBLE AS p95, CASE WHEN o_orderkey % 7 = 0 THEN 0.52 END::DOUBLE AS p90 FROM orders)
    SELECT o_orderkey, coalesce(explicit, rec, p95, 0.5) AS hard,
      coalesce(p90, p95, greatest(0.45, coalesce(explicit, rec, p95, 0.5) - 0.05)) AS elevated FROM m""",
)
def b10(spark, sf):
    k = F.col("o_orderkey")
    m = table(spark, sf, "orders").select(
        k, F.when(k % 5 == 0, 0.7).alias("explicit"), F.when(k % 3 == 0, 0.6).alias("rec"),
        F.when(k % 2 == 0, 0.58).alias("p95"), F.when(k % 7 == 0, 0.52).alias("p90"),
    )
    hard, elevated = resolve_thresholds(F.col("explicit"), F.col("rec"), F.col("p95"), F.col("p90"))
    return m.select(k, hard.alias("hard"), elevated.alias("elevated"))


def resolve_thresholds(explicit, recommended, p95, p90):
    """Explicit, then calibrated, then p95, then 0.50; elevated is p90, then p95, then hard - 0.05."""
    hard = F.coalesce(explicit, recommended, p95, F.lit(0.5))
    return hard, F.coalesce(p90, p95, F.greatest(F.lit(0.45), hard - 0.05))


TIER_IN = ("status", "attention", "pair_risk", "risk_level", "is_anomaly", "is_calibration", "is_detection", "is_health_flag")


@query(
    "b11_threat_tier",
    f"""WITH {STATUS_SQL} SELECT norad_id, CASE WHEN status = 'CALIBRATION_BASELINE' OR is_calibration THEN 'NOMINAL'
      WHEN status = 'PAIR_ELEVATED' AND (risk_level = 'CRITICAL' OR attention >= 0.65 OR pair_risk >= 0.9) THEN 'HOSTILE'
      WHEN status = 'PAIR_ELEVATED' OR pair_risk >= 0.55 OR is_detection THEN 'SUSPECT'
      WHEN is_anomaly OR status IN ('ANOMALY','ASSET_REGIME_NOISE','CHANGE_RELEVANT','UNRELIABLE_DATA') OR is_health_flag THEN 'ANOMALY'
      ELSE 'NOMINAL' END AS tier,
      CASE WHEN status = 'PAIR_ELEVATED' AND (risk_level = 'CRITICAL' OR attention >= 0.65 OR pair_risk >= 0.9) THEN 'HOSTILE'
      WHEN status = 'PAIR_ELEVATED' OR pair_risk >= 0.55 THEN 'SUSPECT' WHEN is_anomaly OR status IN ('ANOMALY','UNRELIABLE_DATA') THEN 'ANOMALY'
      ELSE 'NOMINAL' END AS report_tier FROM sb""",
)
def b11(spark, sf):
    b = status_board(spark, sf)
    cols = {k: F.col(k) for k in TIER_IN}
    return b.select("norad_id", X.threat_tier(cols).alias("tier"), X.threat_tier(cols, "report").alias("report_tier"))


@query(
    "b12_bands",
    """SELECT event_id, CASE WHEN s < 0.15 THEN 'very low' WHEN s < 0.35 THEN 'low' WHEN s < 0.55 THEN 'moderate' WHEN s < 0.75 THEN 'high' ELSE 'very high' END AS score_band,
      CASE WHEN ap >= 45 OR f >= 180 THEN 'very active' WHEN f >= 120 THEN 'active' WHEN f >= 80 THEN 'fairly quiet' ELSE 'quiet' END AS solar_band,
      CASE WHEN ap >= 50 OR f >= 200 THEN 'high' WHEN ap >= 20 OR f >= 150 THEN 'moderate' ELSE 'quiet' END AS activity,
      CASE WHEN s >= 0.7 THEN 'persistent' WHEN s <= 0.4 THEN 'mean_reverting' ELSE 'none' END AS persistence
    FROM (SELECT event_id, (value % 100)/100 AS s, value AS f, (event_id % 60)::DOUBLE AS ap FROM events)""",
)
def b12(spark, sf):
    e = events(spark, sf).select(
        "event_id", ((F.col("value") % 100) / 100).alias("s"), F.col("value").alias("f"), (F.col("event_id") % 60).cast("double").alias("ap")
    )
    return e.select(
        "event_id", X.score_band(F.col("s")).alias("score_band"), X.solar_band(F.col("f"), F.col("ap") >= 45).alias("solar_band"),
        X.activity_note(F.col("f"), F.col("ap")).alias("activity"), X.persistence_flag(F.col("s")).alias("persistence"),
    )


@query(
    "b13_name_groups",
    """WITH n AS (SELECT p_partkey, upper(trim(CASE p_size % 10 WHEN 0 THEN 'ISS ' WHEN 1 THEN 'GPS ' WHEN 2 THEN 'Glonass ' WHEN 3 THEN 'gsat' WHEN 4 THEN 'Starlink-'
       WHEN 5 THEN 'OneWeb ' WHEN 6 THEN 'NOAA ' WHEN 7 THEN 'FY-' WHEN 8 THEN 'CSS ' ELSE '' END || p_name)) AS n FROM part)
    SELECT p_partkey, CASE WHEN contains(n,'ISS') OR contains(n,'ZARYA') OR contains(n,'TIANGONG') OR contains(n,'TIANHE') OR contains(n,'WENTIAN')
       OR contains(n,'MENGTIAN') OR starts_with(n,'CSS') THEN 'stations' WHEN starts_with(n,'GPS ') OR starts_with(n,'NAVSTAR') THEN 'gps'
       WHEN contains(n,'GLONASS') THEN 'glonass' WHEN contains(n,'GALILEO') OR starts_with(n,'GSAT') THEN 'galileo' WHEN starts_with(n,'STARLINK') THEN 'starlink'
       WHEN starts_with(n,'ONEWEB') THEN 'oneweb' WHEN starts_with(n,'NOAA') OR starts_with(n,'FY-') THEN 'weather' ELSE 'other' END AS grp FROM n""",
)
def b13(spark, sf):
    words = ["ISS ", "GPS ", "Glonass ", "gsat", "Starlink-", "OneWeb ", "NOAA ", "FY-", "CSS ", ""]
    prefix = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_size") % 10 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", X.name_group(F.concat(prefix, "p_name")).alias("grp"))


# Display caps of the feature axes.
AXES = {"lz": 2.0, "dfa": 1.0, "shannon": 3.5, "cusum": 1.0, "score": 1.0}


@query(
    "b14_feature_axes",
    f"""WITH {LABEL_SQL} SELECT l_orderkey, line, unnest(['lz','dfa','shannon','cusum','score']) AS axis,
      unnest([round(least(1, lz/2), 6), round(least(1, dfa), 6), round(least(1, sh/3.5), 6), round(least(1, cusum), 6), round(least(1, sc), 6)]::DOUBLE[]) AS unit FROM g""",
)
def b14(spark, sf):
    f = label_inputs(spark, sf)
    units = f.select("l_orderkey", "line", *[F.round(X.unit_axis(F.col(k), cap), 6).alias(k) for k, cap in AXES.items()])
    return units.unpivot(["l_orderkey", "line"], list(AXES), "axis", "unit")


@query(
    "b15_align_features",
    """SELECT l_orderkey, l_linenumber::BIGINT AS line, CASE WHEN l_tax > 0 THEN ln(l_tax) ELSE 0 END AS a,
      CASE WHEN l_discount > 0 THEN l_quantity/l_discount ELSE 0 END AS b, 0.0::DOUBLE AS c FROM lineitem""".replace(
        "THEN ln(l_tax)", "THEN round(ln(l_tax), 6)"
    ).replace("THEN l_quantity/l_discount", "THEN round(l_quantity/l_discount, 6)"),
)
def b15(spark, sf):
    li = table(spark, sf, "lineitem")
    inf = F.when(F.col("l_discount") > 0, F.col("l_quantity") / F.col("l_discount")).otherwise(F.lit(float("inf")))
    nan = F.when(F.col("l_tax") > 0, F.ln("l_tax")).otherwise(F.lit(float("nan")))
    f = li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), nan.alias("a"), inf.alias("b"))
    return align_features(f, ["l_orderkey", "line"], ["a", "b", "c"])


def align_features(df, keys, columns):
    """Fixed column order, missing columns and non-finite values become 0."""
    return df.select(
        *keys, *[F.round(X.finite_or_zero(F.col(c)), 6).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns]
    )


# --- H: scalar formulas -----------------------------------------------------------------


@query(
    "h1_kepler",
    """SELECT p_partkey, round(CASE WHEN m > 0 THEN pow(398600.4418::DOUBLE/pow(m*2*pi()/86400, 2), 1/3.0::DOUBLE) END, 5) AS sma_km,
      round(CASE WHEN m > 0 THEN m END, 6) AS back FROM (SELECT p_partkey, p_size/3.0::DOUBLE - 1 AS m FROM part)""",
)
def h1(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 3.0 - 1).alias("m"))
    p = p.withColumn("a", X.sma_from_mean_motion(F.col("m")))
    return p.select("p_partkey", F.round("a", 5).alias("sma_km"), F.round(X.mean_motion_from_sma(F.col("a")), 6).alias("back"))


@query(
    "h2_position",
    f"""WITH {EL_SQL}, p AS (SELECT event_id, sma*(1-ecc*ecc)/(1+ecc*cos(nu)) AS r, nu, radians(inc) AS i, radians(raan) AS o
       FROM (SELECT *, radians(event_id % 360) AS nu FROM el))
    SELECT event_id, round(cos(o)*r*cos(nu) - sin(o)*cos(i)*r*sin(nu), 4) AS x, round(sin(o)*r*cos(nu) + cos(o)*cos(i)*r*sin(nu), 4) AS y,
      round(sin(i)*r*sin(nu), 4) AS z FROM p""",
)
def h2(spark, sf):
    e = elements(spark, sf)
    p = X.position(F.col("sma"), F.col("inc"), F.col("raan"), F.radians(F.col("event_id") % 360), F.col("ecc"))
    return e.select("event_id", p.alias("p")).select("event_id", *[F.round(f"p.{a}", 4).alias(a) for a in "xyz"])


@query(
    "h3_orbit_class",
    """SELECT p_partkey, CASE WHEN a - 6371 < 2000 THEN 'LEO' WHEN a - 6371 < 35000 THEN 'MEO' ELSE 'GEO' END AS by_altitude,
      CASE WHEN a < 8000 THEN 'LEO' WHEN a > 35000 THEN 'GEO' ELSE 'MEO' END AS by_axis FROM (SELECT p_partkey, 6500.0::DOUBLE + p_size*800 AS a FROM part)""",
)
def h3(spark, sf):
    a = F.lit(6500.0) + F.col("p_size") * 800
    return table(spark, sf, "part").select(
        "p_partkey", X.orbit_class_by_altitude(a).alias("by_altitude"), X.orbit_class_by_axis(a).alias("by_axis")
    )


@query(
    "h4_age_hours",
    """SELECT event_id, round(CASE WHEN event_id % 19 = 0 THEN 12.0 ELSE greatest(0, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts))/3.6e9) END, 6)::DOUBLE AS age FROM events""",
)
def h4(spark, sf):
    ts = F.when(F.col("event_id") % 19 != 0, F.col("ts"))
    ref = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return events(spark, sf).select("event_id", F.round(X.age_hours(ts, ref), 6).alias("age"))


@query(
    "h5_policy_score",
    """WITH c AS (SELECT c_custkey, ['CN','US','RU','DE','BR','IR'][(c_custkey % 6 + 1)::INT] AS co, ['military','commercial','telecom','sigint'][(c_custkey % 4 + 1)::INT] AS pu,
      CASE WHEN c_custkey % 5 < 3 THEN 'LEO' ELSE 'GEO' END AS ob, (c_custkey % 100)::DOUBLE AS inc FROM customer)
    SELECT c_custkey, round(least(1, CASE WHEN co IN ('CN','RU','KP','IR') THEN 0.35 WHEN co NOT IN ('US','UK','FR','CA','DE') THEN 0.1 ELSE 0 END
      + CASE WHEN pu IN ('military','sigint','asat_test','reconnaissance') THEN 0.45 WHEN pu IN ('commercial','scientific') THEN 0.05 ELSE 0 END
      + CASE WHEN ob = 'LEO' AND inc > 55 THEN 0.2 ELSE 0 END), 6)::DOUBLE AS policy FROM c""",
)
def h5(spark, sf):
    k = F.col("c_custkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    p = X.policy_score(
        pick(["CN", "US", "RU", "DE", "BR", "IR"]), pick(["military", "commercial", "telecom", "sigint"]),
        F.when(k % 5 < 3, "LEO").otherwise("GEO"), (k % 100).cast("double"),
    )
    return table(spark, sf, "customer").select(k, F.round(p, 6).alias("policy"))


@query(
    "h6_half_kelly",
    f"""WITH {BOARD_SQL}, s AS (SELECT norad_id, score AS p, CASE norad_id % 5 WHEN 0 THEN 100.0 WHEN 1 THEN 95.0 WHEN 2 THEN 15.0 WHEN 3 THEN 10.0 ELSE 25.0 END::DOUBLE AS b FROM b)
    SELECT norad_id, round(greatest(0, (p*b - (1-p))/b*0.5), 9) AS kelly FROM s""",
)
def h6(spark, sf):
    k = F.col("norad_id") % 5
    purpose = F.when(k == 0, "Military").when(k == 1, "sigint").when(k == 2, "earth obs").when(k == 3, "telecom").otherwise("odd")
    return board(spark, sf).select("norad_id", F.round(X.half_kelly(F.col("score"), X.severity(purpose)), 9).alias("kelly"))


RISK_SQL = LABEL_SQL + """, q AS (SELECT l_orderkey, line, l_suppkey, dist, coint, (lz - 0.5) AS dcca, dfa, exp(-dist/400) AS prox,
      CASE WHEN coint < 0.05 THEN least(1, 1 - coint + 0.25) ELSE greatest(0, 1 - coint) END AS cs,
      CASE WHEN coint < 0.05 AND dfa > 0.65 THEN 1 ELSE 0 END AS coh FROM g),
    r1 AS (SELECT *, least(1, 0.5*prox + 0.3*cs + 0.1*greatest(dcca, 0) + 0.1*coh) AS r FROM q),
    r2 AS (SELECT *, CASE WHEN dist < 150 AND coint < 0.1 THEN least(1, r + 0.15) ELSE r END AS rr FROM r1),
    r3 AS (SELECT *, CASE WHEN dist < 50 AND coint < 0.05 THEN least(1, rr + 0.1) ELSE rr END AS risk FROM r2)"""


@query(
    "h7_pair_risk",
    f"""WITH {RISK_SQL} SELECT l_orderkey, line, round(risk, 6) AS pair_risk, CASE WHEN risk >= 0.75 AND dist < 100 AND coint < 0.1 THEN 'CRITICAL'
      WHEN risk >= 0.55 OR (dist < 120 AND coint < 0.15) THEN 'ELEVATED' WHEN risk >= 0.35 OR dist < 250 THEN 'WATCH' ELSE 'LOW' END AS risk_level FROM r3""",
)
def h7(spark, sf):
    f = label_inputs(spark, sf)
    r = X.pair_risk(F.col("dist"), F.col("coint"), F.col("lz") - 0.5, F.col("dfa"))
    return f.select("l_orderkey", "line", r.alias("r")).select("l_orderkey", "line", F.round("r.pair_risk", 6).alias("pair_risk"), "r.risk_level")


@query(
    "h8_collision_probability",
    """WITH m AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, l_quantity/20 AS miss, 0.5::DOUBLE + 0.35::DOUBLE*sqrt(greatest(0, l_partkey % 40 - 3)) AS sigma FROM lineitem)
    SELECT l_orderkey, line, round(sigma, 6) AS sigma_km, round(least(1, 0.0004::DOUBLE/2/(sigma*sigma)*exp(-0.5*miss*miss/(sigma*sigma)))*1e6, 4) AS pc_ppm FROM m""",
)
def h8(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), (F.col("l_quantity") / 20).alias("miss"),
        X.miss_sigma((F.col("l_partkey") % 40 - 3).cast("double")).alias("sigma"),
    )
    return li.select("l_orderkey", "line", F.round("sigma", 6).alias("sigma_km"), F.round(X.collision_probability(F.col("miss"), F.col("sigma")) * 1e6, 4).alias("pc_ppm"))


STOPS = "[" + ",".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
TOK = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]{{3,}}'), lambda w: NOT list_contains({STOPS}, w))"


@query(
    "h9_keyword_retrieval",
    f"""WITH {CHUNK_SQL}, q AS (SELECT DISTINCT item_id, unnest({TOK('text')}) AS t FROM benchmark),
    c AS (SELECT path, chunk_no, part, list_distinct({TOK("heading || ' ' || body[part*1800 + 1 : part*1800 + 1800]")}) AS ts, list_distinct({TOK('heading')}) AS hs
      FROM (SELECT *, unnest(range(0, (length(body) - 1) // 1800 + 1)) AS part FROM ch WHERE length(body) >= 40)),
    e AS (SELECT path, chunk_no, part, t, list_contains(hs, t) AS h FROM (SELECT *, unnest(ts) AS t FROM c)),
    s AS (SELECT item_id, path, chunk_no, part, count(*) + CASE WHEN bool_or(h) THEN 2 ELSE 0 END AS score FROM e JOIN q USING (t) GROUP BY ALL)
    SELECT item_id, path, chunk_no, part, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, path, chunk_no, part) AS rank FROM s) WHERE rank <= 20""",
)
def h9(spark, sf):
    """The twenty best text sections of every benchmark item."""
    chunks = TX.markdown_chunks(marked_documents(spark, sf), "path", "text")
    hits = TX.retrieve_all(chunks, table(spark, sf, "benchmark"), "item_id", "text", ["path", "chunk_no", "part"], "heading", "text", 20)
    return hits.select("item_id", "path", "chunk_no", "part", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "h10_text_helpers",
    """SELECT p_partkey, p_name || ' | ' || printf('%.2f', p_retailprice) AS label, p_name AS head,
      regexp_replace(regexp_replace(lower(p_type || ' / ' || p_brand || '!'), '[^a-z0-9]', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
      '- [' || p_brand || '] ' || p_name AS citation FROM part""",
)
def h10(spark, sf):
    p = table(spark, sf, "part")
    label = X.round_long_floats(F.concat_ws(" | ", "p_name", F.format_string("%.4f", "p_retailprice")))
    return p.select(
        "p_partkey", label.alias("label"), X.head_name(F.concat_ws(" · ", "p_name", "p_brand")).alias("head"),
        X.slug(F.concat(F.col("p_type"), F.lit(" / "), F.col("p_brand"), F.lit("!"))).alias("slug"),
        F.format_string("- [%s] %s", "p_brand", F.regexp_replace(F.concat(F.lit(" "), "p_name", F.lit(" ")), r"^\s+|\s+$", "")).alias("citation"),
    )


@query(
    "h11_schema_hash",
    """SELECT o_orderkey, substr(sha256(concat_ws('|', o_orderstatus, o_orderpriority, o_custkey::VARCHAR)), 1, 16) AS hash, strftime(o_orderdate, '%Y%m%d') AS stamp FROM orders""",
)
def h11(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", X.schema_hash(F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))).alias("hash"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("stamp"),
    )


@query(
    "h12_fuse_evidence",
    """WITH s AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, l_discount*10 AS s1, l_tax*10 AS s2, l_quantity/50 AS s3,
        least(0.85, 0.3 + (l_partkey % 200)/168.0::DOUBLE*0.45) AS g FROM lineitem),
    m AS (SELECT *, (1-s1)*(1-g) AS n1, s1*(1-g) AS a1, (1-s2)*(1-g) AS n2, s2*(1-g) AS a2, (1-s3)*(1-g) AS n3, s3*(1-g) AS a3 FROM s),
    c1 AS (SELECT *, 1 - (n1*a2 + a1*n2) AS z1 FROM m),
    d1 AS (SELECT *, (n1*n2 + n1*g + g*n2)/z1 AS n12, (a1*a2 + a1*g + g*a2)/z1 AS a12, g*g/z1 AS t12 FROM c1),
    c2 AS (SELECT *, n2*a12 + a2*n12 AS k1, 1 - (n12*a3 + a12*n3) AS z2 FROM d1),
    d2 AS (SELECT *, (n12*n3 + n12*g + t12*n3)/z2 AS n123, (a12*a3 + a12*g + t12*a3)/z2 AS a123, t12*g/z2 AS t123 FROM c2)
    SELECT l_orderkey, line, round(a123, 6) AS belief, round(a123 + t123, 6) AS plausibility, round((k1 + n3*a123 + a3*n123)/2, 6) AS conflict FROM d2""",
)
def h12(spark, sf):
    li = table(spark, sf, "lineitem")
    f = S.fuse_evidence(
        F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50), (F.col("l_partkey") % 200).cast("double")
    )
    return li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), f.alias("f")).select(
        "l_orderkey", "line", F.round("f.belief_anomalous", 6).alias("belief"), F.round("f.plausibility_anomalous", 6).alias("plausibility"),
        F.round("f.conflict_k", 6).alias("conflict"),
    )


@query(
    "h13_feature_snapshot",
    """SELECT o_orderkey, '{"cust":' || o_custkey || ',"status":"' || o_orderstatus || '"}' AS snapshot, o_custkey AS cust FROM orders""",
)
def h13(spark, sf):
    o = table(spark, sf, "orders")
    snap = F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"))
    m = F.create_map(F.lit("cust"), F.col("o_custkey").cast("double"), F.lit("price"), "o_totalprice")
    return o.select("o_orderkey", F.to_json(snap).alias("snapshot"), F.element_at(m, "cust").cast("bigint").alias("cust"))


def _mf(x, corners):
    a, b, c, d = corners
    up = "1.0" if a == b else f"({x}-{a})/({b}-{a})::DOUBLE"
    down = "1.0" if c == d else f"({d}-{x})/({d}-{c})::DOUBLE"
    return f"greatest(0, least(1, {up}, {down}))"


def _fuzzy_sql():
    """The same rules as a grid of rows: one row per input and grid point, trapezoid moments."""
    from driftline.functions.fuzzy import INPUTS, OUTPUT, RULES

    term = {f"{k}.{t}": _mf(f"least({hi}, {k})", c) for k, ((_, hi), p) in INPUTS.items() for t, c in p.items()}
    act = ", ".join(
        "greatest(0, " + ", ".join("least(1, " + ", ".join(term[t] for t in cond.split()) + ")" for cond, o in RULES if o == out) + f") AS a_{out}"
        for out in OUTPUT
    )
    y = "greatest(" + ", ".join(f"least(a_{c}, {_mf('x', k)})" for c, k in OUTPUT.items()) + ")"
    return f"""WITH f AS (SELECT event_id, (value % 100)/100 AS score, (value % 31)/10 AS shannon, (event_id % 170)::DOUBLE AS age,
        (event_id % 130)::DOUBLE AS dist, (user_id % 13)/10.0::DOUBLE AS lz, (user_id % 10)/10.0::DOUBLE AS dfa FROM events),
    a AS (SELECT event_id, {act} FROM f),
    g AS (SELECT *, i/100.0::DOUBLE AS x FROM a, (SELECT unnest(range(0, 101)) AS i)),
    y AS (SELECT event_id, x, {y} AS y FROM g),
    s AS (SELECT event_id, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM y WINDOW w AS (PARTITION BY event_id ORDER BY x)),
    c AS (SELECT event_id, sum((x-x0)*(y0+y)/2) AS area, sum((x-x0)*(x0*(2*y0+y) + x*(y0+2*y))/6) AS mom FROM s GROUP BY 1),
    t AS (SELECT event_id, CASE WHEN area > 0 THEN mom/area ELSE 0.5 END AS t FROM c)
    SELECT event_id, round(t, 5) AS threat_level, CASE WHEN t < 0.35 THEN 'NORMAL' WHEN t < 0.55 THEN 'ANOMALOUS' WHEN t < 0.8 THEN 'SUSPECT' ELSE 'HOSTILE' END AS classification FROM t"""


@query("h15_fuzzy_threat", _fuzzy_sql())
def h15(spark, sf):
    from driftline.functions.fuzzy import fuzzy_threat

    e = events(spark, sf)
    v, i, u = F.col("value"), F.col("event_id"), F.col("user_id")
    r = fuzzy_threat(
        {"score": (v % 100) / 100, "shannon": (v % 31) / 10, "age": (i % 170).cast("double"),
         "dist": (i % 130).cast("double"), "lz": (u % 13) / 10.0, "dfa": (u % 10) / 10.0}
    )
    return e.select("event_id", r.alias("r")).select(
        "event_id", F.round("r.threat_level", 5).alias("threat_level"), "r.classification"
    )


@query("h16_simplify_track")
def h16(spark, sf):
    from driftline.operators.simplify import simplify_tracks

    e = W.numbered(elements(spark, sf), "norad_id", "ts", ["event_id"])
    p = X.position(F.col("sma"), F.col("inc"), F.col("raan"), F.radians((F.col("pos") * 10) % 360), F.col("ecc"))
    pts = e.select("norad_id", "pos", p.alias("p")).select("norad_id", "pos", "p.*")
    return simplify_tracks(pts, "norad_id", "pos", 900.0)
