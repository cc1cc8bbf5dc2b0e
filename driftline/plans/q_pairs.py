"""Pair geometry, alignment, scoring and the board."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from driftline.operators import pairs as P
from driftline.plans.inputs import elements, events
from driftline.plans.registry import query
from driftline.session import materialize, table

# Protected assets: the users whose id is a nation key. The nation table has a fixed 25 rows, so
# the asset list does not grow with the data.


def suspects(spark, sf):
    """Users of role suspect that are not assets themselves."""
    return events(spark, sf, "user_id").where("user_id % 3 = 1 AND user_id >= 25").distinct()


def asset_events(spark, sf):
    keys = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("user_id"))
    return events(spark, sf).join(F.broadcast(keys), "user_id", "left_semi")


def suspect_events(spark, sf):
    return events(spark, sf).where("user_id % 3 = 1 AND user_id >= 25")


def pair_series(spark, sf):
    """(suspect, asset) rows with the suspect's tail, and the assets' tails."""
    st = P.tails(suspect_events(spark, sf), "user_id", "ts", "value", ["event_id"]).select(
        F.col("user_id").alias("suspect_id"), F.col("t").alias("ta"), F.col("v").alias("va")
    )
    at = P.tails(asset_events(spark, sf), "user_id", "ts", "value", ["event_id"]).select(
        F.col("user_id").alias("asset_id"), F.col("t").alias("tb"), F.col("v").alias("vb")
    )
    ids = at.select("asset_id")
    return P.with_assets(st, ids, "suspect_id", ["asset_id"]), at


NOW = "2024-01-31 00:00:00"

ASOF_SQL = """WITH s AS (SELECT user_id AS suspect_id, ts, event_id, value FROM events
   WHERE user_id % 3 = 1 AND user_id >= 25),
  p AS (SELECT s.*, n_nationkey::BIGINT AS asset_id FROM s, nation),
  a AS (SELECT user_id AS asset_id, ts AS t, value AS v FROM events WHERE user_id < 25),
  b AS (SELECT p.*, a.t AS tb, a.v AS vb FROM p ASOF LEFT JOIN a ON p.asset_id = a.asset_id AND p.ts >= a.t),
  f AS (SELECT b.*, a.t AS tf, a.v AS vf FROM b ASOF LEFT JOIN a ON b.asset_id = a.asset_id AND b.ts <= a.t),
  m AS (SELECT suspect_id, asset_id, value, CASE WHEN tb IS NOT NULL AND (tf IS NULL OR ts - tb <= tf - ts)
          THEN vb ELSE vf END AS v, CASE WHEN tb IS NOT NULL AND (tf IS NULL OR ts - tb <= tf - ts)
          THEN ts - tb ELSE tf - ts END AS gap FROM f)
  SELECT suspect_id, asset_id, count(*) AS n_aligned, round(sum(value), 4) AS sum_a, round(sum(v), 4) AS sum_b
  FROM m WHERE gap <= INTERVAL 12 HOUR GROUP BY ALL"""


@query("c2_asof_nearest", ASOF_SQL)
def c2(spark, sf):
    s = suspect_events(spark, sf).select(F.col("user_id").alias("suspect_id"), "ts", "value")
    a = asset_events(spark, sf)
    left = P.with_assets(s, a.select(F.col("user_id").alias("asset_id")).distinct(), "suspect_id", ["asset_id"])
    # Asset rows are keyed by asset only; suspects ride as left payload.
    right = a.select(F.col("user_id").alias("asset_id"), "ts", "value")
    j = P.asof_nearest(left, right, ["asset_id"], "ts", "value", 12 * 3600)
    return j.where(F.col("value_right").isNotNull()).groupBy("suspect_id", "asset_id").agg(
        F.count("*").alias("n_aligned"),
        F.round(F.sum("value"), 4).alias("sum_a"),
        F.round(F.sum("value_right"), 4).alias("sum_b"),
    )


@query(
    "c4_theta_pairs",
    """WITH s AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 1)
    SELECT user_id AS suspect_id, n_nationkey::BIGINT AS asset_id, n_name AS asset_name
    FROM s, nation WHERE user_id <> n_nationkey""",
)
def c4(spark, sf):
    s = events(spark, sf, "user_id").where("user_id % 3 = 1").distinct().select(F.col("user_id").alias("suspect_id"))
    a = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("asset_id"), F.col("n_name").alias("asset_name"))
    return P.with_assets(s, a, "suspect_id", ["asset_id", "asset_name"])


def last_elements(spark, sf):
    """Latest element row per object."""
    from driftline.operators.skew import keep_last

    e = elements(spark, sf)
    return keep_last(e, ["norad_id"], [F.col("ts").desc(), F.col("event_id").desc()])


def element_pairs(spark, sf):
    """Suspects' latest elements with every asset's latest elements."""
    last = last_elements(spark, sf)
    s = last.where("norad_id % 3 = 1 AND norad_id >= 25").select(
        F.col("norad_id").alias("suspect_id"), "ts", "sma", "inc", "raan", "mm"
    )
    keys = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("norad_id"))
    a = last.join(F.broadcast(keys), "norad_id", "left_semi").select(
        F.col("norad_id").alias("asset_id"), F.col("sma").alias("a_sma"), F.col("inc").alias("a_inc"),
        F.col("raan").alias("a_raan"), F.col("mm").alias("a_mm"), F.col("ts").alias("a_ts"),
    )
    return s, a


ME = lambda: {"a": F.col("sma"), "inc": F.col("inc"), "raan": F.col("raan"), "mm": F.col("mm"), "ts": F.col("ts")}
IT = lambda: {"a": F.col("a_sma"), "inc": F.col("a_inc"), "raan": F.col("a_raan"), "mm": F.col("a_mm"), "ts": F.col("a_ts")}
A_COLS = ["asset_id", "a_sma", "a_inc", "a_raan", "a_mm", "a_ts"]

from driftline.plans.inputs import EL_SQL  # noqa: E402

LAST_SQL = EL_SQL + """, le AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norad_id
    ORDER BY ts DESC, event_id DESC) AS r FROM el) WHERE r = 1),
  sp AS (SELECT norad_id AS suspect_id, ts, sma, inc, raan, mm FROM le WHERE norad_id % 3 = 1 AND norad_id >= 25),
  ap AS (SELECT norad_id AS asset_id, ts AS a_ts, sma AS a_sma, inc AS a_inc, raan AS a_raan, mm AS a_mm
         FROM le WHERE norad_id < 25),
  pr AS (SELECT * FROM sp, ap),
  ra AS (SELECT suspect_id, sma*cos(ph)*cos(radians(raan)) - sma*sin(ph)*cos(radians(inc))*sin(radians(raan)) AS x,
      sma*cos(ph)*sin(radians(raan)) + sma*sin(ph)*cos(radians(inc))*cos(radians(raan)) AS y,
      sma*sin(ph)*sin(radians(inc)) AS z FROM sp, (SELECT unnest(range(0, 36))*2*pi()/36 AS ph)),
  rb AS (SELECT asset_id, a_sma*cos(ph)*cos(radians(a_raan)) - a_sma*sin(ph)*cos(radians(a_inc))*sin(radians(a_raan)) AS x,
      a_sma*cos(ph)*sin(radians(a_raan)) + a_sma*sin(ph)*cos(radians(a_inc))*cos(radians(a_raan)) AS y,
      a_sma*sin(ph)*sin(radians(a_inc)) AS z FROM ap, (SELECT unnest(range(0, 36, 2))*2*pi()/36 AS ph)),
  rd AS (SELECT suspect_id, asset_id, sqrt(min((ra.x-rb.x)**2+(ra.y-rb.y)**2+(ra.z-rb.z)**2)) AS m
         FROM ra, rb GROUP BY ALL),
  jd AS (SELECT pr.*, greatest(m, abs(sma-a_sma)*0.5) AS ring FROM pr JOIN rd USING (suspect_id, asset_id)),
  nd AS (SELECT *, least(2000, CASE WHEN abs(inc-a_inc) < 2 THEN least(ring, greatest(abs(sma-a_sma), 1)) ELSE ring END) AS dist
         FROM jd)"""


@query(
    "j1_ring_distance",
    f"WITH {LAST_SQL} SELECT suspect_id, asset_id, round(ring, 3) AS ring_km FROM jd",
)
def j1(spark, sf):
    s, a = element_pairs(spark, sf)
    p = P.with_assets(s, a, "suspect_id", A_COLS)
    return p.select("suspect_id", "asset_id", F.round(P.ring_distance(ME(), IT()), 3).alias("ring_km"))


NEAR_SQL = f"""WITH {LAST_SQL}, b AS (SELECT suspect_id, min(dist) AS d, min_by(asset_id, (dist, asset_id)) AS aid
  FROM nd GROUP BY suspect_id)"""


@query(
    "j2_nearest_asset",
    NEAR_SQL + """ SELECT suspect_id, round(d, 3) AS distance_km, CASE WHEN d < 2000 THEN aid END AS closest_asset FROM b""",
)
def j2(spark, sf):
    s, a = element_pairs(spark, sf)
    n = P.nearest_asset(s, a, ["suspect_id"], 2000.0)
    return n.select("suspect_id", F.round("distance_km", 3).alias("distance_km"), "closest_asset")


@query(
    "c14_close_approach_lookup",
    NEAR_SQL + """ SELECT suspect_id, round(least(d, 500), 3) AS distance_km, CASE WHEN d < 500 THEN aid END AS closest_asset,
      least(d, 500) < 50 AS within_threshold FROM b""",
)
def c14(spark, sf):
    s, a = element_pairs(spark, sf)
    n = P.nearest_asset(s, a, ["suspect_id"], 500.0)
    return n.select(
        "suspect_id", F.round("distance_km", 3).alias("distance_km"), "closest_asset",
        (F.col("distance_km") < 50).alias("within_threshold"),
    )


TCA_SQL = f"""WITH {LAST_SQL}, k AS (SELECT unnest(range(0, 1081)) AS k),
  sa AS (SELECT suspect_id, k, sma, raan, inc, 2*pi()*mm*((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts))/1e6 + k*120)/86400 AS ph FROM sp, k),
  sb AS (SELECT asset_id, k, a_sma, a_raan, a_inc, 2*pi()*a_mm*((epoch_us(TIMESTAMP '{NOW}') - epoch_us(a_ts))/1e6 + k*120)/86400 AS ph FROM ap, k),
  pa AS (SELECT suspect_id, k, sma*cos(ph)*cos(radians(raan)) - sma*sin(ph)*cos(radians(inc))*sin(radians(raan)) AS x,
      sma*cos(ph)*sin(radians(raan)) + sma*sin(ph)*cos(radians(inc))*cos(radians(raan)) AS y,
      sma*sin(ph)*sin(radians(inc)) AS z FROM sa),
  pb AS (SELECT asset_id, k, a_sma*cos(ph)*cos(radians(a_raan)) - a_sma*sin(ph)*cos(radians(a_inc))*sin(radians(a_raan)) AS x,
      a_sma*cos(ph)*sin(radians(a_raan)) + a_sma*sin(ph)*cos(radians(a_inc))*cos(radians(a_raan)) AS y,
      a_sma*sin(ph)*sin(radians(a_inc)) AS z FROM sb),
  d AS (SELECT suspect_id, asset_id, pa.k, sqrt((pa.x-pb.x)**2+(pa.y-pb.y)**2+(pa.z-pb.z)**2) AS d FROM pa JOIN pb USING (k)),
  c AS (SELECT suspect_id, asset_id, min(d) AS miss, min_by(k, d)*120 AS off FROM d GROUP BY ALL),
  cj AS (SELECT *, off/3600.0::DOUBLE AS hours, 0.5::DOUBLE + 0.35::DOUBLE*sqrt(off/3600.0::DOUBLE) AS sigma FROM c)"""


def _conj(spark, sf):
    s, a = element_pairs(spark, sf)
    p = P.with_assets(s, a, "suspect_id", A_COLS)
    now = F.lit(NOW).cast("timestamp")
    return P.conjunction(p, ["suspect_id", "asset_id"], ME(), IT(), now)


@query(
    "j3_closest_approach",
    TCA_SQL + """ SELECT suspect_id, asset_id, round(miss, 3) AS miss_km, off::BIGINT AS offset_s, round(hours, 3) AS hours_to_tca,
      round(sigma, 4) AS sigma_km FROM cj""",
)
def j3(spark, sf):
    return _conj(spark, sf).select(
        "suspect_id", "asset_id", F.round("miss_km", 3).alias("miss_km"),
        F.col("offset_s").cast("bigint").alias("offset_s"),
        F.round("hours_to_tca", 3).alias("hours_to_tca"), F.round("sigma_km", 4).alias("sigma_km"),
    )


@query(
    "j4_attach_conjunction",
    TCA_SQL + """, r AS (SELECT suspect_id, asset_id, round(exp(-dist/400), 6) AS pair_risk,
       CASE WHEN (suspect_id + asset_id) % 2 = 0 THEN 1.5::DOUBLE END AS miss0 FROM nd)
    SELECT suspect_id, asset_id, pair_risk, coalesce(miss0, round(miss, 3)) AS miss_km FROM r LEFT JOIN cj USING (suspect_id, asset_id)""",
)
def j4(spark, sf):
    s, a = element_pairs(spark, sf)
    p = P.with_assets(s, a, "suspect_id", A_COLS)
    pairs = p.select(
        "*", F.round(F.exp(-P.asset_distance(ME(), IT(), 2000.0) / 400.0), 6).alias("pair_risk"),
        F.when((F.col("suspect_id") + F.col("asset_id")) % 2 == 0, 1.5).alias("miss_km"),
    )
    return attach_conjunction(pairs, F.lit(NOW).cast("timestamp")).select("suspect_id", "asset_id", "pair_risk", "miss_km")


def attach_conjunction(pairs, now):
    """Fill conjunction columns only where they are missing; the scan is skipped elsewhere."""
    keys = ["suspect_id", "asset_id"]
    todo = P.closest_approach(
        pairs.where(F.col("miss_km").isNull()).drop("miss_km"), keys, ME(), IT(), now, keep=["pair_risk"]
    ).select(*keys, "pair_risk", F.round("miss_km", 3).alias("miss_km"))
    return pairs.where(F.col("miss_km").isNotNull()).select(*keys, "pair_risk", "miss_km").unionByName(todo)


@query(
    "j5_ring_crossing",
    f"""WITH {LAST_SQL}, b AS (SELECT suspect_id, min_by(asset_id, (dist, asset_id)) AS asset_id FROM nd GROUP BY suspect_id),
    q AS (SELECT pr.* FROM pr JOIN b USING (suspect_id, asset_id)),
    ph AS (SELECT unnest(range(0, 120)) AS i, unnest(range(0, 120))*2*pi()/120 AS ph),
    xa AS (SELECT suspect_id, asset_id, i, sma*cos(ph)*cos(radians(raan)) - sma*sin(ph)*cos(radians(inc))*sin(radians(raan)) AS x,
      sma*cos(ph)*sin(radians(raan)) + sma*sin(ph)*cos(radians(inc))*cos(radians(raan)) AS y, sma*sin(ph)*sin(radians(inc)) AS z FROM q, ph),
    xb AS (SELECT suspect_id, i AS j, a_sma*cos(ph)*cos(radians(a_raan)) - a_sma*sin(ph)*cos(radians(a_inc))*sin(radians(a_raan)) AS x,
      a_sma*cos(ph)*sin(radians(a_raan)) + a_sma*sin(ph)*cos(radians(a_inc))*cos(radians(a_raan)) AS y, a_sma*sin(ph)*sin(radians(a_inc)) AS z FROM q, ph),
    dx AS (SELECT suspect_id, asset_id, xa.i, xb.j, (xa.x-xb.x)**2+(xa.y-xb.y)**2+(xa.z-xb.z)**2 AS d2, xa.x AS pax, xa.y AS pay, xa.z AS paz, xb.x AS pbx, xb.y AS pby, xb.z AS pbz FROM xa JOIN xb USING (suspect_id)),
    g AS (SELECT suspect_id, asset_id, min(d2) AS d2, min_by(pax, d2) AS pax, min_by(pay, d2) AS pay, min_by(paz, d2) AS paz, min_by(pbx, d2) AS pbx, min_by(pby, d2) AS pby, min_by(pbz, d2) AS pbz FROM dx GROUP BY ALL),
    k AS (SELECT unnest(range(0, 541)) AS k),
    tt AS (SELECT q.*, k, 2*pi()*mm*((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts))/1e6 + k*20)/86400 AS pa, 2*pi()*a_mm*((epoch_us(TIMESTAMP '{NOW}') - epoch_us(a_ts))/1e6 + k*20)/86400 AS pb FROM q, k),
    td AS (SELECT suspect_id, k, sqrt((sma*cos(pa)*cos(radians(raan)) - sma*sin(pa)*cos(radians(inc))*sin(radians(raan)) - a_sma*cos(pb)*cos(radians(a_raan)) + a_sma*sin(pb)*cos(radians(a_inc))*sin(radians(a_raan)))**2
      + (sma*cos(pa)*sin(radians(raan)) + sma*sin(pa)*cos(radians(inc))*cos(radians(raan)) - a_sma*cos(pb)*sin(radians(a_raan)) - a_sma*sin(pb)*cos(radians(a_inc))*cos(radians(a_raan)))**2
      + (sma*sin(pa)*sin(radians(inc)) - a_sma*sin(pb)*sin(radians(a_inc)))**2) AS d FROM tt),
    tm AS (SELECT suspect_id, min(d) AS d, min_by(k, d)*20 AS s FROM td GROUP BY 1)
    SELECT suspect_id, asset_id, round(sqrt(d2), 3) AS range_km, round(CASE WHEN pax < 0 THEN -pax ELSE pax END, 2) AS pax, round(CASE WHEN pax < 0 THEN -pay ELSE pay END, 2) AS pay, round(CASE WHEN pax < 0 THEN -paz ELSE paz END, 2) AS paz, round(CASE WHEN pax < 0 THEN -pbx ELSE pbx END, 2) AS pbx, round(CASE WHEN pax < 0 THEN -pby ELSE pby END, 2) AS pby, round(CASE WHEN pax < 0 THEN -pbz ELSE pbz END, 2) AS pbz,
      round(d, 3) AS temporal_km, s::BIGINT AS temporal_s FROM g JOIN tm USING (suspect_id)""",
)
def j5(spark, sf):
    """Where the rings of every suspect and its nearest asset come closest, and when the two do within three hours."""
    best = nearest_pairs(spark, sf)
    phase = lambda n: F.col(n) * (2 * math.pi / 120)
    geo = best.join(P.crossing(best, ["suspect_id"], ME(), IT(), 120), "suspect_id")
    geo = geo.select("suspect_id", "asset_id", "range_km", P.on_ring(ME(), phase("i")).alias("p"), P.on_ring(IT(), phase("j")).alias("q"))
    when = P.temporal_closest(best, ["suspect_id"], ME(), IT(), F.lit(NOW).cast("timestamp"))
    # Rings about one centre come as close on the far side; the side of positive x is told.
    sign = F.when(F.col("p.x") < 0, -1.0).otherwise(1.0)
    points = [F.round(F.col(f"{s}.{x}") * sign, 2).alias(f"p{n}{x}") for s, n in (("p", "a"), ("q", "b")) for x in "xyz"]
    return geo.join(when.select("suspect_id", "grid_km", "grid_s"), "suspect_id").select(
        "suspect_id", "asset_id", F.round("range_km", 3).alias("range_km"), *points, F.round("grid_km", 3).alias("temporal_km"), F.col("grid_s").cast("bigint").alias("temporal_s")
    )


def nearest_pairs(spark, sf):
    """Every suspect's latest elements with those of its nearest asset, however far."""
    s, a = element_pairs(spark, sf)
    s, a = materialize(s, "suspects"), materialize(a, "assets")
    near = P.near_assets(s, a, ["suspect_id"], 2000.0)
    at = P.asset_distance({"a": F.col("sma"), "inc": F.col("inc"), "raan": F.col("raan")}, IT(), 2000.0)
    best = near.groupBy("suspect_id").agg(F.min_by("asset_id", F.struct(at, "asset_id")).alias("asset_id"))
    return materialize(s.join(best, "suspect_id").join(a, "asset_id"), "nearest-pairs")


@query("j5_temporal_refined")
def j5_refined(spark, sf):
    """Moment and places of the closest approach of every suspect and its nearest asset, between the steps."""
    t = P.temporal_closest(nearest_pairs(spark, sf), ["suspect_id", "asset_id"], ME(), IT(), F.lit(NOW).cast("timestamp"))
    points = [F.round(f"point_{n}.{x}", 3).alias(f"{n}{x}") for n in "ab" for x in "xyz"]
    return t.select("suspect_id", "asset_id", F.round("range_km", 3).alias("range_km"), F.round("tca_s", 1).alias("tca_s"), *points)


@query("j6_pair_score")
def j6(spark, sf):
    """All pairs scored: geometry, alignment, cointegration, cross-correlation and risk."""
    return pair_scores(spark, sf)


def pair_scores(spark, sf):
    geo_s, geo_a = element_pairs(spark, sf)
    geo = P.conjunction(
        P.with_assets(geo_s, geo_a, "suspect_id", A_COLS).withColumn(
            "distance_km", P.asset_distance(ME(), IT(), 2000.0)
        ),
        ["suspect_id", "asset_id"], ME(), IT(), F.lit(NOW).cast("timestamp"), keep=["distance_km"],
    )
    s, a = pair_series(spark, sf)
    dfa = P.persistence(suspect_events(spark, sf), "user_id", "ts", "value", ["event_id"]).withColumnRenamed("user_id", "suspect_id")
    al = P.tail_statistics(s, a).join(dfa, "suspect_id")
    scored = P.score_pairs(geo.join(al, ["suspect_id", "asset_id"]))
    return scored.select(
        "suspect_id", "asset_id", F.round("distance_km", 3).alias("distance_km"),
        F.round("coint_p", 6).alias("coint_p"), F.round("dfa", 4).alias("dfa"), F.round("dcca", 4).alias("dcca"),
        F.round("risk.pair_risk", 4).alias("pair_risk"), "risk.risk_level",
        F.col("n").alias("n_aligned"), F.round("miss_km", 3).alias("miss_km"), "pc",
    )


@query("j7_pairs_report")
def j7(spark, sf):
    """Top three assets per suspect, highest risk first, with each suspect's best pair and the report's counters."""
    return pairs_report(pair_scores(spark, sf))


def pairs_report(scored):
    scored = materialize(scored, "pair-scores")
    hot = F.col("risk_level").isin("CRITICAL", "ELEVATED")
    totals = scored.agg(
        F.count("*").alias("n_pairs_scored"), F.countDistinct("suspect_id").alias("n_suspects"), F.countDistinct("asset_id").alias("n_assets"),
        F.count_if(hot).alias("n_elevated"), F.count_if(F.col("risk_level") == "CRITICAL").alias("n_critical"),
    )
    top = P.top_pairs(scored, "suspect_id", "pair_risk", "distance_km", "asset_id")
    top = top.withColumn("is_best", F.col("rank") == 1).withColumn("t", totals.select(F.struct(*totals.columns)).scalar())
    return top.select(*[c for c in top.columns if c != "t"], "t.*").orderBy(F.desc("pair_risk"), "distance_km", "suspect_id", "asset_id")


DCCA_SQL = f"""WITH s AS (SELECT user_id AS suspect_id, ts, event_id, value FROM events
   WHERE user_id % 3 = 1 AND user_id >= 25),
  p AS (SELECT s.*, n_nationkey::BIGINT AS asset_id FROM s, nation),
  a AS (SELECT user_id AS asset_id, ts AS t, value AS v FROM events WHERE user_id < 25),
  b AS (SELECT p.*, a.t AS tb, a.v AS vb FROM p ASOF LEFT JOIN a ON p.asset_id = a.asset_id AND p.ts >= a.t),
  f AS (SELECT b.*, a.t AS tf, a.v AS vf FROM b ASOF LEFT JOIN a ON b.asset_id = a.asset_id AND b.ts <= a.t),
  m AS (SELECT suspect_id, asset_id, ts, event_id, value, CASE WHEN tb IS NOT NULL AND (tf IS NULL OR ts - tb <= tf - ts)
          THEN vb ELSE vf END AS v, CASE WHEN tb IS NOT NULL AND (tf IS NULL OR ts - tb <= tf - ts)
          THEN ts - tb ELSE tf - ts END AS gap FROM f),
  al AS (SELECT suspect_id, asset_id, value AS a, v AS b, row_number() OVER (PARTITION BY suspect_id, asset_id ORDER BY ts, event_id) - 1 AS i,
         count(*) OVER (PARTITION BY suspect_id, asset_id) AS n, avg(value) OVER (PARTITION BY suspect_id, asset_id) AS ma,
         avg(v) OVER (PARTITION BY suspect_id, asset_id) AS mb FROM m WHERE gap <= INTERVAL 12 HOUR),
  y AS (SELECT suspect_id, asset_id, i, n, sum(a-ma) OVER w AS ya, sum(b-mb) OVER w AS yb FROM al
        WINDOW w AS (PARTITION BY suspect_id, asset_id ORDER BY i)),
  sg AS (SELECT suspect_id, asset_id, s, i // s AS k, regr_syy(ya, i%s) - regr_sxy(ya, i%s)**2/regr_sxx(ya, i%s) AS faa,
         regr_syy(yb, i%s) - regr_sxy(yb, i%s)**2/regr_sxx(yb, i%s) AS fbb,
         regr_sxy(ya, yb) - regr_sxy(ya, i%s)*regr_sxy(yb, i%s)/regr_sxx(ya, i%s) AS fab
         FROM y, (SELECT unnest(range(4, 31)) AS s) WHERE n >= 12 AND s <= floor(n*0.25) AND i < (n // s)*s
         GROUP BY suspect_id, asset_id, s, i // s),
  sc AS (SELECT suspect_id, asset_id, s, sum(fab)/sqrt(sum(faa)*sum(fbb)) AS rho FROM sg GROUP BY ALL)
  SELECT suspect_id, asset_id, round(avg(rho), 5) AS dcca FROM sc GROUP BY ALL"""


@query("i17_cross_correlation", DCCA_SQL)
def i17(spark, sf):
    """Coupling of every suspect and asset over the whole of both series."""
    mine = suspect_events(spark, sf).withColumnRenamed("user_id", "suspect_id")
    other = asset_events(spark, sf).select(F.col("user_id").alias("asset_id"), "ts", "value")
    return P.coupling(mine, other).select("suspect_id", "asset_id", F.round("dcca", 5).alias("dcca"))
