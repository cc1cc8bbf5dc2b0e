"""Driver tables in the shapes the operators take, and the same shapes as SQL text.

``events`` stands for entity observations, ``user_id`` for the entity, ``event_id`` breaks ties.
Orbital elements, roles and event cases are derived from the tables by fixed formulas, so every
query grows with its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import scalars as X
from driftline.session import table


def events(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    cols = columns or ("user_id", "ts", "event_id", "value")
    return table(spark, sf, "events").select(*cols)


def micros(c):
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


ROLE_SQL = "CASE user_id % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'suspect' ELSE 'asset' END"


def role(uid):
    return F.when(uid % 3 == 0, "baseline").when(uid % 3 == 1, "suspect").otherwise("asset")


def elements(spark: SparkSession, sf: str) -> DataFrame:
    """Orbital elements per event; the axis wanders with the observed value."""
    e = events(spark, sf)
    u = F.col("user_id")
    return e.select(
        u.alias("norad_id"),
        F.concat(F.lit("OBJ-"), u.cast("string")).alias("object_name"),
        "ts",
        "event_id",
        (F.lit(6900.0) + (u % 40) * 12.5 + F.col("value") / 50.0).alias("sma"),
        (F.lit(40.0) + (u % 11) * 5.0 + F.col("value") / 1000.0).alias("inc"),
        ((u * 37) % 360).cast("double").alias("raan"),
        (F.lit(0.001) + (F.col("event_id") % 10) / 10000.0).alias("ecc"),
    ).withColumn("mm", X.mean_motion_from_sma(F.col("sma")))


EL_SQL = """el AS (
  SELECT norad_id, object_name, ts, event_id, sma, inc, raan, ecc,
         86400.0::DOUBLE/(2*pi())*sqrt(398600.4418::DOUBLE/(sma*sma*sma)) AS mm
  FROM (SELECT user_id AS norad_id, 'OBJ-' || user_id AS object_name, ts, event_id,
               6900.0::DOUBLE + (user_id % 40)*12.5::DOUBLE + value/50 AS sma,
               40.0::DOUBLE + (user_id % 11)*5.0::DOUBLE + value/1000 AS inc,
               ((user_id*37) % 360)::DOUBLE AS raan,
               0.001::DOUBLE + (event_id % 10)/10000.0::DOUBLE AS ecc FROM events))"""

EV_SQL = """ev AS (
  SELECT user_id, ts, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
         count(*) OVER (PARTITION BY user_id) AS n FROM events)"""

W20_SQL = EV_SQL + """, w AS (
  SELECT * FROM (SELECT user_id, ts, event_id, value, pos, n,
    list(value) OVER (PARTITION BY user_id ORDER BY pos ROWS 19 PRECEDING) AS v FROM ev)
  WHERE pos >= 20)"""

D20_SQL = W20_SQL + """, wd AS (
  SELECT *, list_transform(range(1, 20), lambda i: v[i+1] - v[i]) AS d FROM w)"""

Z20_SQL = D20_SQL + """, zb AS (
  SELECT *, d[1:18] AS b, list_median(d[1:18]) AS med FROM wd),
zm AS (SELECT *, list_median(list_transform(b, lambda x: abs(x - med))) AS mad FROM zb),
zs AS (SELECT *, greatest(CASE WHEN 1.4826*mad < 1e-12
         THEN greatest(list_aggregate(b, 'stddev_pop'), 1e-9) ELSE 1.4826*mad END, 0.05)::DOUBLE AS sigma
       FROM zm),
zz AS (SELECT *, list_transform(d, lambda x: (x - med)/sigma) AS z FROM zs)"""


def windows20(spark: SparkSession, sf: str, step: int = 1) -> DataFrame:
    from driftline.operators.windows import sliding_windows

    return sliding_windows(events(spark, sf), "user_id", "ts", ["value"], ["event_id"], step=step).withColumnRenamed(
        "value_w", "v"
    )


BOARD_SQL = """b AS (SELECT *, CASE WHEN role = 'suspect' AND reliable THEN c_nation END AS asset_norad,
    CASE WHEN pair_risk >= 0.75 THEN 'CRITICAL' WHEN pair_risk >= 0.55 THEN 'ELEVATED' WHEN pair_risk >= 0.35 THEN 'WATCH' ELSE 'LOW' END AS risk_level
  FROM (SELECT c_custkey AS norad_id, c_name AS name, c_nationkey::BIGINT AS c_nation,
    CASE c_custkey % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'suspect' ELSE 'asset' END AS role,
    'N' || c_nationkey AS country, lower(c_mktsegment) AS purpose,
    CASE c_custkey % 4 WHEN 0 THEN 'GEO' WHEN 1 THEN 'MEO' ELSE 'LEO' END AS orbit_class,
    (c_acctbal + 1000)/11000 AS score,
    CASE WHEN c_custkey % 5 <> 0 THEN (c_acctbal + 1000)/11000 * (0.7 + (c_custkey % 7)/10.0::DOUBLE) END AS prev_score,
    c_custkey % 11 <> 0 AS reliable, ((c_custkey*37) % 101)/100.0::DOUBLE AS pair_risk,
    ((c_custkey*53) % 900)::DOUBLE AS pair_dist FROM customer))"""


def board(spark: SparkSession, sf: str) -> DataFrame:
    """Scored objects in board shape, one per customer."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    score = (F.col("c_acctbal") + 1000) / 11000
    b = c.select(
        k.alias("norad_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("bigint").alias("c_nation"),
        role(k).alias("role"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("country"),
        F.lower("c_mktsegment").alias("purpose"),
        F.when(k % 4 == 0, "GEO").when(k % 4 == 1, "MEO").otherwise("LEO").alias("orbit_class"),
        score.alias("score"),
        F.when(k % 5 != 0, score * (F.lit(0.7) + (k % 7) / 10.0)).alias("prev_score"),
        (k % 11 != 0).alias("reliable"),
        (((k * 37) % 101) / 100.0).alias("pair_risk"),
        ((k * 53) % 900).cast("double").alias("pair_dist"),
    )
    risk = F.col("pair_risk")
    return b.withColumn(
        "asset_norad", F.when((F.col("role") == "suspect") & F.col("reliable"), F.col("c_nation"))
    ).withColumn(
        "risk_level",
        F.when(risk >= 0.75, "CRITICAL").when(risk >= 0.55, "ELEVATED").when(risk >= 0.35, "WATCH").otherwise("LOW"),
    )


STATUS_SQL = BOARD_SQL + """, r AS (SELECT *, score >= 0.5 AS outlier,
    coalesce(score - prev_score >= 0.08 AND score >= 0.45*0.85, false) AS change, risk_level = 'CRITICAL' AS hot FROM b),
  st AS (SELECT *, CASE WHEN NOT reliable THEN 'UNRELIABLE_DATA' WHEN role = 'baseline' THEN 'CALIBRATION_BASELINE'
     WHEN role = 'suspect' THEN CASE WHEN hot AND NOT outlier THEN 'PAIR_ELEVATED' WHEN outlier THEN 'ANOMALY'
        WHEN change THEN 'CHANGE_RELEVANT' ELSE 'NOMINAL' END
     ELSE CASE WHEN outlier OR change THEN 'ASSET_REGIME_NOISE' ELSE 'NOMINAL' END END AS status,
     reliable AND role = 'suspect' AND (outlier OR change OR hot) AS is_detection,
     reliable AND role = 'asset' AND (outlier OR change) AS is_health_flag FROM r),
  sb AS (SELECT *, is_detection OR is_health_flag AS is_anomaly, role = 'baseline' AS is_calibration,
     CASE WHEN reliable THEN least(1, greatest(0, 0.45*score + 0.55*pair_risk)) ELSE score END AS attention FROM st)"""


def status_board(spark: SparkSession, sf: str) -> DataFrame:
    """Board rows with status, flags and attention."""
    b = board(spark, sf)
    outlier = F.col("score") >= 0.5
    change = F.coalesce(
        (F.col("score") - F.col("prev_score") >= 0.08) & (F.col("score") >= 0.45 * 0.85), F.lit(False)
    )
    st = X.status(F.col("role"), F.col("reliable"), outlier, change, F.col("risk_level") == "CRITICAL")
    att = F.when(
        F.col("reliable"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") * 0.45 + F.col("pair_risk") * 0.55))
    ).otherwise(F.col("score"))
    return b.withColumn("outlier", outlier).withColumn("change", change).withColumn("st", st).select(
        "*", "st.*", att.alias("attention")
    ).drop("st")
