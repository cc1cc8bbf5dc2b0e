"""Streaming queries, run to completion on the events files."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators.skew import keep_last
from driftline.operators.windows import numbered
from driftline.plans.inputs import Z20_SQL, events, micros
from driftline.plans.registry import query
from driftline.session import scratch_path, table
from driftline.streaming import jobs


def event_stream(spark, sf):
    """The events file as a stream; time as UTC timestamps."""
    schema = table(spark, sf, "events").schema
    s = jobs.read_files(spark, sf, "events.parquet", schema)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


STATUS_OF = {"view": "OPEN", "click": "ACKNOWLEDGED", "purchase": "RESOLVED", "error": "SUPPRESSED", "signup": "OPEN"}


#: Later than every event: the marks that end the finished inputs.
END, NOW = "2030-01-01 00:00:00", "2024-02-01 00:00:00"


def requests(df):
    """Requested alert states: one per event, by event type."""
    pairs = [F.lit(x) for kv in STATUS_OF.items() for x in kv]
    return df.select("user_id", "event_id", "ts", F.element_at(F.create_map(*pairs), F.col("event_type")).alias("want"))


@query("t1_append_once", "SELECT DISTINCT user_id, epoch_us(ts) AS t_us FROM events")
def t1(spark, sf):
    """Every row arrives twice; each (entity, time) is kept once, in its day."""
    s = event_stream(spark, sf).select("user_id", "ts", "event_id", "value")
    path = scratch_path(spark, "append")
    jobs.drain(jobs.upsert_days(s.unionByName(s), ["user_id", "ts"], "ts", ["event_id"], path), spark, "append")
    return jobs.history(spark, path).select("user_id", micros("ts").alias("t_us"))


T2_SQL = f"""WITH {Z20_SQL}, x AS (SELECT event_id, user_id, unnest(z) AS z, unnest(range(1, 20)) AS i FROM zz),
    p AS (SELECT event_id, user_id, i, sum(z - 0.5) OVER w AS up, sum(-z - 0.5) OVER w AS dn, 0.2*pow(0.8, i)*sum(z*pow(0.8, -i)) OVER w AS e FROM x WINDOW w AS (PARTITION BY event_id ORDER BY i)),
    s AS (SELECT event_id, user_id, up - least(0, min(up) OVER w) AS sp, dn - least(0, min(dn) OVER w) AS sn, e FROM p WINDOW w AS (PARTITION BY event_id ORDER BY i))
    SELECT user_id, event_id, round(least(1, greatest(max(sp), max(sn))/4), 6) AS cusum, round(least(1, max(abs(e))/(3*sqrt(0.2::DOUBLE/1.8))), 6) AS ewma FROM s GROUP BY ALL"""


@query("t2_rolling_detectors", T2_SQL)
def t2(spark, sf):
    s = event_stream(spark, sf).select("user_id", "event_id", "ts", "value")
    path, mark = scratch_path(spark, "rolling"), jobs.ClosingMark(spark, "ts", END)
    w = jobs.rolling_detectors(mark.behind(s, "1 day"), "ts").writeStream.format("parquet").option("path", path).outputMode("append")
    jobs.drain(w, spark, "rolling", mark)
    r = spark.read.schema(jobs.ROLLING).parquet(path)
    return r.select("user_id", "event_id", F.round("cusum", 6).alias("cusum"), F.round("ewma", 6).alias("ewma"))


LIFECYCLE_SQL = """WITH RECURSIVE q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_type WHEN 'click' THEN 'ACKNOWLEDGED' WHEN 'purchase' THEN 'RESOLVED'
       WHEN 'error' THEN 'SUPPRESSED' ELSE 'OPEN' END AS w FROM events),
    r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'OPEN' AS s, 0::BIGINT AS ok, 0::BIGINT AS bad FROM q UNION ALL
      SELECT user_id, i, CASE WHEN good THEN w ELSE s END, ok + good::INT, bad + (NOT good)::INT FROM (SELECT r.user_id, q.i, q.w, r.s, r.ok, r.bad,
        q.w = r.s OR (r.s = 'OPEN') OR (r.s = 'ACKNOWLEDGED') OR (r.s IN ('RESOLVED','SUPPRESSED') AND q.w = 'OPEN') AS good FROM r JOIN q ON q.user_id = r.user_id AND q.i = r.i + 1))
    SELECT user_id, arg_max(s, i) AS status, max(ok) AS accepted, max(bad) AS rejected FROM r GROUP BY 1"""


@query("t3_alert_lifecycle", LIFECYCLE_SQL)
def t3(spark, sf):
    log = numbered(requests(events(spark, sf, "user_id", "event_id", "event_type", "ts")), "user_id", "ts", ["event_id"])
    return jobs.lifecycle(log, "user_id", "pos", "want")


@query("t3_alert_lifecycle_stream", LIFECYCLE_SQL)
def t3s(spark, sf):
    path, mark = scratch_path(spark, "audit"), jobs.ClosingMark(spark, "ts", END)
    audit = jobs.lifecycle_stream(mark.behind(requests(event_stream(spark, sf)), "1 day"), "ts", "want")
    jobs.drain(audit.writeStream.format("parquet").option("path", path).outputMode("append"), spark, "audit", mark)
    a = spark.read.schema(jobs.AUDIT).parquet(path).join(events(spark, sf, "event_id", "ts"), "event_id")
    return a.groupBy("user_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected")
    )


@query(
    "t4_daily_change",
    """WITH d AS (SELECT user_id, ts::DATE AS d, avg(value) AS s FROM events WHERE ts < (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) FROM events) GROUP BY ALL)
    SELECT a.user_id, strftime(a.d, '%Y-%m-%d') AS day, round(a.s, 6) AS score, round(a.s - b.s, 6) AS delta FROM d a LEFT JOIN d b ON b.user_id = a.user_id AND b.d = a.d - 1""",
)
def t4(spark, sf):
    """Closed days only (the watermark trails by an hour); change against the day before, kept in the state."""
    path = scratch_path(spark, "daily-change")
    s = event_stream(spark, sf).select("user_id", "ts", "value").withWatermark("ts", "1 hour")
    jobs.drain(jobs.daily_change(s, "ts").writeStream.format("parquet").option("path", path).outputMode("append"), spark, "daily-change")
    d = spark.read.schema(jobs.CHANGE).parquet(path)
    return d.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("score", 6).alias("score"), F.round("delta", 6).alias("delta"))


@query(
    "t5_stale_penalty",
    """SELECT user_id, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts)))/3.6e9, 4) AS age_hours, CASE WHEN (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts)))/3.6e9 > 72 THEN 0.35
      WHEN (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts)))/3.6e9 > 36 THEN 0.15 ELSE 0 END::DOUBLE AS penalty FROM events GROUP BY 1""",
)
def t5(spark, sf):
    """Streaming last-seen time per entity; age lowers reliability as the watermark moves on."""
    path = scratch_path(spark, "last-seen")
    mark = jobs.ClosingMark(spark, "ts", NOW)
    seen = jobs.staleness(mark.behind(event_stream(spark, sf).select("user_id", "ts"), "0 seconds"), "ts")
    jobs.drain(seen.writeStream.format("parquet").option("path", path).outputMode("append"), spark, "last-seen", mark)
    last = keep_last(spark.read.schema(jobs.SEEN).parquet(path), ["user_id"], [F.desc("us"), F.desc("penalty")])
    age = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.col("us")) / 3.6e9
    return last.select("user_id", F.round(age, 4).alias("age_hours"), "penalty")
