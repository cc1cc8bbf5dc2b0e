"""Scans, intake, upserts, text formats, catalogs and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.skew import keep_last, positions
from driftline.plans.inputs import STATUS_SQL, events, micros
from driftline.plans.registry import query
from driftline.session import scratch_path, table
from driftline.sources import catalogs as C
from driftline.sources import epochs as E
from driftline.sources import text as X


def us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query(
    "a1_normalize_epochs",
    """WITH r AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS norad_id,
       CASE WHEN event_id % 89 = 0 THEN NULL ELSE date_trunc('hour', ts) END AS t,
       CASE WHEN event_id % 83 = 0 THEN NULL ELSE 10 + value/100 END AS mm FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY norad_id, t ORDER BY event_id DESC) AS r FROM r
          WHERE norad_id IS NOT NULL AND t IS NOT NULL AND mm IS NOT NULL)
    SELECT norad_id, epoch_us(t) AS t_us, round(mm, 6) AS mean_motion,
       round(pow(398600.4418::DOUBLE/pow(mm*2*pi()/86400, 2), 1/3.0::DOUBLE), 4) AS sma_km, 'feed' AS source FROM k WHERE r = 1""",
)
def a1(spark, sf):
    e = events(spark, sf)
    raw = e.select(
        F.when(F.col("event_id") % 97 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("NORAD_CAT_ID"),
        F.when(F.col("event_id") % 89 != 0, F.date_trunc("hour", "ts").cast("string")).alias("Epoch"),
        F.when(F.col("event_id") % 83 == 0, "?").otherwise((F.lit(10.0) + F.col("value") / 100).cast("string")).alias("MEAN_MOTION"),
        F.lit("X").alias("OBJECT_ID"),
        "event_id",
    )
    n = E.normalize_epochs(raw, "feed", F.col("event_id"))
    return n.select(
        "norad_id", us("timestamp").alias("t_us"), F.round("mean_motion_rev_per_day", 6).alias("mean_motion"),
        F.round("semi_major_axis_km", 4).alias("sma_km"), "source",
    )


@query(
    "a2_read_history",
    "SELECT event_id, user_id, epoch_us(ts) AS t_us, value FROM events",
)
def a2(spark, sf):
    schema = T.StructType(
        [T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
         T.StructField("ts", T.TimestampNTZType()), T.StructField("value", T.DoubleType())]
    )
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    h = E.load_history(spark, f"{sf}/events.parquet", f"{sf}/events.csv", schema)
    return h.select("event_id", "user_id", micros("ts").alias("t_us"), "value")


@query(
    "a3_write_history",
    "SELECT year(o_orderdate)::BIGINT AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def a3(spark, sf):
    path = scratch_path(spark, "history")
    o = table(spark, sf, "orders")
    E.save_history(o, path, ts="o_orderdate", csv=f"{path}-csv")
    back = spark.read.parquet(path)
    return back.groupBy(F.col("year").cast("bigint").alias("y")).agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "a4_append_epochs",
    """WITH h AS (SELECT user_id, ts, value, 0 AS f FROM events WHERE ts < TIMESTAMP '2024-01-20'),
    n AS (SELECT user_id, ts, value*2 AS value, 1 AS f FROM events WHERE ts >= TIMESTAMP '2024-01-15'),
    u AS (SELECT * FROM h UNION ALL SELECT * FROM n)
    SELECT user_id, epoch_us(ts) AS t_us, max_by(value, f) AS value, min(f) = 1 AS is_new FROM u GROUP BY user_id, ts""",
)
def a4(spark, sf):
    e = events(spark, sf, "user_id", "ts", "value")
    h = e.where("ts < timestamp_ntz'2024-01-20 00:00:00'")
    n = e.where("ts >= timestamp_ntz'2024-01-15 00:00:00'").withColumn("value", F.col("value") * 2)
    return E.append_epochs(h, n, ["user_id", "ts"]).select("user_id", micros("ts").alias("t_us"), "value", "is_new")


@query(
    "a5_filtered_scan",
    """SELECT l_suppkey, l_orderkey, l_linenumber::BIGINT AS line, l_quantity FROM lineitem
    WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 3)""",
)
def a5(spark, sf):
    ids = table(spark, sf, "supplier").where("s_nationkey < 3").select(F.col("s_suppkey").alias("l_suppkey"))
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), "l_quantity")
    return E.filtered_scan(li, ids, "l_suppkey")


@query(
    "a6_multi_year_seed",
    """WITH w AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
    done AS (SELECT year(o_orderdate) AS y FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
             HAVING count(*) >= (SELECT count(*)/24 FROM orders))
    SELECT year(o_orderdate)::BIGINT AS y, o_custkey, count(*) AS kept FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM w) AND year(o_orderdate) NOT IN (SELECT y FROM done) GROUP BY ALL""",
)
def a6(spark, sf):
    o = table(spark, sf, "orders")
    want = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    floor = o.agg((F.count("*") / 24)).scalar()
    seeded = o.where("o_orderstatus = 'F'").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).where(F.col("n") >= floor)
    new = E.filtered_scan(o.withColumn("year", F.year("o_orderdate")).join(seeded.select("year"), "year", "left_anti"), want, "o_custkey")
    return new.groupBy(F.col("year").cast("bigint").alias("y"), "o_custkey").agg(F.count("*").alias("kept"))


@query(
    "a7_capped_scan",
    """SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS t_us FROM orders
    WHERE o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34) AND year(o_orderdate) >= 1996 ORDER BY o_orderdate, o_orderkey LIMIT 50""",
)
def a7(spark, sf):
    o = E.filtered_scan(table(spark, sf, "orders"), [1, 2, 3, 5, 8, 13, 21, 34], "o_custkey")
    return (
        o.where(F.col("o_orderdate") >= F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))
        .orderBy("o_orderdate", "o_orderkey").limit(50)
        .select("o_orderkey", "o_custkey", micros("o_orderdate").alias("t_us"))
    )


@query(
    "a8_sql_scan",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE year(o_orderdate) >= 1997
    AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) ORDER BY o_orderdate""",
)
def a8(spark, sf):
    return spark.sql(
        """SELECT o_orderkey, o_custkey, o_totalprice FROM {orders}
        WHERE o_orderdate >= timestamp_ntz'1997-01-01 00:00:00'
        AND o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_nationkey = 7) ORDER BY o_orderdate""",
        orders=table(spark, sf, "orders"), customer=table(spark, sf, "customer"),
    )


@query(
    "a9_legacy_rows",
    """WITH p AS (SELECT p_partkey, upper(CASE p_size % 5 WHEN 0 THEN 'USA-' WHEN 1 THEN 'YAOGAN-' WHEN 2 THEN 'COSMOS '
         WHEN 3 THEN 'ISS ' ELSE '' END || p_name) AS nm, 1 + p_size/4.0::DOUBLE AS mm FROM part),
    c AS (SELECT *, pow(398600.4418::DOUBLE/pow(mm*2*pi()/86400, 2), 1/3.0::DOUBLE) AS a,
        CASE WHEN contains(nm,'USA') OR contains(nm,'STARLINK') OR contains(nm,'ISS') OR contains(nm,'NAVSTAR') THEN 'US'
         WHEN contains(nm,'YAOGAN') OR contains(nm,'BEIDOU') THEN 'CN' WHEN contains(nm,'COSMOS') THEN 'RU' ELSE 'UNKNOWN' END AS country FROM p)
    SELECT p_partkey, round(a, 4) AS sma_km, country, CASE WHEN country IN ('CN','RU') OR contains(nm,'USA') THEN 'military'
      ELSE 'scientific' END AS purpose, CASE WHEN a < 8000 THEN 'LEO' ELSE 'MEO' END AS orbit_class FROM c""",
)
def a9(spark, sf):
    from driftline.functions import scalars as S

    size = F.col("p_size") % 5
    prefix = F.when(size == 0, "USA-").when(size == 1, "YAOGAN-").when(size == 2, "COSMOS ").when(size == 3, "ISS ").otherwise("")
    p = table(spark, sf, "part").select(
        "p_partkey", F.concat(prefix, "p_name").alias("name"), (F.lit(1.0) + F.col("p_size") / 4.0).alias("mm")
    )
    p = p.withColumn("sma", S.sma_from_mean_motion(F.col("mm"))).withColumn("country", S.country_from_name(F.col("name")))
    return p.select(
        "p_partkey", F.round("sma", 4).alias("sma_km"), "country",
        S.purpose_from_name(F.col("name"), F.col("country")).alias("purpose"),
        F.when(F.col("sma") < 8000, "LEO").otherwise("MEO").alias("orbit_class"),
    )


@query(
    "a10_daily_snapshot",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_rows, count(DISTINCT user_id) AS n_ids FROM events GROUP BY 1",
)
def a10(spark, sf):
    path = scratch_path(spark, "daily")
    e = events(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    # Days are spread by entity too, so one busy day is written by many tasks.
    e.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    back = spark.read.schema(e.schema).parquet(path)
    return back.groupBy("day").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_ids"))


@query(
    "a11_daily_merge",
    """WITH pref AS (SELECT user_id AS norad_id, date_trunc('day', ts) AS t, value, event_id AS seq, event_type AS object_name
        FROM events WHERE event_type = 'purchase' AND user_id % 7 <> 0),
    grp AS (SELECT user_id AS norad_id, date_trunc('day', ts) AS t, value, event_id AS seq, event_type AS object_name
        FROM events WHERE event_type = 'view'),
    u AS (SELECT * FROM pref UNION ALL SELECT * FROM grp WHERE norad_id NOT IN (SELECT norad_id FROM pref)),
    w AS (SELECT * FROM u WHERE norad_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)),
    o AS (SELECT *, row_number() OVER (PARTITION BY norad_id, t ORDER BY seq DESC) AS r FROM w)
    SELECT norad_id, epoch_us(t) AS t_us, value, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, object_name) AS object_name
    FROM o LEFT JOIN customer ON norad_id = c_custkey WHERE r = 1""",
)
def a11(spark, sf):
    e = events(spark, sf, "user_id", "ts", "value", "event_id", "event_type").select(
        F.col("user_id").alias("norad_id"), F.date_trunc("day", "ts").alias("t"), "value",
        F.col("event_id").alias("seq"), F.col("event_type").alias("object_name"),
    )
    c = table(spark, sf, "customer")
    want = c.where("c_nationkey < 20").select(F.col("c_custkey").alias("norad_id"))
    names = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("norad_id"), F.col("c_name").alias("catalog_name"))
    m = E.merge_daily(
        e.where("object_name = 'purchase' AND norad_id % 7 <> 0"), e.where("object_name = 'view'"), want, names, "norad_id", "t"
    )
    return m.select("norad_id", us("t").alias("t_us"), "value", "object_name")


@query(
    "a12_sample_rows",
    "SELECT event_id, user_id FROM events ORDER BY md5('42-' || event_id), event_id LIMIT 500",
)
def a12(spark, sf):
    return E.sample_rows(events(spark, sf, "event_id", "user_id"), "event_id", 500)


def index_lines(spark, sf):
    """Daily index text built from order dates: one 27-token line per day, some values missing."""
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(
        F.count("*").alias("n"), F.max("o_custkey").alias("m"), F.min("o_custkey").alias("k")
    )
    kp = [F.when((F.col("m") + i) % 9 == 0, F.lit("-1.000")).otherwise(F.format_string("%.3f", ((F.col("m") + i) % 27) / 3.0)) for i in range(8)]
    ap = [((F.col("m") + i) % 50).cast("string") for i in range(8)]
    f = F.when(F.col("k") % 10 == 0, F.lit("-1.0")).otherwise(F.format_string("%.1f", F.lit(70.0) + F.col("m") % 150))
    line = F.concat_ws(
        " ", F.date_format("d", "yyyy MM dd"), F.lit("100"), F.lit("100.5"), F.lit("2500"), F.lit("7"), *kp, *ap,
        (F.col("n") % 60).cast("string"), (F.col("k") % 200).cast("string"), f, f, F.lit("2"),
    )
    body = F.when(F.col("n") % 11 == 0, F.concat(F.lit("# "), line)).when(F.col("n") % 13 == 0, F.lit("1999 01 01 1")).otherwise(line)
    return o.select(body.alias("line"))


@query(
    "a13_parse_index_text",
    """WITH o AS (SELECT o_orderdate::DATE AS d, count(*) AS n, max(o_custkey) AS m, min(o_custkey) AS k FROM orders GROUP BY 1),
    k AS (SELECT d, n, m, k, list_filter(list_transform(range(0, 8), lambda i: CASE WHEN (m + i) % 9 = 0 THEN -1.0
        ELSE round(((m + i) % 27)/3.0::DOUBLE, 3) END::DOUBLE), lambda x: x >= 0) AS kp FROM o WHERE n % 11 <> 0 AND n % 13 <> 0)
    SELECT strftime(d, '%Y-%m-%d') AS day, CASE WHEN k % 10 <> 0 THEN (70 + m % 150)::DOUBLE END AS f10_7,
      (n % 60)::DOUBLE AS ap_index, round(list_avg(kp), 5) AS kp_mean, (k % 200)::DOUBLE AS sunspot FROM k""",
)
def a13(spark, sf):
    p = X.parse_index_lines(index_lines(spark, sf))
    return p.select(
        F.date_format("date", "yyyy-MM-dd").alias("day"), "f10_7", "ap_index", F.round("kp_mean", 5).alias("kp_mean"),
        F.col("sunspot_number").alias("sunspot"),
    )


@query(
    "a14_parse_flux_feed",
    """WITH e AS (SELECT ts::DATE AS d, date_trunc('second', ts) AS t, value FROM events WHERE event_id % 17 <> 0)
    SELECT strftime(d, '%Y-%m-%d') AS day, max_by(value, (t, value)) AS flux FROM e GROUP BY d""",
)
def a14(spark, sf):
    e = events(spark, sf)
    tag = F.when(F.col("event_id") % 17 == 0, "broken").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    docs = e.select(F.to_json(F.array(F.struct(tag.alias("time_tag"), F.col("value").alias("flux")))).alias("body"))
    return X.parse_flux_feed(docs).select(F.date_format("date", "yyyy-MM-dd").alias("day"), "flux")


@query(
    "a15_merge_archives",
    """WITH p AS (SELECT o_orderdate::DATE AS d, count(*)::DOUBLE AS f, max(o_custkey)::DOUBLE AS ap FROM orders
        WHERE o_orderstatus <> 'O' AND o_orderdate >= '1995-01-01' GROUP BY 1),
    s AS (SELECT l_shipdate::DATE AS d, count(*)::DOUBLE AS f FROM lineitem WHERE l_returnflag = 'R' AND day(l_shipdate) < 6 GROUP BY 1)
    SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(s.f, p.f) AS f10_7, ap FROM p FULL JOIN s USING (d)""",
)
def a15(spark, sf):
    p = table(spark, sf, "orders").where("o_orderstatus <> 'O'").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.count("*").cast("double").alias("f10_7"), F.max("o_custkey").cast("double").alias("ap")
    )
    s = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND day(l_shipdate) < 6").groupBy(
        F.to_date("l_shipdate").alias("date")
    ).agg(F.count("*").cast("double").alias("f10_7"))
    return X.merge_index(p, s, "date", "f10_7", "1995-01-01").select(
        F.date_format("date", "yyyy-MM-dd").alias("day"), "f10_7", "ap"
    )


@query(
    "a16_normalize_index",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, sum(o_totalprice/1e6) AS f, count(*)::DOUBLE AS ap_index,
    NULL::DOUBLE AS kp_mean, 'unknown' AS source FROM orders GROUP BY 1""".replace("sum(o_totalprice/1e6) AS f", "round(sum(o_totalprice)/1e6, 4) AS f10_7"),
)
def a16(spark, sf):
    old = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).agg(
        F.round(F.sum("o_totalprice") / 1e6, 4).alias("f10_7_obs"), F.count("*").cast("double").alias("Ap")
    )
    return X.normalize_index(old).select("date", "f10_7", "ap_index", "kp_mean", "source")


@query(
    "a17_parse_element_records",
    """SELECT p_partkey AS norad_id, CASE WHEN p_partkey % 5 = 0 THEN 'NORAD ' || p_partkey ELSE p_name END AS object_name,
      epoch_us(make_date(CASE WHEN p_size + 30 < 57 THEN 2030 + p_size ELSE 1930 + p_size END, 1, 1)::TIMESTAMP)
        + (p_partkey % 365)*86400000000 + (p_size % 4)*21600000000 AS epoch_us,
      round(CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END * (10000 + p_partkey)/1e5::DOUBLE * 1e-4::DOUBLE, 9) AS bstar,
      round(30 + p_size + 0.25::DOUBLE, 4) AS inc, round((p_partkey*7) % 360 + 0.5::DOUBLE, 4) AS raan,
      round((1000 + p_partkey)/1e7::DOUBLE, 7) AS ecc, round(10 + p_size/10.0::DOUBLE, 8) AS mean_motion
    FROM (SELECT p_name, p_size, p_partkey % 90000 AS p_partkey FROM part) WHERE p_partkey % 11 <> 0""",
)
def a17(spark, sf):
    return X.parse_element_records(record_lines(spark, sf)).select(
        "norad_id", "object_name", "epoch_us", F.round("bstar", 9).alias("bstar"),
        F.round("inclination_deg", 4).alias("inc"), F.round("raan_deg", 4).alias("raan"),
        F.round("eccentricity", 7).alias("ecc"), F.round("mean_motion", 8).alias("mean_motion"),
    )


def record_lines(spark, sf):
    """Element records as text lines: per part a name line (mostly), line 1 and line 2.

    The format has five digits for an id, so ids start again after 90 000; every eleventh record has a
    short second line.
    """
    p = table(spark, sf, "part")
    k, s = F.col("p_partkey") % 90000, F.col("p_size")
    l1 = F.format_string(
        "1 %05dU 20001A   %02d%03d.%s  .00000000  00000-0 %s 0  9990", k, (s + 30) % 100, (k % 365 + 1).cast("int"),
        F.element_at(F.array(F.lit("00000000"), F.lit("25000000"), F.lit("50000000"), F.lit("75000000")), (s % 4 + 1).cast("int")),
        F.concat(F.when(k % 3 == 0, "-").otherwise(" "), F.lpad((k + 10000).cast("string"), 5, "0"), F.lit("-4")),
    )
    l2 = F.format_string(
        "2 %05d %8.4f %8.4f %07d   0.0000   0.0000 %11.8f    1", k, s + 30.25, ((k * 7) % 360) + 0.5, k + 1000, s / 10.0 + 10.0
    )
    l2 = F.when(k % 11 == 0, F.substring(l2, 1, 30)).otherwise(l2)
    name = F.when(k % 5 != 0, F.col("p_name")).otherwise(F.lit("# comment"))
    lines = p.select(
        (k % 3).alias("file"), F.col("p_partkey").alias("g"), F.posexplode(F.array(name, l1, l2)).alias("i", "line")
    )
    return positions(lines, ["file"], ["g", "i"], F.floor(F.col("g") / 1000), "line_no")


@query(
    "a18_merge_feeds",
    """WITH f AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'view' THEN 5 WHEN 'signup' THEN 4 WHEN 'error' THEN 2
         WHEN 'click' THEN 3 ELSE 1 END AS p FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_id) AS r FROM f)
    SELECT user_id, event_type AS feed, event_id FROM r WHERE r = 1 ORDER BY feed, user_id""",
)
def a18(spark, sf):
    """Feeds by precedence: an overriding feed replaces, others only add."""
    e = events(spark, sf, "user_id", "event_id", "event_type")
    order = ["view", "signup", "click", "error", "purchase"]
    feeds = None
    for i, name in enumerate(order):
        f = e.where(F.col("event_type") == name).withColumn("priority", F.lit(len(order) - i))
        feeds = f if feeds is None else feeds.unionByName(f)
    best = keep_last(feeds, ["user_id"], [F.desc("priority"), F.asc("event_id")])
    return best.select("user_id", F.col("event_type").alias("feed"), "event_id").orderBy("feed", "user_id")


def watchlist_docs(spark, sf):
    """One watchlist JSON document per customer nation, with odd roles and missing ids."""
    c = table(spark, sf, "customer")
    obj = F.struct(
        F.when(F.col("c_custkey") % 29 == 0, "bad").otherwise(F.col("c_custkey").cast("string")).alias("norad_id"),
        F.when(F.col("c_custkey") % 13 != 0, F.col("c_name")).alias("name"),
        F.element_at(F.array(F.lit("asset"), F.lit(" Suspect"), F.lit("baseline"), F.lit("ally")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("role"),
        F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("country"),
        F.lower("c_mktsegment").alias("purpose"),
    )
    # A document holds at most a bucket of 256 neighbouring ids, so none grows with the table.
    return c.groupBy(F.floor(F.col("c_custkey") / 256).alias("doc")).agg(F.collect_list(obj).alias("objects")).select(
        F.to_json(F.struct(F.lit(1).alias("version"), "objects")).alias("body")
    )


CAT_SQL = """cat AS (SELECT c_custkey AS norad_id, CASE WHEN c_custkey % 13 = 0 THEN 'NORAD-' || c_custkey ELSE c_name END AS name,
    CASE c_custkey % 4 WHEN 0 THEN 'asset' WHEN 1 THEN 'suspect' ELSE 'baseline' END AS role,
    CASE WHEN c_custkey % 7 = 0 THEN 'UNKNOWN' ELSE 'N' || c_nationkey END AS country,
    lower(c_mktsegment) AS purpose, 'LEO' AS orbit_class FROM customer WHERE c_custkey % 29 <> 0)"""


def watchlist(spark, sf):
    return C.load_watchlist(watchlist_docs(spark, sf))


@query("a19_load_watchlist", f"WITH {CAT_SQL} SELECT * FROM cat")
def a19(spark, sf):
    return watchlist(spark, sf)


def catalog_changes(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("norad_id"),
        F.when(F.col("s_suppkey") % 9 == 0, F.concat(F.lit("Starlink-"), F.col("s_suppkey").cast("string"))).otherwise(F.col("s_name")).alias("name"),
        F.when(F.col("s_suppkey") % 2 == 0, "asset").otherwise("suspect").alias("role"),
        F.lit("XX").alias("country"),
        F.when(F.col("s_suppkey") % 5 == 0, "commercial").otherwise("military").alias("purpose"),
        F.lit("GEO").alias("orbit_class"), F.col("s_suppkey").alias("seq"),
    )


@query(
    "a20_catalog_upsert",
    f"""WITH {CAT_SQL}, ch AS (SELECT s_suppkey AS norad_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'asset' ELSE 'suspect' END AS role,
       'XX' AS country, CASE WHEN s_suppkey % 5 = 0 THEN 'commercial' ELSE 'military' END AS purpose, 'GEO' AS orbit_class
       FROM supplier WHERE s_suppkey % 9 <> 0 AND NOT (s_suppkey % 5 = 0 AND s_suppkey % 2 = 0))
    SELECT * FROM (SELECT * FROM ch UNION ALL SELECT * FROM cat WHERE norad_id NOT IN (SELECT norad_id FROM ch))
    WHERE norad_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)""",
)
def a20(spark, sf):
    kept, _ = C.upsert(watchlist(spark, sf), catalog_changes(spark, sf))
    gone = table(spark, sf, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("norad_id"))
    return C.remove(kept, gone)


def event_docs(spark, sf):
    """Event-case JSON: one case per customer, dated in the data's month."""
    c = table(spark, sf, "customer")
    day = lambda d: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), d), "yyyy-MM-dd")
    k = F.col("c_custkey")
    ev = F.struct(
        F.concat(F.lit("case_"), k.cast("string")).alias("id"),
        F.array(k, k + 1).alias("norad_ids"),
        day((k % 3 + 12).cast("int")).alias("t_start"), day((k % 4 + 20).cast("int")).alias("t_peak"),
        day(F.lit(27)).alias("t_end"),
        F.when(k % 20 == 4, "placebo_quiet").otherwise("shadowing").alias("type"),
        F.when(k % 20 == 4, "control").otherwise(F.when(k % 6 == 2, "geo").otherwise("core")).alias("panel"),
        F.array(F.concat(F.lit("Report "), F.col("c_nationkey").cast("string")), F.lit("Open press")).alias("sources"),
        F.col("c_mktsegment").alias("notes"),
    )
    return c.groupBy(F.floor(k / 2560).alias("doc")).agg(F.collect_list(ev).alias("events")).select(
        F.to_json(F.struct("events")).alias("body")
    )


def event_cases(spark, sf):
    return C.load_events(event_docs(spark, sf))


CASES_SQL = """cases AS (SELECT 'case_' || c_custkey AS id, unnest([c_custkey, c_custkey + 1]) AS norad_id,
    DATE '2024-01-01' + (c_custkey % 3 + 12)::INT AS t_start, DATE '2024-01-01' + (c_custkey % 4 + 20)::INT AS t_peak,
    DATE '2024-01-28' AS t_end, CASE WHEN c_custkey % 20 = 4 THEN 'placebo_quiet' ELSE 'shadowing' END AS type,
    CASE WHEN c_custkey % 20 = 4 THEN 'control' WHEN c_custkey % 6 = 2 THEN 'geo' ELSE 'core' END AS panel,
    ['Report ' || c_nationkey, 'Open press'] AS sources FROM customer)"""


@query(
    "a21_load_events",
    f"""WITH {CASES_SQL} SELECT id, norad_id, strftime(t_start, '%Y-%m-%d') AS t_start, strftime(t_peak, '%Y-%m-%d') AS t_peak,
    type, panel FROM cases WHERE panel IN ('core', 'geo')""",
)
def a21(spark, sf):
    e = event_cases(spark, sf).where(F.col("panel").isin("core", "geo"))
    return e.select(
        "id", F.explode("norad_ids").alias("norad_id"), F.col("t_start").cast("string").alias("t_start"),
        F.col("t_peak").cast("string").alias("t_peak"), "type", "panel",
    )


@query(
    "a22_read_case_results",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
    SELECT 'ev_' || o_custkey AS event_id, o_orderkey::VARCHAR AS target, round(o_totalprice/2, 4) AS pre_peak_mean,
      o_totalprice > 200000 AS hit, round(o_totalprice/3, 4) AS late_mean FROM r WHERE r = 1""",
)
def a22(spark, sf):
    """Nested result files: first target per event, pre-peak struct hoisted, late feature mean."""
    path = scratch_path(spark, "wf-json")
    price = F.col("o_totalprice")
    m = F.struct(
        F.col("o_orderkey").alias("norad_id"), (price > 200000).alias("hit_at_event"),
        F.struct((price / 2).alias("pre_peak_anomaly_mean")).alias("pre_peak_noise"),
        F.struct((price / 3).alias("late_mean")).alias("feature_late"),
    )
    o = table(spark, sf, "orders").withColumn("slot", F.floor(F.col("o_orderkey") / 1024))
    # A result file line per (event, slot) keeps each nested map bounded.
    o.groupBy("o_custkey", "slot").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), m))).alias("metrics")
    ).select(F.concat(F.lit("ev_"), F.col("o_custkey").cast("string")).alias("event_id"), "metrics").write.json(path)
    schema = (
        "event_id string, metrics map<string,struct<norad_id:bigint,hit_at_event:boolean,"
        "pre_peak_noise:struct<pre_peak_anomaly_mean:double>,feature_late:struct<late_mean:double>>>"
    )
    flat = spark.read.schema(schema).json(path).select("event_id", F.explode("metrics").alias("target", "m"))
    first = keep_last(flat, ["event_id"], [F.asc("m.norad_id")])
    return first.select(
        "event_id", "target", F.round("m.pre_peak_noise.pre_peak_anomaly_mean", 4).alias("pre_peak_mean"),
        F.col("m.hit_at_event").alias("hit"), F.round("m.feature_late.late_mean", 4).alias("late_mean"),
    )


@query(
    "a23_report_sinks",
    """SELECT o_custkey AS norad_id, round(max(o_totalprice), 2) AS score, count(*) AS n FROM orders GROUP BY 1""",
)
def a23(spark, sf):
    """Board written as JSON by day plus a flat CSV; the CSV is read back."""
    path = scratch_path(spark, "board")
    b = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("norad_id")).agg(
        F.struct(F.round(F.max("o_totalprice"), 2).alias("score"), F.count("*").alias("n")).alias("pair")
    ).withColumn("day", F.lit("2024-01-31"))
    b.write.partitionBy("day").json(f"{path}/json")
    j = spark.read.schema("norad_id bigint, pair struct<score:double,n:bigint>, day string").json(f"{path}/json")
    j.select("norad_id", "pair.*").write.option("header", True).csv(f"{path}/csv")
    return spark.read.schema("norad_id bigint, score double, n bigint").option("header", True).csv(f"{path}/csv")


@query(
    "a24_object_csv_corpus",
    """WITH e AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT user_id::VARCHAR AS object_id, count(*) AS n, round(avg(7000 + value/50), 6) AS mean_sma_km,
      count(*) FILTER (WHERE i % 9 = 4 AND i % 2 = 0) AS n_labels FROM e GROUP BY 1""",
)
def a24(spark, sf):
    """One folder per object, metres to kilometres, file name gives the id; labels grouped by object."""
    from driftline.operators.windows import numbered

    path = scratch_path(spark, "corpus")
    e = numbered(events(spark, sf), "user_id", "ts", ["event_id"]).withColumn("i", F.col("pos") - 1)
    # A folder costs more than its rows: tasks are dealt by objects (a huge one by runs of its rows), and move their own files.
    objects = e.select("user_id").distinct().count()
    e.select("user_id", "i", ((F.lit(7000.0) + F.col("value") / 50) * 1000).alias("Semimajor Axis (m)")).repartition(
        -(-objects // 128) or 1, "user_id", F.floor(F.col("i") / 100_000)
    ).write.partitionBy("user_id").option("header", True).option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(f"{path}/ephemeris")
    e.where("i % 9 = 4").select(
        F.col("user_id").alias("ObjectID"), F.col("i").alias("TimeIndex"),
        F.when(F.col("i") % 2 == 0, "ID").otherwise("ES").alias("Node"),
    ).write.option("header", True).csv(f"{path}/labels")
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).schema(
        "i bigint, sma_m double"
    ).csv(f"{path}/ephemeris")
    eph = raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"user_id=([^/]+)/", 1).alias("object_id"), (F.col("sma_m") / 1000).alias("sma_km")
    ).groupBy("object_id").agg(F.count("*").alias("n"), F.round(F.avg("sma_km"), 6).alias("mean_sma_km"))
    lab = spark.read.option("header", True).schema("ObjectID string, TimeIndex int, Node string").csv(f"{path}/labels").where(
        "Node <> 'ES'"
    ).groupBy(F.col("ObjectID").alias("object_id")).agg(F.count("*").alias("n_labels"))
    return eph.join(lab, "object_id", "left").fillna(0, ["n_labels"])


def marked_documents(spark, sf):
    """Documents with lines starting in A-E turned into headings, dealt by ``path``: a file of few row groups is few tasks."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "text").repartition("path")
    return d.select("path", F.regexp_replace("text", r"(?m)^([A-E])", "# $1").alias("text"))


CHUNK_SQL = """doc AS (SELECT doc_id::VARCHAR AS path, unnest(regexp_split_to_array('# ' || doc_id || chr(10) ||
       regexp_replace(text, '(?m)^([A-E])', '# \\1', 'g'), '(?m)^[ \\t]*#{1,4}[ \\t]+')) AS s,
       unnest(range(0, len(regexp_split_to_array('# ' || doc_id || chr(10) || regexp_replace(text, '(?m)^([A-E])', '# \\1', 'g'),
         '(?m)^[ \\t]*#{1,4}[ \\t]+')))) AS chunk_no FROM documents),
    ch AS (SELECT path, chunk_no, trim(split_part(s, chr(10), 1)) AS heading,
       regexp_replace(regexp_replace(regexp_replace(s, '^[^\\n]*\\n?', ''), '^\\s+', ''), '\\s+$', '') AS body FROM doc WHERE chunk_no > 0)"""


@query(
    "a25_markdown_chunks",
    f"""WITH {CHUNK_SQL} SELECT path, chunk_no, part, md5(heading) AS heading, md5(body[part*1800 + 1 : part*1800 + 1800]) AS text
    FROM (SELECT *, unnest(range(0, (length(body) - 1) // 1800 + 1)) AS part FROM ch WHERE length(body) >= 40)""",
)
def a25(spark, sf):
    c = X.markdown_chunks(marked_documents(spark, sf), "path", "text")
    return c.select("path", "chunk_no", "part", F.md5("heading").alias("heading"), F.md5("text").alias("text"))


@query(
    "a26_contract_check",
    """WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_custkey END AS norad_id,
      o_totalprice/500000 AS score, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'suspect' ELSE 'asset' END AS role FROM orders)
    SELECT o_orderkey, concat_ws(';', CASE WHEN norad_id IS NULL THEN 'missing norad_id' END,
      CASE WHEN score < 0 OR score > 1 THEN 'score out of range' END,
      CASE WHEN role NOT IN ('asset','suspect','baseline','unknown') THEN 'invalid role' END) AS violations FROM b
    WHERE norad_id IS NULL OR score > 1 OR score < 0 OR role = 'pending'""",
)
def a26(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 31 != 0, F.col("o_custkey")).alias("norad_id"),
        (F.col("o_totalprice") / 500000).alias("score"),
        F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "suspect").otherwise("asset").alias("role"),
    )
    rules = {
        "missing norad_id": F.col("norad_id").isNull(),
        "score out of range": ~F.col("score").between(0, 1),
        "invalid role": ~F.col("role").isin(*C.ROLES, "unknown"),
    }
    return check_contract(o, rules).where(F.size("violations") > 0).select(
        "o_orderkey", F.concat_ws(";", "violations").alias("violations")
    )


def check_contract(df, rules):
    """List of broken rules per row."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()])))


@query(
    "a26_declared_contracts",
    f"""WITH {STATUS_SQL}, rw AS (SELECT norad_id, CASE WHEN norad_id % 7 = 0 THEN 'pending' ELSE role END AS role, score + CASE WHEN norad_id % 11 = 0 THEN 1 ELSE 0 END AS anomaly_score,
       CASE WHEN norad_id % 13 <> 0 THEN attention END AS attention_score, CASE WHEN norad_id % 17 = 0 THEN 'HIGH' ELSE risk_level END AS risk_level, orbit_class, status, name,
       CASE WHEN norad_id % 19 = 0 THEN 'DEEP' ELSE orbit_class END AS orbit, CASE WHEN norad_id % 23 = 0 THEN 'HOT' ELSE status END AS state FROM sb),
    v AS (SELECT 'risk_row' AS contract, norad_id, concat_ws(';', CASE WHEN role NOT IN ('asset','suspect','baseline','unknown') THEN 'invalid role ' || role END, CASE WHEN anomaly_score < 0 THEN 'anomaly_score below 0' END,
        CASE WHEN anomaly_score > 1 THEN 'anomaly_score above 1' END, CASE WHEN attention_score IS NULL THEN 'missing attention_score' END, CASE WHEN attention_score < 0 THEN 'attention_score below 0' END, CASE WHEN attention_score > 1 THEN 'attention_score above 1' END,
        CASE WHEN risk_level NOT IN ('LOW','WATCH','ELEVATED','CRITICAL') THEN 'invalid risk_level ' || risk_level END) AS violations FROM rw
      UNION ALL SELECT 'satellite', norad_id, concat_ws(';', CASE WHEN role = 'pending' THEN 'invalid role pending' END, CASE WHEN orbit = 'DEEP' THEN 'invalid orbit_class DEEP' END, CASE WHEN state = 'HOT' THEN 'invalid status HOT' END) FROM rw
      UNION ALL SELECT 'investigation', norad_id, concat_ws(';', CASE WHEN norad_id % 29 = 0 THEN 'malformed id' END, CASE WHEN norad_id % 31 = 0 THEN 'invalid kind planet' END, CASE WHEN anomaly_score < 0 THEN 'score below 0' END, CASE WHEN anomaly_score > 1 THEN 'score above 1' END) FROM rw)
    SELECT contract, norad_id, violations FROM v WHERE violations <> ''""",
)
def a26_declared(spark, sf):
    """Every broken row of the board under the three declared contracts; some rows are broken by fixed formulas."""
    from driftline.plans.inputs import status_board
    from driftline.sources import contracts as CT

    k = F.col("norad_id")
    b = status_board(spark, sf).withColumn("role", F.when(k % 7 == 0, "pending").otherwise(F.col("role"))).withColumn("anomaly_score", F.col("score") + F.when(k % 11 == 0, 1).otherwise(0))
    b = b.withColumn("attention_score", F.when(k % 13 != 0, F.col("attention"))).withColumn("risk_level", F.when(k % 17 == 0, "HIGH").otherwise(F.col("risk_level")))
    satellite = b.withColumn("orbit_class", F.when(k % 19 == 0, "DEEP").otherwise(F.col("orbit_class"))).withColumn("status", F.when(k % 23 == 0, "HOT").otherwise(F.col("status")))
    thing = b.select(
        "norad_id", F.concat(F.when(k % 29 == 0, "SAT ").otherwise("sat:"), k.cast("string")).alias("id"), F.when(k % 31 == 0, "planet").otherwise("satellite").alias("kind"), F.lit("Entity").alias("category"),
        F.col("name").alias("label"), F.col("anomaly_score").alias("score"),
    )
    parts = (("risk_row", b, CT.RISK_ROW), ("satellite", satellite, CT.SATELLITE), ("investigation", thing, CT.INVESTIGATION_OBJECT))
    found = [CT.quarantine(df, c)[1].select(F.lit(n).alias("contract"), "norad_id", F.concat_ws(";", "violations").alias("violations")) for n, df, c in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("a27_feature_sink")
def a27(spark, sf):
    """Feature matrix written with id, window end and role, read back by role."""
    from driftline.plans.features import full_features
    from driftline.plans.inputs import role

    path = scratch_path(spark, "train-windows")
    f = full_features(spark, sf, step=10).withColumn("role", role(F.col("norad_id")))
    f.write.partitionBy("role").parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy("role").agg(F.count("*").alias("n_windows"), F.countDistinct("norad_id").alias("n_entities"))
