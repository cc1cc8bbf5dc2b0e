"""Reading, normalising, upserting and writing the canonical observation table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.scalars import sma_from_mean_motion
from driftline.operators.skew import keep_last

SCHEMA = T.StructType(
    [
        T.StructField("norad_id", T.LongType(), False),
        T.StructField("object_name", T.StringType()),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("semi_major_axis_km", T.DoubleType()),
        T.StructField("eccentricity", T.DoubleType()),
        T.StructField("inclination_deg", T.DoubleType()),
        T.StructField("raan_deg", T.DoubleType()),
        T.StructField("mean_motion_rev_per_day", T.DoubleType(), False),
        T.StructField("bstar", T.DoubleType()),
        T.StructField("tle_age_hours", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)

# Accepted spellings per canonical column, matched without case.
ALIASES = {
    "norad_id": ("norad_id", "NORAD_CAT_ID", "norad", "satid"),
    "object_name": ("object_name", "name", "OBJECT_ID", "satname"),
    "timestamp": ("timestamp", "epoch", "EPOCH_UTC"),
    "mean_motion_rev_per_day": ("mean_motion_rev_per_day", "MEAN_MOTION", "n"),
    "inclination_deg": ("inclination_deg", "INCLINATION", "incl"),
    "eccentricity": ("eccentricity", "eccen"),
    "raan_deg": ("raan_deg", "RA_OF_ASC_NODE", "RAAN", "right_ascension"),
    "bstar": ("bstar", "b_star"),
    "semi_major_axis_km": ("semi_major_axis_km", "semi_major_axis", "sma_km"),
}


def resolve(columns: Iterable[str], names: Sequence[str]) -> str | None:
    lower = {c.lower(): c for c in columns}
    return next((lower[n.lower()] for n in names if n.lower() in lower), None)


def normalize_epochs(df: DataFrame, source: str, order: Column | None = None) -> DataFrame:
    """Map any accepted spelling to the canonical table; last row wins per (id, time).

    ``order`` says which copy is last. Unparsable ids, times and rates are dropped; a row's own
    ``source`` is kept when present.
    """
    col = {k: resolve(df.columns, v) for k, v in ALIASES.items()}
    for need in ("norad_id", "timestamp", "mean_motion_rev_per_day"):
        if col[need] is None:
            raise ValueError(f"no column for {need} in {df.columns}")
    num = lambda k: F.col(col[k]).try_cast("double") if col[k] else F.lit(0.0)
    mm = num("mean_motion_rev_per_day")
    own = resolve(df.columns, ["source"])
    out = df.select(
        F.col(col["norad_id"]).try_cast("bigint").alias("norad_id"),
        (F.col(col["object_name"]).cast("string") if col["object_name"] else F.lit("UNKNOWN")).alias("object_name"),
        F.col(col["timestamp"]).try_cast("timestamp").alias("timestamp"),
        (num("semi_major_axis_km") if col["semi_major_axis_km"] else sma_from_mean_motion(mm)).alias("semi_major_axis_km"),
        num("eccentricity").alias("eccentricity"),
        num("inclination_deg").alias("inclination_deg"),
        num("raan_deg").alias("raan_deg"),
        mm.alias("mean_motion_rev_per_day"),
        num("bstar").alias("bstar"),
        F.lit(0.0).alias("tle_age_hours"),
        (F.coalesce(F.col(own), F.lit(source)) if own else F.lit(source)).alias("source"),
        (order if order is not None else F.lit(0)).alias("__o"),
    ).dropna(subset=["norad_id", "timestamp", "mean_motion_rev_per_day"])
    return keep_last(out, ["norad_id", "timestamp"], [F.desc("__o"), F.desc("mean_motion_rev_per_day")]).drop("__o")


def load_history(spark: SparkSession, parquet: str, csv: str | None = None, schema: T.StructType = SCHEMA) -> DataFrame:
    """Parquet if there, else CSV, else an empty table with the schema."""
    for fmt, path in (("parquet", parquet), ("csv", csv)):
        if not path:
            continue
        try:
            reader = spark.read.schema(schema)
            return reader.parquet(path) if fmt == "parquet" else reader.option("header", True).csv(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], schema)


def save_history(df: DataFrame, path: str, ts: str = "timestamp", csv: str | None = None) -> None:
    """Parquet partitioned by year (only touched years are replaced), optional CSV mirror."""
    out = df.withColumn("year", F.year(ts))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    if csv:
        df.write.mode("overwrite").option("header", True).csv(csv)


def append_epochs(history: DataFrame, fresh: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Upsert: fresh rows win per key. ``is_new`` marks keys the history did not have."""
    both = history.withColumn("__f", F.lit(0)).unionByName(fresh.withColumn("__f", F.lit(1)))
    # Per key one row survives; whether history had the key rides along as a partial aggregate.
    cols = [c for c in history.columns if c not in keys]
    agg = both.groupBy(*keys).agg(
        F.max(F.struct("__f", *order, *[c for c in cols if c not in order])).alias("r"),
        F.min("__f").alias("__seen"),
    )
    return agg.select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols], (F.col("__seen") == 1).alias("is_new"))


def filtered_scan(df: DataFrame, ids: DataFrame | Sequence[int], id_col: str) -> DataFrame:
    """Rows of the wanted ids: a pushed-down list when short, else a semi-join Spark sizes itself."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(id_col), id_col, "left_semi")
    return df.where(F.col(id_col).isin(*ids))


def unseeded(df: DataFrame, history: DataFrame, ts: str, min_rows: int) -> DataFrame:
    """Rows of years the history does not hold yet (a year counts from ``min_rows`` rows on)."""
    done = history.groupBy(F.year(ts).alias("year")).agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    return df.withColumn("year", F.year(ts)).join(done.select("year"), "year", "left_anti")


def merge_daily(preferred: DataFrame, groups: DataFrame, wanted: DataFrame, names: DataFrame, key: str, ts: str) -> DataFrame:
    """Preferred rows, missing ids filled from group dumps, one row per (id, time), catalog names."""
    fill = groups.join(preferred.select(key).distinct(), key, "left_anti")
    both = preferred.unionByName(fill).join(wanted.select(key).distinct(), key, "left_semi")
    one = keep_last(both, [key, ts], [F.desc("seq")])
    return one.join(names, key, "left").withColumn("object_name", F.coalesce("catalog_name", "object_name")).drop("catalog_name")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Repeatable random sample of ``n`` rows, in hash order of the key."""
    return df.orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col(key))), key).limit(n)
