"""Watchlist and event-case catalogs: load, validate, upsert, look up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.skew import keep_last

# The roles a catalog entry may have.
ROLES = ("asset", "suspect", "baseline")

OBJECT_DDL = (
    "array<struct<norad_id:string,name:string,role:string,country:string,purpose:string,"
    "orbit_class:string,notes:string>>"
)
EVENT_DDL = (
    "array<struct<id:string,norad_ids:array<bigint>,pair_with:array<bigint>,t_start:date,"
    "t_peak:date,t_end:date,type:string,panel:string,sources:array<string>,notes:string>>"
)


def normalize_objects(df: DataFrame) -> DataFrame:
    """Defaults for missing fields, unknown role to baseline, rows without an id dropped."""
    nid = F.col("norad_id").try_cast("bigint")
    r = F.lower(F.trim(F.coalesce("role", F.lit("baseline"))))
    return df.select(
        nid.alias("norad_id"),
        F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("NORAD-"), nid.cast("string"))).alias("name"),
        F.when(r.isin(*ROLES), r).otherwise("baseline").alias("role"),
        F.coalesce("country", F.lit("UNKNOWN")).alias("country"),
        F.coalesce("purpose", F.lit("unknown")).alias("purpose"),
        F.coalesce("orbit_class", F.lit("LEO")).alias("orbit_class"),
    ).where("norad_id IS NOT NULL")


def load_watchlist(docs: DataFrame, body: str = "body") -> DataFrame:
    items = docs.select(F.inline(F.from_json(F.get_json_object(body, "$.objects"), OBJECT_DDL)))
    return normalize_objects(items)


def load_events(docs: DataFrame, body: str = "body") -> DataFrame:
    return docs.select(F.inline(F.from_json(F.get_json_object(body, "$.events"), EVENT_DDL)))


def violation() -> Column:
    """Why an entry may not be stored, null when it may."""
    return F.when(F.upper("name").contains("STARLINK"), "commercial constellation name").when(
        (F.lower("purpose") == "commercial") & F.col("role").isin("baseline", "asset"),
        "commercial anchor",
    )


def upsert(catalog: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new catalog, rejected changes). ``changes`` carries ``seq``; the last valid one wins."""
    checked = changes.withColumn("violation", violation())
    good = checked.where("violation IS NULL").drop("violation")
    both = catalog.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(good)
    return keep_last(both, ["norad_id"], [F.desc("seq")]).drop("seq"), checked.where("violation IS NOT NULL")


def remove(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    return catalog.join(ids.select("norad_id"), "norad_id", "left_anti")


def with_meta(df: DataFrame, catalog: DataFrame, key: str = "norad_id") -> DataFrame:
    """Catalog columns with defaults for unknown ids."""
    j = df.join(catalog.withColumnRenamed("norad_id", key), key, "left")
    return (
        j.withColumn("name", F.coalesce("name", F.col(key).cast("string")))
        .withColumn("role", F.coalesce("role", F.lit("unknown")))
        .withColumn("country", F.coalesce("country", F.lit("UNKNOWN")))
        .withColumn("purpose", F.coalesce("purpose", F.lit("unknown")))
        .withColumn("orbit_class", F.coalesce("orbit_class", F.lit("LEO")))
    )


def training_ids(catalog: DataFrame, available: DataFrame) -> DataFrame:
    """Normality anchors: baseline and asset roles, no commercial constellation, data present."""
    ok = (
        F.col("role").isin("baseline", "asset")
        & (F.lower("purpose") != "commercial")
        & ~F.upper("name").contains("STARLINK")
    )
    return catalog.where(ok).select("norad_id").join(available.select("norad_id").distinct(), "norad_id", "left_semi")
