"""Declared contracts of the outputs, and their check in one pass."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Field(NamedTuple):
    """What one column must keep: presence, allowed values, range and pattern. Nulls break ``required`` only."""

    name: str
    required: bool = False
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    pattern: str | None = None


# Roles, classes, states and kinds of the published formats.
ROLES = ("asset", "suspect", "baseline", "unknown")
ORBITS = ("LEO", "MEO", "GEO", "HEO")
STATUSES = (
    "NOMINAL", "ANOMALY", "PAIR_ELEVATED", "CHANGE_RELEVANT", "ASSET_REGIME_NOISE", "CALIBRATION_BASELINE", "UNRELIABLE_DATA",
)
RISK_LEVELS = ("LOW", "WATCH", "ELEVATED", "CRITICAL")
OBJECT_KINDS = ("satellite", "alert", "case", "weather", "evidence", "document", "peer")
CATEGORIES = ("Entity", "Event", "Document")

#: A row of the risk report's board.
RISK_ROW = (
    Field("norad_id", required=True),
    Field("role", values=ROLES),
    Field("anomaly_score", required=True, low=0, high=1),
    Field("attention_score", required=True, low=0, high=1),
    Field("kelly_allocation", low=0, high=1),
    Field("risk_level", values=RISK_LEVELS),
)
#: An object of the investigation graph.
INVESTIGATION_OBJECT = (
    Field("id", required=True, pattern="^[a-z]+:.+"),
    Field("kind", required=True, values=OBJECT_KINDS),
    Field("category", required=True, values=CATEGORIES),
    Field("score", low=0, high=1),
)
#: Properties of a satellite object.
SATELLITE = (
    Field("norad_id", required=True),
    Field("role", values=ROLES),
    Field("orbit_class", values=ORBITS),
    Field("status", values=STATUSES),
)


def broken(field: Field) -> list[Column]:
    """One message per kept rule, null where the rule holds."""
    c, out = F.col(field.name), []
    if field.required:
        out.append(F.when(c.isNull(), F.lit(f"missing {field.name}")))
    if field.values:
        out.append(F.when(c.isNotNull() & ~c.isin(*field.values), F.concat(F.lit(f"invalid {field.name} "), c)))
    if field.low is not None:
        out.append(F.when(c < field.low, F.lit(f"{field.name} below {field.low:g}")))
    if field.high is not None:
        out.append(F.when((c > field.high) | F.isnan(c), F.lit(f"{field.name} above {field.high:g}")))
    if field.pattern is not None:
        out.append(F.when(c.isNotNull() & ~c.rlike(field.pattern), F.lit(f"malformed {field.name}")))
    return out


def check(df: DataFrame, contract: tuple[Field, ...]) -> DataFrame:
    """Adds ``violations``, in the order of the contract; a required column that is absent is broken in every row."""
    have = set(df.columns)
    absent = [F.lit(f"missing {f.name}") for f in contract if f.required and f.name not in have]
    rules = [m for f in contract if f.name in have for m in broken(f)]
    return df.withColumn("violations", F.array_compact(F.array(*absent, *rules)) if absent or rules else F.array().cast("array<string>"))


def quarantine(df: DataFrame, contract: tuple[Field, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the contract, broken rows with their violations)."""
    checked = check(df, contract)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)
