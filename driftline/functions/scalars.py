"""Row-level rules and formulas as Spark expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.series import clip

# Physical constants.
MU_EARTH_KM3_S2 = 398600.4418
R_EARTH_KM = 6371.0

# Severity weight per purpose (default 25).
PURPOSE_SEVERITY = {
    "military": 100.0,
    "sigint": 95.0,
    "reconnaissance": 90.0,
    "asat_test": 100.0,
    "debris removal": 40.0,
    "scientific": 15.0,
    "navigation": 20.0,
    "telecom": 10.0,
    "commercial": 10.0,
    "earth obs": 15.0,
    "unknown": 25.0,
}

# English stop words left out of keyword retrieval.
STOP_WORDS = [
    "the", "a", "an", "of", "to", "and", "or", "for", "in", "on", "at", "is", "are", "was", "be", "this",
    "that", "with", "from", "by", "as", "it", "not", "no", "we", "you", "our", "their", "if", "then", "than",
    "into", "over", "under", "its",
]

# Name prefixes of the weather group.
WEATHER_PREFIXES = [
    "NOAA", "GOES", "METEOSAT", "METOP", "FENGYUN", "FY-", "HIMAWARI", "ELECTRO-L", "DMSP", "GOMS",
    "INSAT", "KALPANA", "GEO-KOMPSAT", "ARSAT",
]


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


# --- orbital geometry -------------------------------------------------------------------


def sma_from_mean_motion(n: Column) -> Column:
    """Semi-major axis (km) from revolutions per day; null unless positive."""
    rate = n * (2.0 * math.pi / 86400.0)
    return F.when(n > 0, F.pow(F.lit(MU_EARTH_KM3_S2) / (rate * rate), F.lit(1.0 / 3.0)))


def mean_motion_from_sma(a: Column) -> Column:
    return F.lit(86400.0 / (2.0 * math.pi)) * F.sqrt(F.lit(MU_EARTH_KM3_S2) / (a * a * a))


def position(a: Column, inc_deg: Column, raan_deg: Column, phase_rad: Column, ecc: Column | None = None) -> Column:
    """Inertial position struct (km) at an in-plane angle."""
    r = a if ecc is None else F.when(ecc < 1e-8, a).otherwise(
        a * (F.lit(1.0) - ecc * ecc) / (F.lit(1.0) + ecc * F.cos(phase_rad))
    )
    xo, yo = r * F.cos(phase_rad), r * F.sin(phase_rad)
    i, o = F.radians(inc_deg), F.radians(raan_deg)
    return F.struct(
        (F.cos(o) * xo - F.sin(o) * F.cos(i) * yo).alias("x"),
        (F.sin(o) * xo + F.cos(o) * F.cos(i) * yo).alias("y"),
        (F.sin(i) * yo).alias("z"),
    )


def distance(p: Column, q: Column) -> Column:
    return F.sqrt(
        (p["x"] - q["x"]) * (p["x"] - q["x"])
        + (p["y"] - q["y"]) * (p["y"] - q["y"])
        + (p["z"] - q["z"]) * (p["z"] - q["z"])
    )


def orbit_class_by_altitude(a: Column) -> Column:
    alt = a - R_EARTH_KM
    return F.when(alt < 2000, "LEO").when(alt < 35000, "MEO").otherwise("GEO")


def orbit_class_by_axis(a: Column) -> Column:
    return F.when(a < 8000, "LEO").when(a > 35000, "GEO").otherwise("MEO")


def age_hours(ts: Column, reference: Column, fallback: float = 12.0) -> Column:
    """Hours from ``ts`` to ``reference``, not below zero; fallback where ``ts`` is missing."""
    micros = F.unix_micros(reference.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    # ``greatest`` skips nulls, so a missing time is handled first.
    return F.when(micros.isNull(), fallback).otherwise(F.greatest(F.lit(0.0), micros / 3.6e9))


# --- policy -----------------------------------------------------------------------------


def policy_score(country: Column, purpose: Column, orbit: Column, inc: Column) -> Column:
    s = (
        F.when(country.isin("CN", "RU", "KP", "IR"), 0.35)
        .when(~country.isin("US", "UK", "FR", "CA", "DE"), 0.1)
        .otherwise(0.0)
        + F.when(purpose.isin("military", "sigint", "asat_test", "reconnaissance"), 0.45)
        .when(purpose.isin("commercial", "scientific"), 0.05)
        .otherwise(0.0)
        + F.when((orbit == "LEO") & (inc > 55), 0.2).otherwise(0.0)
    )
    return clip(s, 0, 1)


def severity(purpose: Column) -> Column:
    pairs = [F.lit(x) for kv in PURPOSE_SEVERITY.items() for x in kv]
    key = F.lower(F.coalesce(purpose, F.lit("unknown")))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(25.0))


def half_kelly(p: Column, b: Column) -> Column:
    return F.when(b > 0, F.greatest(F.lit(0.0), (p * b - (F.lit(1.0) - p)) / b * 0.5)).otherwise(0.0)


def pair_risk(dist: Column, coint_p: Column, dcca: Column, dfa: Column) -> Column:
    """Struct of proximity, cointegration and coherence parts, total risk and level."""
    prox = F.exp(-dist / 400.0)
    base = clip(F.lit(1.0) - coint_p, 0, 1)
    coint = F.when(coint_p < 0.05, clip(base + 0.25, 0, 1)).otherwise(base)
    coherence = F.when((coint_p < 0.05) & (dfa > 0.65), 1.0).otherwise(0.0)
    raw = clip(
        prox * 0.5 + coint * 0.3 + F.greatest(dcca, F.lit(0.0)) * 0.1 + coherence * 0.1, 0, 1
    )
    raw = F.when((dist < 150) & (coint_p < 0.1), clip(raw + 0.15, 0, 1)).otherwise(raw)
    raw = F.when((dist < 50) & (coint_p < 0.05), clip(raw + 0.1, 0, 1)).otherwise(raw)
    level = (
        F.when((raw >= 0.75) & (dist < 100) & (coint_p < 0.10), "CRITICAL")
        .when((raw >= 0.55) | ((dist < 120) & (coint_p < 0.15)), "ELEVATED")
        .when((raw >= 0.35) | (dist < 250), "WATCH")
        .otherwise("LOW")
    )
    return F.struct(
        prox.alias("proximity_score"),
        coint.alias("coint_score"),
        coherence.alias("coherence"),
        raw.alias("pair_risk"),
        level.alias("risk_level"),
    )


def miss_sigma(hours: Column, sigma0: float = 0.5, rate: float = 0.35) -> Column:
    return F.lit(sigma0) + F.sqrt(F.greatest(F.lit(0.0), hours)) * rate


def collision_probability(miss: Column, sigma: Column, hbr: float = 0.02) -> Column:
    pc = F.lit(hbr * hbr / 2.0) / (sigma * sigma) * F.exp(miss * miss / (sigma * sigma) * -0.5)
    return F.when(sigma <= 1e-9, 0.0).otherwise(clip(pc, 0, 1))


def weak_label(f: dict[str, Column]) -> Column:
    """Ordered decision list: 0 normal, 1 anomalous, 2 suspect, 3 hostile."""
    dist, delta, dfa = f["dist"], F.abs(f["delta"]), f["dfa"]
    lz, cusum, coint = f["lz"], f["cusum"], f["coint"]
    changes, shannon, score = f["changes"], f["shannon"], f["score"]
    drag = (f["storm"] >= 0.5) | (f["ap"] >= 30.0) | (f["f107"] >= 180.0)
    lim = lambda stormy, calm: F.when(drag, stormy).otherwise(calm)
    # The cut-points of the rules, in their order.
    close_active = (dist < 25.0) & (
        (delta > lim(3.0, 2.0)) | (dfa > 0.6) | (coint < 0.05) | (score > 0.55)
    )
    excused = drag & (delta <= 2.5) & (coint >= 0.05) & (dist >= 15.0)
    return (
        F.when(close_active & ~excused, 3)
        .when((delta > lim(5.0, 4.0)) & (dist < 80.0), 3)
        .when((coint < 0.05) & (dist < 40.0) & (dfa > 0.55), 3)
        .when((dist < 150.0) & ((delta > 1.0) | (dfa > 0.7) | (coint < 0.08)), 2)
        .when((delta > lim(2.5, 2.0)) & (dist < 200.0), 2)
        .when((dfa > 0.65) & (lz > 0.9) & (dist < 250.0), 2)
        .when((changes >= 2) & (dist < 120.0), 2)
        .when((coint < 0.05) & (dist < 80.0), 2)
        .when((dfa > 0.7) & (shannon > 1.5) & (delta > 1.0), 2)
        .when(drag & (delta < 1.2) & (dist > 150.0) & (cusum < 0.9), 0)
        .when((cusum >= 0.7) & (delta > 0.8), 1)
        .when(delta > lim(2.0, 1.5), 1)
        .when((changes >= 2) & (delta > 0.5), 1)
        .when((score > 0.55) & (dist > 200.0), 1)
        .otherwise(0)
    )


def status(role: Column, reliable: Column, outlier: Column, change: Column, pair_hot: Column) -> Column:
    """Status and flags from role, data reliability, outlier, change and pair state."""
    r = F.lower(F.coalesce(role, F.lit("unknown")))
    noise = outlier | change
    word = (
        F.when(~reliable, "UNRELIABLE_DATA")
        .when(r == "baseline", "CALIBRATION_BASELINE")
        .when(
            r == "suspect",
            F.when(pair_hot & ~outlier, "PAIR_ELEVATED")
            .when(outlier, "ANOMALY")
            .when(change, "CHANGE_RELEVANT")
            .otherwise("NOMINAL"),
        )
        .when(r == "asset", F.when(noise, "ASSET_REGIME_NOISE").otherwise("NOMINAL"))
        .when(noise, "ANOMALY")
        .otherwise("NOMINAL")
    )
    detection = reliable & (r == "suspect") & (noise | pair_hot)
    health = reliable & (r == "asset") & noise
    other = reliable & ~r.isin("suspect", "asset", "baseline") & noise
    return F.struct(
        word.alias("status"),
        detection.alias("is_detection"),
        health.alias("is_health_flag"),
        (detection | health | other).alias("is_anomaly"),
        r.isin("suspect", "asset").alias("alert_eligible"),
        (r == "baseline").alias("is_calibration"),
    )


def threat_tier(b: dict[str, Column], variant: str = "board") -> Column:
    """Threat tier. ``board`` clears calibration rows first and counts more statuses."""
    st, att, risk = b["status"], b["attention"], F.coalesce(b["pair_risk"], F.lit(0.0))
    level = F.upper(F.coalesce(b["risk_level"], F.lit("")))
    hostile = (st == "PAIR_ELEVATED") & ((level == "CRITICAL") | (att >= 0.65) | (risk >= 0.9))
    suspect = (st == "PAIR_ELEVATED") | (risk >= 0.55)
    anomaly = b["is_anomaly"] | st.isin("ANOMALY", "UNRELIABLE_DATA")
    if variant == "report":
        return (
            F.when(hostile, "HOSTILE").when(suspect, "SUSPECT").when(anomaly, "ANOMALY").otherwise("NOMINAL")
        )
    return (
        F.when((st == "CALIBRATION_BASELINE") | b["is_calibration"], "NOMINAL")
        .when(hostile, "HOSTILE")
        .when(suspect | b["is_detection"], "SUSPECT")
        .when(anomaly | st.isin("ASSET_REGIME_NOISE", "CHANGE_RELEVANT") | b["is_health_flag"], "ANOMALY")
        .otherwise("NOMINAL")
    )


def threat_rank(tier: Column) -> Column:
    return F.when(tier == "HOSTILE", 0).when(tier == "SUSPECT", 1).when(tier == "ANOMALY", 2).otherwise(3)


# --- bands and classifiers --------------------------------------------------------------


def score_band(s: Column) -> Column:
    return (
        F.when(s < 0.15, "very low").when(s < 0.35, "low").when(s < 0.55, "moderate")
        .when(s < 0.75, "high").when(s.isNotNull(), "very high")
    )


def solar_band(f107: Column, storm: Column) -> Column:
    return (
        F.when(storm | (f107 >= 180), "very active").when(f107 >= 120, "active")
        .when(f107 >= 80, "fairly quiet").otherwise("quiet")
    )


def activity_note(f107: Column, ap: Column) -> Column:
    return (
        F.when((ap >= 50) | (f107 >= 200), "high")
        .when((ap >= 20) | (f107 >= 150), "moderate")
        .otherwise("quiet")
    )


def persistence_flag(dfa: Column) -> Column:
    return F.when(dfa >= 0.7, "persistent").when(dfa <= 0.4, "mean_reverting").otherwise("none")


def name_group(name: Column) -> Column:
    n = F.upper(F.trim(name))
    has = lambda *w: any_of([n.contains(x) for x in w])
    starts = lambda *w: any_of([n.startswith(x) for x in w])
    return (
        F.when(has("ISS", "ZARYA", "TIANGONG", "TIANHE", "WENTIAN", "MENGTIAN") | starts("CSS"), "stations")
        .when(starts("GPS ", "NAVSTAR"), "gps")
        .when(has("GLONASS"), "glonass")
        .when(has("GALILEO") | starts("GSAT"), "galileo")
        .when(starts("STARLINK"), "starlink")
        .when(starts("ONEWEB"), "oneweb")
        .when(starts(*WEATHER_PREFIXES), "weather")
        .otherwise("other")
    )


def country_from_name(name: Column) -> Column:
    n = F.upper(name)
    has = lambda *w: any_of([n.contains(x) for x in w])
    return (
        F.when(has("USA", "STARLINK", "ISS", "NAVSTAR"), "US")
        .when(has("YAOGAN", "BEIDOU"), "CN")
        .when(has("COSMOS"), "RU")
        .otherwise("UNKNOWN")
    )


def purpose_from_name(name: Column, country: Column) -> Column:
    return F.when(country.isin("CN", "RU") | F.upper(name).contains("USA"), "military").otherwise("scientific")


def unit_axis(value: Column, cap: float) -> Column:
    clean = F.when(value.isNotNull() & ~F.isnan(value), value / cap)
    return F.coalesce(clip(clean, 0, 1), F.lit(0.0))


def finite_or_zero(c: Column) -> Column:
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, 0.0).otherwise(c)


# --- text -------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-case letter/digit runs of three or more, stop words left out."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{3,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def round_long_floats(text: Column) -> Column:
    """Numbers with three or more decimals shown with two (rounded half up)."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+\.\d{3,})"), F.lit(1))
    return F.aggregate(
        F.array_distinct(parts),
        text,
        lambda acc, p: F.replace(acc, p, F.format_string("%.2f", p.cast("double"))),
    )


def head_name(label: Column) -> Column:
    return F.trim(F.element_at(F.split(label, r"\s*[·|]\s*", 2), 1))


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "-")
    return F.regexp_replace(dashed, r"^-+|-+$", "")


def schema_hash(names: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", names), 256), 1, 16)


def two_places(x: Column) -> Column:
    """``x`` with two decimals as C prints it, from its exact binary value; numbers of up to ten digits.

    Java rounds the shortest decimal text, so 0.575, which is a little less in binary, became 0.58. Near
    a half of a hundredth the sign of ``200 x - k`` decides, in two exact parts; exact halves go to even.
    """
    a = F.abs(x)
    high = a.cast("float").cast("double")
    k = F.rint(a * 200)
    off = (high * 200 - k) + (a - high) * 200
    low = F.floor(k / 2)
    up = (k % 2 == 1) & ((off > 0) | ((off == 0) & (low % 2 == 1)))
    n = (low + up.cast("bigint")) / 100.0
    return F.when(x < 0, F.format_string("-%.2f", n)).otherwise(F.format_string("%.2f", n))
