"""Fixed-format text: daily index lines, JSON feeds, element records, markdown chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.skew import halo_blocks, keep_last


def parse_index_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """27-token daily index lines; negatives are missing; comments and short lines are skipped."""
    p = df.select(F.trim(F.col(line)).alias("l")).where("l <> '' AND NOT startswith(l, '#')")
    p = p.select(F.split("l", r"\s+").alias("t")).where(F.size("t") >= 27)
    num = lambda i: F.element_at("t", i + 1).try_cast("double")
    missing = lambda c: F.when(c >= 0, c)
    kp = F.filter(F.transform(F.slice("t", 8, 8), lambda x: x.try_cast("double")), lambda x: x >= 0)
    day = F.try_to_date(F.concat_ws("-", F.element_at("t", 1), F.element_at("t", 2), F.element_at("t", 3)), "y-M-d")
    out = p.select(
        day.alias("date"),
        missing(num(25)).alias("f10_7"),
        missing(num(26)).alias("f10_7_adj"),
        missing(num(23)).alias("ap_index"),
        F.when(F.size(kp) > 0, F.aggregate(kp, F.lit(0.0), lambda a, x: a + x) / F.size(kp)).alias("kp_mean"),
        missing(num(24)).alias("sunspot_number"),
    ).where("date IS NOT NULL")
    return keep_last(out, ["date"], [F.desc("ap_index")])


def parse_flux_feed(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON arrays of {time_tag, flux}; the last report of each UTC day."""
    items = df.select(F.inline(F.from_json(body, "array<struct<time_tag:string,flux:double>>")))
    ok = items.select(F.col("time_tag").try_cast("timestamp").alias("ts"), "flux").where("ts IS NOT NULL AND flux IS NOT NULL")
    return keep_last(ok.withColumn("date", F.to_date("ts")), ["date"], [F.desc("ts"), F.desc("flux")]).select("date", "flux", "ts")


def merge_index(primary: DataFrame, secondary: DataFrame, day: str, column: str, start: str) -> DataFrame:
    """Secondary overrides one column on shared days and adds the days only it has."""
    s = secondary.select(day, F.col(column).alias("__s"))
    both = primary.where(F.col(day) >= F.lit(start).cast("date")).join(s, day, "full")
    return both.withColumn(column, F.coalesce("__s", column)).drop("__s")


# Old column names of the daily index.
INDEX_RENAMES = {
    "f10_7_obs": "f10_7",
    "sn_sunspot": "sunspot_number",
    "sn": "sunspot_number",
    "Ap": "ap_index",
    "ap": "ap_index",
    "kp": "kp_mean",
}
INDEX_COLUMNS = ("date", "f10_7", "f10_7_adj", "ap_index", "kp_mean", "sunspot_number", "source")


def normalize_index(df: DataFrame) -> DataFrame:
    """Rename old columns, add missing ones, fixed order."""
    for old, new in INDEX_RENAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    missing = lambda c: F.lit("unknown") if c == "source" else F.lit(None).cast("double")
    return df.select(*[F.col(c) if c in df.columns else missing(c).alias(c) for c in INDEX_COLUMNS])


def record_epoch(yy: Column, day: Column) -> Column:
    """Microseconds of a two-digit year (pivot 57) and fractional day of year."""
    year = F.when(yy < 57, yy + 2000).otherwise(yy + 1900)
    first = F.unix_micros(F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp"))
    return first + F.round((day - 1) * 86400e6).cast("bigint")


def implied_exponent(field: Column) -> Column:
    """Signed mantissa with implied leading point and exponent, e.g. ``-40054-4``."""
    rx = r"^([+-]?)(\d+)([+-]\d+)$"
    t = F.trim(field)
    part = lambda i: F.regexp_extract(t, rx, i)
    value = (F.concat(F.lit("0."), part(2))).try_cast("double") * F.pow(F.lit(10.0), part(3).try_cast("int"))
    return F.when(t == "", 0.0).otherwise(F.when(part(1) == "-", -value).otherwise(value))


def parse_element_records(df: DataFrame, file: str = "file", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Name / line 1 / line 2 records to rows.

    ``line_no`` is 1-based and dense per file. Files are cut into blocks that carry the two
    preceding lines, so one huge file is spread over many tasks.
    """
    blocks = halo_blocks(df.withColumn("__pos", F.col(line_no)), pos="__pos", before=2)
    w = Window.partitionBy(file, "block").orderBy("__pos")
    rows = blocks.select("*", F.lag(line, 1).over(w).alias("l1"), F.lag(line, 2).over(w).alias("name")).where("owned")
    l2 = F.rtrim(F.col(line))
    ok = l2.startswith("2 ") & (F.length(l2) >= 60) & F.col("l1").startswith("1 ") & (F.length(F.rtrim("l1")) >= 60)
    sub = lambda c, a, b: F.trim(F.substring(c, a, b - a + 1))
    num = lambda c, a, b: sub(c, a, b).try_cast("double")
    nid = sub("l1", 3, 7).try_cast("bigint")
    is_name = F.col("name").isNotNull() & ~F.substring("name", 1, 2).isin("1 ", "2 ") & ~F.col("name").startswith("#")
    clean = F.regexp_replace(F.trim("name"), r"\s+", " ")
    return rows.where(ok & nid.isNotNull()).select(
        nid.alias("norad_id"),
        F.when(is_name & (F.trim("name") != ""), clean).otherwise(F.concat(F.lit("NORAD "), nid.cast("string"))).alias("object_name"),
        record_epoch(sub("l1", 19, 20).try_cast("int"), num("l1", 21, 32)).alias("epoch_us"),
        implied_exponent(F.substring("l1", 54, 8)).alias("bstar"),
        num(line, 9, 16).alias("inclination_deg"),
        num(line, 18, 25).alias("raan_deg"),
        F.concat(F.lit("0."), sub(line, 27, 33)).try_cast("double").alias("eccentricity"),
        num(line, 53, 63).alias("mean_motion"),
    )


def markdown_chunks(df: DataFrame, path: str, text: str, min_chars: int = 40, cap: int = 1800) -> DataFrame:
    """Sections between headings; bodies under ``min_chars`` are dropped.

    A body longer than ``cap`` becomes consecutive parts of that length, numbered from 0 in ``part``.
    """
    parts = F.split(F.concat(F.lit("# "), F.col(path), F.lit("\n"), F.col(text)), r"(?m)^[ \t]*#{1,4}[ \t]+(?=\S)")
    # Outer, and filtered by what they give: Spark works a plain explode's array out again to ask whether it is empty.
    secs = df.select(path, F.posexplode_outer(parts).alias("chunk_no", "s")).where("chunk_no > 0")
    body = F.regexp_replace(F.regexp_replace("s", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "")
    out = secs.select(
        path, F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.trim(F.substring_index("s", "\n", 1)).alias("heading"), body.alias("body"),
    )
    numbers = F.when(F.length("body") >= min_chars, F.sequence(F.lit(0), F.floor((F.length("body") - 1) / cap).cast("int")))
    return out.select(path, "chunk_no", "heading", "body", F.explode_outer(numbers).alias("part")).where("part IS NOT NULL").select(
        path, "chunk_no", "part", "heading", F.substring(F.col("body"), F.col("part") * cap + 1, F.lit(cap)).alias("text")
    )


def retrieve(chunks: DataFrame, query_tokens: Column, key: str, heading: str, text: str) -> DataFrame:
    """Distinct query-token overlap plus two for a heading hit; rows without overlap are dropped."""
    from driftline.functions.scalars import tokens

    all_t = tokens(F.concat_ws(" ", heading, text))
    hits = F.size(F.array_intersect(F.array_distinct(all_t), query_tokens))
    head = F.size(F.array_intersect(tokens(F.col(heading)), query_tokens)) > 0
    return chunks.withColumn("overlap", hits).where("overlap > 0").withColumn(
        "score", F.col("overlap") + F.when(head, 2).otherwise(0)
    )


def retrieve_all(chunks: DataFrame, queries: DataFrame, query_id: str, query_text: str, keys: list[str], heading: str, text: str, k: int) -> DataFrame:
    """The ``k`` best chunks of every query: ``query_id``, ``keys``, ``score`` and ``rank``, ties by ``keys``.

    As :func:`retrieve`, for any number of queries. Chunks and queries meet on tokens, so only pairs with
    an overlap are formed. Where the chunks are dealt by one of ``keys`` and the queries are few enough for a
    broadcast, pairs are counted where they are, and each task sends ``k`` chunks a query.
    """
    from driftline.functions.scalars import tokens

    # Outer generators hand on what they were given, so each text is cut into words once, not once for each of its words.
    words = lambda c: F.coalesce(F.array_distinct(tokens(F.col(c))), F.array().cast("array<string>"))
    cut = chunks.select(*keys, F.inline_outer(F.array(F.struct(words(heading).alias("__h"), words(text).alias("__b")))))
    kinds = F.array(F.struct(F.lit(True).alias("__in"), F.col("__h").alias("__ts")), F.struct(F.lit(False).alias("__in"), F.array_except("__b", "__h").alias("__ts")))
    mine = cut.select(*keys, F.inline_outer(kinds)).select(*keys, "__in", F.explode_outer("__ts").alias("__t"))
    asked = queries.select(query_id, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("__t"))
    pairs = mine.join(asked, "__t").groupBy(query_id, *keys).agg((F.count("*") + F.when(F.max("__in"), 2).otherwise(0)).alias("score"))
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), *keys)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
