"""Personal data: fixed formats, and identifiers found by bootstrapped contexts.

Entities of the fixed formats are seeds. The words around them become patterns, patterns and
instances form a graph, and both sides are scored in turn. Patterns that end up trustworthy mark
identifiers that no format covers. Everything is a column expression or a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: A run that can't match is looked at once: matches start at a run's head or where the last one ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": None, "card": None, "phone": "+"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
#: A token with a digit or an at sign.
TOKEN = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++"


def placed(text: Column, pattern: str) -> Column:
    """Matches with their places in code points, and the text before and after each."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("value"), g.alias("gap")))
    both = F.filter(both, lambda x: x["value"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,value:string,gap:string>>")
    one = lambda acc, x: F.struct(
        (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["value"])).alias("at"),
        F.array_append(
            acc["out"],
            F.struct((acc["at"] + F.char_length(x["gap"])).alias("start"), (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["value"])).alias("end"), x["value"].alias("value"), x["gap"].alias("gap")),
        ).alias("out"),
    )
    return F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), one, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.sequence(F.lit(1), F.char_length(digits)), lambda i: F.when(i % 2 == 0, double(value(i))).otherwise(value(i)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return F.when(F.char_length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All spans of the fixed formats, by kind and then by start."""
    return F.concat(*[_base(text, kind) for kind in KINDS])


def _base(text: Column, kind: str) -> Column:
    likely = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike("[0-9]")
    found = F.transform(
        F.filter(placed(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"])),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")),
    )
    return F.when(likely, found).otherwise(F.array().cast(SPAN))


def _tokens(text: Column, base: Column) -> Column:
    """Tokens that could be identifiers: place, shape, the word before, and the base kind they touch."""
    core = lambda v: F.regexp_extract(v, r"[\p{L}\p{N}](?:\S*[\p{L}\p{N}])?", 0)
    # Only the coarsest shape: identifiers of a form not known are the ones to find.
    shape = lambda v: F.when(v.contains("@"), "@").when(v.rlike("\\p{L}"), "a9").otherwise("9")

    def token(x):
        start = x["start"] + F.greatest(F.instr(x["value"], core(x["value"])) - 1, F.lit(0))
        end = start + F.char_length(core(x["value"]))
        touched = F.filter(base, lambda b: (b["start"] < end) & (b["end"] > start))
        return F.struct(
            start.alias("start"), end.alias("end"), core(x["value"]).alias("value"), shape(core(x["value"])).alias("shape"),
            F.lower(F.regexp_extract(x["gap"], r"(\p{L}+)\P{L}*$", 1)).alias("left"), F.get(touched, F.lit(0))["kind"].alias("known"),
        )

    none = F.array().cast("array<struct<start:int,end:int,value:string,shape:string,left:string,known:string>>")
    found = F.filter(F.transform(placed(text, TOKEN), token), lambda t: (F.char_length(t["value"]) > 0) & (t["left"] != ""))
    return F.when(text.rlike("[0-9@]"), found).otherwise(none)


def _trusted(edges: DataFrame, words: DataFrame, rounds: int, support: int, precision: float, rate: float) -> DataFrame:
    """Patterns (word before, shape) with the kind they announce.

    A pattern's score is the mean confidence of its distinct instances, an instance's the best score
    of the patterns that hold it; seeds are certain. The word must stand before candidates often.
    """
    edges = materialize(edges.groupBy("left", "shape", "value").agg(F.max("known").alias("known"), F.count("*").alias("n")), "pii-edges")
    before = edges.groupBy("left").agg(F.sum("n").alias("n")).join(words, "left").where(F.col("n") >= rate * F.col("total")).select("left")
    edges = materialize(edges.join(before, "left"), "pii-edges")
    per_pattern = edges.groupBy("left", "shape").agg(F.count("*").alias("all"))
    instances = edges.where("known is not null").select("value", F.col("known").alias("kind"), F.lit(1.0).alias("conf")).distinct()
    trusted = None
    for _ in range(rounds):
        scored = edges.join(instances, "value").groupBy("left", "shape", "kind").agg(F.sum("conf").alias("sum"), F.count("*").alias("n"))
        scored = scored.join(per_pattern, ["left", "shape"]).where((F.col("n") >= support) & (F.col("sum") >= precision * F.col("all")))
        trusted = materialize(scored.select("left", "shape", "kind", (F.col("sum") / F.col("all")).alias("score")), "pii-patterns")
        new = edges.where("known is null").join(trusted, ["left", "shape"]).groupBy("value", "kind").agg(F.max("score").alias("conf"))
        seeds = edges.where("known is not null").select("value", F.col("known").alias("kind"), F.lit(1.0).alias("conf")).distinct()
        instances = materialize(seeds.unionByName(new), "pii-instances")
    return trusted.groupBy("left", "shape").agg(F.max_by("kind", "score").alias("kind"))


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = 3, support: int = 3, precision: float = 0.7, rate: float = 0.2) -> DataFrame:
    """Row per row of ``docs``: id, ``base`` and ``added`` spans (kind, start, end, value).

    Places count code points. Null and empty texts have no spans; a null id stays null; repeated rows
    get the same spans each; an empty table gives no rows; other columns are ignored. ``added`` holds
    identifiers behind trusted words, of kind ``near_`` and the kind of their like; base spans are
    never changed by them.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    marked = materialize(
        rows.withColumn("base", base_spans(F.col("text"))).select("id", "h", "base", _tokens(F.col("text"), F.col("base")).alias("tokens")), "pii-spans"
    )
    edges = marked.where(F.size("tokens") > 0).select("id", "h", F.inline("tokens"))
    likely = rows.where(F.col("text").rlike("[0-9@]")).select(F.explode(F.split(F.lower("text"), r"\P{L}+")).alias("left"))
    words = likely.where("left <> ''").groupBy("left").agg(F.count("*").alias("total"))
    trusted = _trusted(edges.select("left", "shape", "value", "known"), words, rounds, support, precision, rate)
    span = F.struct(F.concat(F.lit("near_"), "kind").alias("kind"), "start", "end", "value")
    added = edges.where("known is null").join(trusted, ["left", "shape"]).groupBy("id", "h").agg(F.array_sort(F.collect_set(span)).alias("added"))
    added = added.withColumnsRenamed({"id": "__id", "h": "__h"})
    out = marked.join(added, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left")
    return out.select(F.col("id").alias(id_column), "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
