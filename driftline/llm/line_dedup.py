"""Near-copies of lines by a segment-partition edit join, in DataFrame operations alone.

A line is cut into one segment more than the edits allowed, so a line within that distance holds one
of them unchanged. Every line probes the index of the lengths it may match with the few substrings
that can be that segment; what shares one is verified by banded edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.joins import sized
from driftline.session import materialize

EDITS, CHARS_PER_EDIT = 2, 5
#: Lines that share a segment before their letters are counted; the letters, how many of them part the
#: lines before they meet, and the width of a cell.
COMMON, LETTERS, CELLS, CELL = 8, "etnarhiosdlcmu", 3, 2 * EDITS + 1


def allowed(length: Column) -> Column:
    """Edits between two lines of which the shorter has ``length`` code points: similarity 0.8, two at most, so closer from 15 on."""
    return F.least(F.lit(EDITS), F.floor(length / CHARS_PER_EDIT).cast("int"))


def _segment(length: Column, edits: int, i: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of a line; the last ones are longer by one."""
    k = edits + 1
    size = F.floor(length / k).cast("int")
    short = k - length % k
    return i * size + F.greatest(F.lit(0), F.lit(i) - short), size + (F.lit(i) >= short).cast("int")


def _key(line: Column, plain: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    """Hash of a substring with the length and number of its segment.

    In a ``plain`` line characters are bytes, which are cut at once; elsewhere they have to be counted.
    Equal substrings have equal bytes, and so equal hashes, either way.
    """
    piece = F.when(plain, F.substring(line.cast("binary"), start + 1, size)).otherwise(F.substring(line, start + 1, size).cast("binary"))
    return F.xxhash64(length, F.lit(i), piece)


def index_keys(line: Column, n: Column, plain: Column) -> Column:
    """Hashes of the segments of a line, with its length and their number."""
    keys = []
    for edits in range(1, EDITS + 1):
        for i in range(edits + 1):
            start, size = _segment(n, edits, i)
            keys.append(F.when(allowed(n) == edits, _key(line, plain, n, i, start, size)))
    return F.array_compact(F.array(*keys))


def probe_keys(line: Column, n: Column, plain: Column) -> Column:
    """Hashes of the substrings that may be a segment of a line as long or up to ``EDITS`` shorter."""
    keys = []
    for edits in range(1, EDITS + 1):
        for less in range(edits + 1):
            other = n - less
            for i in range(edits + 1):
                start, size = _segment(other, edits, i)
                # With more shift than this, another segment would be unchanged as well.
                for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                    at = start + shift
                    fits = (allowed(other) == edits) & (at >= 0) & (at + size <= n)
                    keys.append(F.when(fits, _key(line, plain, other, i, at, size)))
    return F.array_compact(F.array(*keys))


def _lines(docs: DataFrame) -> DataFrame:
    """Every line that isn't blank with its place; equal texts of one id are one place."""
    lines = docs.select("id", "th", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.trim("line") != "")
    return lines.select(
        F.struct("id", "th", "no").alias("place"), "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2")
    )


def _letters(line: Column) -> Column:
    """How many of each letter a line has; an edit changes two of the counts by one at most."""
    return F.array(*[F.char_length(line) - F.char_length(F.replace(line, F.lit(c), F.lit(""))) for c in LETTERS])


def _two_cells(low: Column, high: Column):
    """Both cells that a count within the edits may be in."""
    return lambda key: F.array_distinct(F.array(F.xxhash64(key, low), F.xxhash64(key, high)))


def _crowd_pairs(index: DataFrame, probe: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs under keys that many lines have: they meet only if the counts of all letters are near enough."""
    index = materialize(index, "line-index")
    members = sized(materialize(index.select("h").union(probe.select("h")).distinct(), "line-members"))
    letters = materialize(lines.join(members, "h").groupBy("h").agg(F.first(_letters(F.col("line"))).alias("c")), "line-letters")
    cell = lambda k, by: F.floor((F.col("c")[k] + by) / CELL)
    own, ways = F.col("key"), F.array("key")
    for k in range(CELLS):
        own = F.xxhash64(own, cell(k, 0))
        ways = F.flatten(F.transform(ways, _two_cells(cell(k, -EDITS), cell(k, EDITS))))
    index = index.join(letters, "h").select(own.alias("key"), F.col("h").alias("a"), F.col("c").alias("ca"))
    probe = probe.join(letters, "h").select(F.explode(ways).alias("key"), F.col("h").alias("b"), F.col("c").alias("cb"))
    apart = F.lit(0)
    for k in range(len(LETTERS)):
        apart = apart + F.abs(F.col("ca")[k] - F.col("cb")[k])
    near = (index["key"] == probe["key"]) & (F.col("a") != F.col("b")) & (apart <= 2 * EDITS)
    return index.join(probe, near).select("a", "b")


def _index(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode(index_keys(F.col("line"), F.col("n"), F.col("plain"))).alias("key"), "h")


def _probe(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode(probe_keys(F.col("line"), F.col("n"), F.col("plain"))).alias("key"), "h")


def near_pairs(lines: DataFrame) -> DataFrame:
    """Pairs of distinct lines (``h``, ``line``, ``n``, ``plain``; a written table) that share a segment where it may stand.

    Lines of a segment that many have are parted further by their letters, so that a common phrase
    doesn't bring all its lines together; no pair within the edits is lost by it.
    """
    lines = lines.where(F.col("n") >= CHARS_PER_EDIT)
    # Segments are counted, joined and parted again, so they are written once.
    index, probe = materialize(_index(lines), "line-segments"), _probe(lines).withColumnRenamed("h", "b")
    common = index.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > COMMON).select("key")
    common = materialize(common, "line-common")
    keys = sized(common)
    rare = index.join(keys, "key", "left_anti").select("key", F.col("h").alias("a"))
    # A common segment meets its probes with one row for all its lines; those are looked at afterwards.
    rare = rare.unionByName(common.withColumn("a", F.lit(None).cast("long")))
    met = materialize(rare.join(probe, "key").where("a is null or a <> b"), "line-met")
    pairs = met.where("a is not null").select("a", "b")
    if not common.isEmpty():
        pairs = pairs.union(_crowd_pairs(index.join(keys, "key").select("key", "h"), met.where("a is null").select("key", F.col("b").alias("h")), lines))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Every line to remove: its ``place`` (id, hash of the text, line number), the ``first`` place of
    an earlier line that is its like, and whether it is an exact copy.

    ``docs`` has ``id``, ``text`` and ``th``. A line goes if an earlier line, by id and number, is
    equal or within the allowed edits.
    """
    lines = _lines(docs)
    firsts = lines.groupBy("h", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    copied = sized(materialize(firsts.where("n > 1").select("h", "h2", "first"), "line-copies"))
    single = lines.join(copied, ["h", "h2"], "left").where("first is null or first = place").drop("first")
    n = F.char_length("line")
    single = materialize(single.select("h", "h2", "line", "place", n.alias("n"), (F.octet_length("line") == n).alias("plain")), "line-single")
    pairs = materialize(near_pairs(single.select("h", "line", "n", "plain")), "line-pairs")
    wanted = sized(materialize(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "line-wanted"))
    texts = materialize(single.join(wanted, "h").select("h", "h2", "line", "place"), "line-texts")
    one, two = (texts.select(F.col("h").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("h2", "line", "place"))) for k in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b")
    shorter = F.least(F.char_length("line_a"), F.char_length("line_b"))
    distance = F.levenshtein("line_a", "line_b", EDITS)
    close = both.where((distance >= 0) & (distance <= allowed(shorter)))
    later = F.when(F.col("place_a") < F.col("place_b"), F.struct(F.col("b").alias("h"), F.col("h2_b").alias("h2"), F.col("place_a").alias("like")))
    later = later.otherwise(F.struct(F.col("a").alias("h"), F.col("h2_a").alias("h2"), F.col("place_b").alias("like")))
    near = close.select(later.alias("x")).select("x.*").groupBy("h", "h2").agg(F.min("like").alias("like"))
    gone = copied.join(near, ["h", "h2"], "full").select("h", "h2", "first", "like")
    gone = sized(materialize(gone, "line-gone"))
    found = lines.join(gone, ["h", "h2"]).where("like is not null or first <> place")
    exact = F.col("first").isNotNull() & (F.col("first") != F.col("place"))
    return found.select("place", F.when(exact, F.col("first")).otherwise(F.col("like")).alias("first"), exact.alias("exact"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` in the struct ``row``, with ``kept`` (its text without repeated lines),
    ``n_lines`` (not blank), ``n_removed`` and ``removed`` (number, place of the like, exact).

    Lines end at a line feed. Blank lines stay and are never compared. Null texts stay null, with no
    line; a null id counts as the smallest; rows equal in id and text are one place, so neither goes
    because of the other; an empty table gives no rows; other columns are carried.
    """
    text = F.col(f"`{text_column}`").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_column}`").alias("id"), text.alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    found = repeated_lines(rows.select("id", "th", "text"))
    removed = found.groupBy(F.col("place.id").alias("gone_id"), F.col("place.th").alias("gone_th")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("place.no").alias("no"), F.col("first.id").alias("like_id"), F.col("first.no").alias("like_no"), "exact"))).alias("removed")
    )
    removed = sized(materialize(removed, "line-removed"))
    out = rows.join(removed, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left")
    lines, numbers = F.split("text", "\n"), F.transform("removed", lambda r: r["no"])
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(numbers, i)), "\n")
    size = F.size(F.filter(lines, lambda x: F.trim(x) != ""))
    return out.select(
        "row", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        F.when(F.col("text").isNull(), 0).otherwise(size).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("removed"), F.lit(0)).cast("long").alias("n_removed"), "removed",
    )
