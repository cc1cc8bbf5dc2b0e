"""Recursive splitting of long series: distributed while a segment is large, local when small.

A segment's split depends only on its own rows, so once segments fit ``LOCAL_ROWS`` each is
finished in its own bounded group. Larger ones are split by rounds of joins and partial
aggregates; no task ever holds a whole large series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import skew
from driftline.session import materialize

LOCAL_ROWS = 4096


def members(rows: DataFrame, segments: DataFrame, key: str, pos: str, *columns: str) -> DataFrame:
    """Rows with the segment they are in, ``lo < pos <= hi``, and the segment's ``columns``.

    Segments of a key do not overlap. A segment meets the row it begins with by place, and the rows
    behind take it over from there, in two levels; no row meets the key's other segments.
    """
    begin = segments.select(key, (F.col("lo") + 1).alias(pos), F.struct("lo", "hi", *columns).alias("__begin"))
    marked = materialize(rows.join(begin, [key, pos], "left"), "segment-rows")
    carried = skew.running(marked, [key], pos, F.col("__begin"), "__in", how="last").drop("__begin")
    return carried.where(F.col(pos) <= F.col("__in.hi")).select(*rows.columns, "__in.*")


def split_rounds(
    rows: DataFrame,
    segments: DataFrame,
    key: str,
    best_split: Callable[[DataFrame, DataFrame], DataFrame],
    limit: int = LOCAL_ROWS,
) -> tuple[DataFrame, DataFrame | None]:
    """(segments of at most ``limit`` rows, split points found on the way).

    ``segments(key, lo, hi)`` spans positions lo..hi. ``best_split(rows, segments)`` returns
    ``key, lo, hi, at`` for accepted splits; a large segment without one is final and dropped.
    """
    small = segments.where(F.col("hi") - F.col("lo") <= limit)
    big = materialize(segments.where(F.col("hi") - F.col("lo") > limit), "big-segments")
    found = None
    while not big.isEmpty():
        cut = materialize(best_split(rows, big), "splits")
        found = cut.select(key, "at") if found is None else found.unionByName(cut.select(key, "at"))
        halves = cut.select(
            key,
            F.inline(
                F.array(
                    F.struct(F.col("lo").alias("lo"), F.col("at").alias("hi")),
                    F.struct(F.col("at").alias("lo"), F.col("hi").alias("hi")),
                )
            ),
        )
        small = small.unionByName(halves.where(F.col("hi") - F.col("lo") <= limit))
        big = materialize(halves.where(F.col("hi") - F.col("lo") > limit), "big-segments")
    return small, found
