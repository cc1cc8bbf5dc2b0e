"""Building blocks that keep per-entity series work balanced when one entity is huge.

A plain ``Window.partitionBy(entity)`` sends an entity's whole history to one task. Here a
series is numbered slot by slot (``positions``), then cut into equal blocks that carry the few
neighbour rows a sliding frame needs (``halo_blocks``). Every task sees a bounded block, and the
result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 2048


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slot: Column,
    name: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Add the 1-based row number per ``keys`` in ``order`` without one task per key.

    ``slot`` is a monotone coarsening of the first order column (a day, an hour). Rows are
    counted per (key, slot) with map-side combine; only that small table is scanned per key.
    Rows are then numbered inside their slot. ``total`` adds the key's row count.
    """
    keys = list(keys)
    with_slot = df.withColumn("__slot", slot)
    by_key = Window.partitionBy(*keys).orderBy("__slot")
    counts = with_slot.groupBy(*keys, "__slot").agg(F.count("*").alias("__n"))
    before = counts.select(
        *keys,
        "__slot",
        (F.sum("__n").over(by_key) - F.col("__n")).alias("__before"),
        *([F.sum("__n").over(Window.partitionBy(*keys)).alias(total)] if total else []),
    )
    in_slot = Window.partitionBy(*keys, "__slot").orderBy(*order)
    return (
        with_slot.join(before, [*keys, "__slot"])
        .withColumn(name, F.col("__before") + F.row_number().over(in_slot))
        .drop("__slot", "__before")
    )


def halo_blocks(
    df: DataFrame,
    pos: str = "pos",
    before: int = 0,
    after: int = 0,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Cut numbered rows into blocks of ``size``; copy edge rows into neighbour blocks.

    Adds ``block`` and ``owned``. A frame of up to ``before`` preceding and ``after`` following
    rows, partitioned by (key, block), is exact for owned rows. Drop the others afterwards.
    """
    if max(before, after) >= size:
        raise ValueError("block size must exceed the frame")
    own = F.floor((F.col(pos) - 1) / F.lit(size))
    offset = (F.col(pos) - 1) % F.lit(size)
    targets = [own]
    if before:
        targets.append(F.when(offset >= size - before, own + 1))
    if after:
        targets.append(F.when((offset < after) & (own > 0), own - 1))
    return df.withColumn("block", F.explode(F.array_compact(F.array(*targets)))).withColumn(
        "owned", F.col("block") == own
    )


def block_window(keys: Sequence[str], pos: str = "pos"):
    """Window over one block in position order."""
    return Window.partitionBy(*keys, "block").orderBy(pos)


def owned(df: DataFrame) -> DataFrame:
    return df.where("owned").drop("block", "owned")


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: Column,
    name: str,
    how: str = "sum",
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Running sum / min / max / last-non-null per key, in two levels.

    Blocks are aggregated first; the block table (rows / size) is scanned per key; each row adds
    its block's carry to a scan inside the block.
    """
    agg = {
        "sum": F.sum,
        "min": F.min,
        "max": F.max,
        "last": lambda c: F.last(c, ignorenulls=True),
    }[how]
    keys = list(keys)
    blocks = df.withColumn("__v", value).withColumn(
        "__b", F.floor((F.col(pos) - 1) / F.lit(size))
    )
    if how == "last":
        # max_by over (position) is a partial aggregate, unlike an ordered ``last``.
        total = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(pos)))
    else:
        total = agg(F.col("__v"))
    over_blocks = Window.partitionBy(*keys).orderBy("__b").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = (
        blocks.groupBy(*keys, "__b")
        .agg(total.alias("__t"))
        .select(*keys, "__b", agg(F.col("__t")).over(over_blocks).alias("__c"))
    )
    inside = (
        Window.partitionBy(*keys, "__b")
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    zero = F.lit(0.0)
    merged = {
        "sum": F.when(
            F.col("__c").isNotNull() | F.col("__l").isNotNull(),
            F.coalesce("__c", zero) + F.coalesce("__l", zero),
        ),
        "min": F.least("__c", "__l"),
        "max": F.greatest("__c", "__l"),
        "last": F.coalesce("__l", "__c"),
    }[how]
    return (
        blocks.join(carry, [*keys, "__b"])
        .withColumn("__l", agg(F.col("__v")).over(inside))
        .withColumn(name, merged)
        .drop("__v", "__b", "__c", "__l")
    )


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Last ``n`` rows per key; Spark keeps at most ``n`` per key in each map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the last in ``order`` (given descending). Copies are cut map-side."""
    return latest_rows(df, keys, order, 1)


def curated(df: DataFrame, *columns: str, limit: int = 1024) -> Column:
    """A curated dimension as one array-of-struct scalar; fails when larger than ``limit``.

    Used where every row must meet every row of a small, hand-kept list: the list rides along
    as a scalar subquery and is exploded, so work grows with the large side only.
    """
    rows = F.sort_array(F.collect_list(F.struct(*columns)))
    checked = F.when(F.count("*") <= limit, rows).otherwise(
        F.raise_error(F.lit(f"curated list exceeds {limit} rows"))
    )
    # One row past the limit is enough to notice an oversized list without gathering it.
    return df.limit(limit + 1).agg(checked.alias("rows")).scalar()


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = 10000,
    few: bool = False,
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, plus ``n``.

    A mergeable sketch brackets each quantile; ranks below the bracket are only counted, and
    just the values inside it (about ``4 n / accuracy``) are ordered. Groups of up to
    ``4 * accuracy`` rows are ordered whole. A large group never meets in one task. ``few`` says that
    the groups are a fixed handful (panels, classes): their brackets are broadcast, so that the rows of
    a group stay where they are until they are counted.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).alias("__v")).where(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    eps = 2.0 / accuracy
    names = list(probs)
    edges = [max(0.0, probs[p] - eps) for p in names] + [min(1.0, probs[p] + eps) for p in names]
    sketch = F.percentile_approx("__v", edges, accuracy)
    ranges = (data.groupBy(*keys) if keys else data).agg(
        F.count("*").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        sketch.alias("__q"),
    )
    k = len(names)
    # Below this size neighbouring ranks can be further apart than the sketch's bracket.
    small = F.col("__n") <= 4 * accuracy
    brackets = ranges.select(
        *keys, "__n",
        F.array(
            *[
                F.struct(
                    F.lit(p).alias("p"),
                    F.lit(float(probs[p])).alias("f"),
                    (F.col("__min") if probs[p] <= eps else F.when(small, F.col("__min")).otherwise(F.col("__q")[i])).alias("lo"),
                    (F.col("__max") if probs[p] >= 1 - eps else F.when(small, F.col("__max")).otherwise(F.col("__q")[k + i])).alias("hi"),
                )
                for i, p in enumerate(names)
            ]
        ).alias("__br"),
    )
    joined = data.join(F.broadcast(brackets) if few else brackets, keys) if keys else data.select(
        "__v",
        brackets.select(F.struct("__n", "__br")).scalar().alias("__s"),
    ).select("__v", "__s.__n", "__s.__br")
    # Values below the bracket collapse to one null-valued row per task before the shuffle.
    marked = (
        joined.select(*keys, "__n", "__v", F.inline("__br"))
        .where(F.col("__v") <= F.col("hi"))
        .withColumn("__v", F.when(F.col("__v") >= F.col("lo"), F.col("__v")))
    )
    counted = marked.groupBy(*keys, "p", "f", "__n", "__v").agg(F.count("*").alias("__c"))
    cum = Window.partitionBy(*keys, "p").orderBy(F.col("__v").asc_nulls_first())
    ranked = counted.withColumn("__hi", F.sum("__c").over(cum)).withColumn(
        "__lo", F.col("__hi") - F.col("__c")
    )
    h = (F.col("__n") - 1) * F.col("f")
    fl, ce = F.floor(h), F.ceil(h)
    at = lambda idx: F.max(F.when((F.col("__lo") <= idx) & (idx < F.col("__hi")), F.col("__v")))
    # A rank that fell on the collapsed row was outside its bracket; that must not pass for a null.
    sure = lambda v: F.coalesce(v, F.raise_error(F.lit("quantile outside its bracket; raise the accuracy")).cast("double"))
    picked = ranked.groupBy(*keys, "p").agg(
        F.first("__n").alias("n"), sure(at(fl).cast("double")).alias("__a"), sure(at(ce).cast("double")).alias("__b"), F.first(h - fl).alias("__w")
    ).withColumn("__val", F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__w"))
    out = (picked.groupBy(*keys) if keys else picked.groupBy()).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("p") == p, F.col("__val"))).alias(p) for p in names],
    )
    return out


def value_bins(df: DataFrame, value: str, bins: int = 128) -> DataFrame:
    """Add ``__bin``: the row's place among sketched quantile bounds (equal values share a bin).

    Lets global orderings run bin by bin: bins are few, ordered and about equal in rows.
    """
    probs = [i / bins for i in range(1, bins)]
    bounds = df.agg(F.percentile_approx(value, probs, 10000)).scalar()
    below = F.filter("__q", lambda x: x < F.col(value))
    return df.select("*", bounds.alias("__q")).withColumn("__bin", F.size(below)).drop("__q")
