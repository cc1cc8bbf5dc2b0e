"""Sequential rules with a small state, run block by block.

A rule that reads a series in order and remembers one of a few states is reduced, per block, to the map
from the state at its start to that at its end. Maps are composed level by level, so each block
learns its starting state without any task or array that grows with the series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import materialize

FAN, LEVELS = 256, 3


def entry_states(maps: DataFrame, keys: Sequence[str], block: str, states: int, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """State ``state`` in which every block is entered: ``keys``, ``block``, ``state``.

    ``maps(keys, block, m)`` has the states after a block by the state before it (0 .. ``states - 1``).
    A series starts in state 0, and so does a block that does not follow the one before directly.
    ``levels`` rounds of ``fan`` blocks each leave one short list per key.
    """
    keys = list(keys)
    # A state is worth something only for the very next block.
    enter = lambda s, last, x: F.when(x["a"] == last + 1, s).otherwise(F.lit(0))
    after = lambda s, x: F.element_at(x["m"], s + 1)
    node = F.struct(F.col("a"), F.col("z"), F.col("b"), F.col("m"))
    level = [materialize(maps.select(*keys, F.col(block).alias("b"), F.col(block).alias("a"), F.col(block).alias("z"), "m"), "chain-0")]

    def composed(s: Column) -> Column:
        step = lambda acc, x: F.struct(after(enter(acc["s"], acc["z"], x), x).alias("s"), x["z"].alias("z"))
        first = F.element_at("l", 1)["a"] - 1
        return F.aggregate("l", F.struct(s.cast("int").alias("s"), first.alias("z")), step)["s"]

    for i in range(levels):
        listed = level[-1].groupBy(*keys, F.floor(F.col("b") / fan).alias("b")).agg(F.array_sort(F.collect_list(node)).alias("l"))
        up = listed.select(
            *keys, "b", F.element_at("l", 1)["a"].alias("a"), F.element_at("l", -1)["z"].alias("z"),
            F.transform(F.sequence(F.lit(0), F.lit(states - 1)), composed).alias("m"), F.transform("l", lambda x: x).alias("l"),
        )
        level.append(materialize(up, f"chain-{i + 1}"))

    def entries(lists: DataFrame, start: Column, first: Column) -> DataFrame:
        none = F.array().cast("array<struct<b:bigint,s:int>>")
        step = lambda acc, x: F.struct(
            F.concat(acc["o"], F.array(F.struct(x["b"].alias("b"), enter(acc["s"], acc["z"], x).alias("s")))).alias("o"),
            after(enter(acc["s"], acc["z"], x), x).alias("s"), x["z"].alias("z"),
        )
        out = F.aggregate("l", F.struct(none.alias("o"), start.cast("int").alias("s"), first.alias("z")), step)["o"]
        return lists.select(*keys, F.inline(out)).withColumnRenamed("s", "state")

    top = level[-1].groupBy(*keys).agg(F.array_sort(F.collect_list(node)).alias("l"))
    known = entries(top, F.lit(0), F.lit(-2).cast("bigint"))
    for lists in reversed(level[1:]):
        joined = lists.select(*keys, "b", "l").join(known, [*keys, "b"])
        known = entries(joined, F.col("state"), F.element_at("l", 1)["a"] - 1)
    return known.withColumnRenamed("b", block)


def run_blocks(
    blocks: DataFrame, keys: Sequence[str], block: str, states: int, after: Callable[[Column], Column], fan: int = FAN, levels: int = LEVELS
) -> DataFrame:
    """``blocks`` with the ``state`` each is entered in; ``after(s)`` is the state behind a block entered in ``s``."""
    blocks = materialize(blocks, "chain-blocks")
    maps = blocks.select(*keys, block, F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: after(s).cast("int")).alias("m"))
    return blocks.join(entry_states(maps, keys, block, states, fan, levels), [*keys, block])


def spaced(candidates: DataFrame, keys: Sequence[str], at: str, gap: int, size: int = 512) -> DataFrame:
    """Candidates kept greedily in order, each at least ``gap`` after the last kept one.

    The state is the number of places that the last kept one still blocks in the next block.
    """
    keys, size = list(keys), max(size, 2 * gap)
    place = F.col(at).cast("bigint")
    blocks = candidates.groupBy(*keys, F.floor(place / size).alias("__block")).agg(F.array_sort(F.collect_set(place)).alias("__at"))
    start, end = F.col("__block") * size, (F.col("__block") + 1) * size
    free = lambda u, x: F.when(x >= u, x + gap).otherwise(u)
    left = lambda s: F.greatest(F.lit(0).cast("bigint"), F.aggregate("__at", start + s, free) - end)
    entered = run_blocks(blocks, keys, "__block", gap, left)
    step = lambda acc, x: F.struct(F.when(x >= acc["u"], F.concat(acc["k"], F.array(x))).otherwise(acc["k"]).alias("k"), free(acc["u"], x).alias("u"))
    kept = F.aggregate("__at", F.struct(F.array().cast("array<bigint>").alias("k"), (start + F.col("state")).alias("u")), step)["k"]
    return entered.select(*keys, F.explode(kept).alias(at))


def matched(pred: DataFrame, truth: DataFrame, keys: Sequence[str], at: str, tol: int, size: int = 64) -> DataFrame:
    """Greedy one-to-one matches per ``keys`` and block of places: ``tp``.

    Every prediction in order takes the first free truth within ``tol``. Free truths that still count
    lie behind the last taken one, so the state is how far that reaches into the next block. Places
    of one kind are distinct.
    """
    keys, size = list(keys), max(size, 4 * tol + 1)
    place, own = F.col(at).cast("bigint"), F.floor(F.col(at) / size)
    offset = F.col(at) % size
    copies = F.array_compact(F.array(own, F.when(offset < tol, own - 1), F.when(offset >= size - tol, own + 1)))
    p = pred.select(*keys, own.alias("__block"), place.alias("__p"), F.lit(None).cast("bigint").alias("__t"))
    t = truth.select(*keys, F.explode(copies).alias("__block"), F.lit(None).cast("bigint").alias("__p"), place.alias("__t"))
    blocks = p.unionByName(t).groupBy(*keys, "__block").agg(F.array_sort(F.collect_set("__p")).alias("__ps"), F.array_sort(F.collect_set("__t")).alias("__ts")).where(F.size("__ps") > 0)
    start = F.col("__block") * size
    none = F.lit(-(2**60)).cast("bigint")

    def fold(s: Column) -> Column:
        """Last taken truth and number of matches of a block entered in state ``s``."""
        def step(acc, x):
            free = F.filter("__ts", lambda t: (t > acc["last"]) & (t >= x - tol) & (t <= x + tol))
            hit = F.array_min(free)
            return F.struct(F.coalesce(hit, acc["last"]).alias("last"), (acc["n"] + hit.isNotNull().cast("bigint")).alias("n"))

        last = F.when(s > 0, start - tol - 1 + s).otherwise(none).cast("bigint")
        return F.aggregate("__ps", F.struct(last.alias("last"), F.lit(0).cast("bigint").alias("n")), step)

    reach = lambda s: F.greatest(F.lit(0).cast("bigint"), fold(s)["last"] - (start + size - tol - 1))
    entered = run_blocks(blocks, keys, "__block", 2 * tol + 1, reach)
    return entered.select(*keys, fold(F.col("state"))["n"].alias("tp"))
