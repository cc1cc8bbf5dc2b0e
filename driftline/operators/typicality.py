"""Kernel two-sample typicality of vectors against all rows of a reference set.

The work is rows times reference rows. Both are packed into written blocks; the cartesian product sets
every row block against every reference block, which is read again and never shuffled, and a task adds
up the parts of a block before they move. No vectors pass through the driver, which gets sums and
histograms only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import materialize

#: Rows of one block, and rows of it that are set against the other block in one step, which stays in a core's cache.
BLOCK, STEP = 2048, 64
BINS = 4096
#: Rows whose distances bracket the median of all before those are looked at, share of them on either side, and bins of the bracket.
SAMPLE_ROWS, MARGIN, FINE_BINS = 8192, 0.03, 65536


class _Reference:
    """The plain form for a reference in one array: standardised rows, kernel scale and row sums."""

    def __init__(self, m: np.ndarray):
        self.mu, self.sd = m.mean(axis=0), m.std(axis=0)
        self.sd[self.sd < 1e-12] = 1.0
        self.z = (m - self.mu) / self.sd
        d2 = self.sq(self.z)
        med = np.median(d2[d2 > 0]) if (d2 > 0).any() else 1.0
        self.gamma = 1.0 / max(float(med), 1e-12)
        k = np.exp(-self.gamma * d2)
        self.rows, self.total = k.sum(axis=1), k.sum()

    def sq(self, x: np.ndarray) -> np.ndarray:
        g = (x**2).sum(axis=1)[:, None] + (self.z**2).sum(axis=1)[None, :] - 2 * x @ self.z.T
        return np.maximum(g, 0.0) if x is not self.z else np.maximum(g - np.diag(np.diag(g)), 0.0)

    def score(self, x: np.ndarray):
        """Exact permutation p over the n+1 choices of the single-row sample."""
        n = len(self.z)
        k = np.exp(-self.gamma * self.sq((x - self.mu) / self.sd))
        kx = k.sum(axis=1)
        pooled = (self.total + 2 * kx + 1)[:, None]
        own = (kx + 1)[:, None]
        r = np.concatenate([self.rows[None, :] + k, own], axis=1)
        stat = (pooled - 2 * r + 1) / n**2 + 1 - 2 * (r - 1) / n
        mine = stat[:, -1:]
        p = (stat >= mine - 1e-12).sum(axis=1) / (n + 1)
        return np.clip(1 - p, 0, 1), np.maximum(mine[:, 0], 0)


def _gaps(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Squared distances; equal rows are 0 whatever the rounding."""
    g = (x**2).sum(axis=1)[:, None] + (z**2).sum(axis=1)[None, :] - 2 * x @ z.T
    g[g < 1e-12 * x.shape[1]] = 0.0
    return g


def _vectors(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    return np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), dim)


def _total(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of the arrays in column ``part``, in two levels: the driver gets the root of the number of tasks."""

    def add(batches):
        out = np.zeros(size)
        for batch in batches:
            for v in batch.column(0):
                out += np.frombuffer(v.as_py(), float)
        yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["part"])

    tasks = max(1, math.isqrt(parts.rdd.getNumPartitions()))
    once = parts.select("part").mapInArrow(add, "part binary").repartition(tasks).mapInArrow(add, "part binary")
    return sum((np.frombuffer(bytes(r[0]), float) for r in once.collect()), np.zeros(size))


def _summed(df: DataFrame, f: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """``f`` of every batch of rows, summed."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"part": [np.asarray(f(pdf), float).tobytes()]})

    return _total(df.mapInPandas(run, "part binary"), size)


def _blocks(z: DataFrame, n: int, label: str) -> DataFrame:
    """Rows packed into written blocks of at most ``BLOCK``: ``rows``, ``z`` and, where there are sums, ``k``."""
    kinds = {"rows": np.int64} | ({"k": np.float64} if "k" in z.columns else {})

    def pack(batches):
        def block(t: pa.Table) -> pa.RecordBatch:
            cols = {name: t.column("__row" if name == "rows" else name).to_numpy().astype(kind).tobytes() for name, kind in kinds.items()}
            cols["z"] = b"".join(v.as_py() for v in t.column("z"))
            return pa.RecordBatch.from_pydict({c: pa.array([v], pa.binary()) for c, v in cols.items()})

        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            while size >= BLOCK:
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, BLOCK))
                held, size = t.slice(BLOCK).to_batches(), size - BLOCK
        if size:
            yield block(pa.Table.from_batches(held))

    schema = ", ".join(f"{c} binary" for c in [*kinds, "z"])
    return materialize(z.select("__row", "z", *[c for c in kinds if c == "k"]).coalesce(max(1, -(-n // BLOCK))).mapInArrow(pack, schema), label)


class _Block:
    def __init__(self, rows: bytes, z: bytes, k: bytes | None, dim: int):
        self.rows, self.z = np.frombuffer(rows, np.int64), np.frombuffer(z, float).reshape(-1, dim)
        self.k = None if k is None else np.frombuffer(k, float)

    @cached_property
    def left(self) -> np.ndarray:
        """Rows whose products with the ``right`` ones of a block are the squared distances."""
        return np.hstack([-2.0 * self.z, (self.z**2).sum(axis=1)[:, None], np.ones((len(self.z), 1))])

    @cached_property
    def right(self) -> np.ndarray:
        return np.hstack([self.z, np.ones((len(self.z), 1)), (self.z**2).sum(axis=1)[:, None]]).T.copy()


def _read(batches, dim: int):
    """Left and right blocks of a task, all of a left block in a row."""
    last = None
    for batch in batches:
        cols = {c: batch.column(c) for c in batch.schema.names}
        for i in range(batch.num_rows):
            at = {c: v[i].as_py() for c, v in cols.items()}
            if last is None or last[0] != at["l_rows"]:
                last = at["l_rows"], _Block(at["l_rows"], at["l_z"], at.get("l_k"), dim)
            yield last[1], _Block(at["r_rows"], at["r_z"], at.get("r_k"), dim)


class _Pairs:
    """Every row block against every reference block."""

    def __init__(self, rows: DataFrame, ref: DataFrame, dim: int):
        self.dim, sums = dim, "k" in rows.columns
        named = lambda d, side: d.select(*[d[c].alias(f"{side}_{c}") for c in ("rows", "z", *(["k"] if sums else []))])
        # The product of partitions: the reference is read by every task and never shuffled or broadcast.
        self.pairs = named(rows, "l").hint("shuffle_replicate_nl").crossJoin(named(ref, "r"))

    def sums(self, f: Callable[[_Block, _Block], np.ndarray], name: str, kind: str) -> DataFrame:
        """``f`` of every left row, added up over the right blocks."""
        dim = self.dim

        def run(batches):
            out = lambda b, v: pa.record_batch([pa.array(b.rows), pa.array(v)], names=["__row", name])
            block, total = None, None
            for left, right in _read(batches, dim):
                part = f(left, right)
                if block is not left:
                    if block is not None:
                        yield out(block, total)
                    block, total = left, part
                else:
                    total = total + part
            if block is not None:
                yield out(block, total)

        return self.pairs.mapInArrow(run, f"__row long, {name} {kind}").groupBy("__row").agg(F.sum(name).alias(name))

    def own_sums(self, f: Callable[[_Block, _Block], tuple[np.ndarray, np.ndarray]], name: str) -> DataFrame:
        """``f`` of both rows of a pair, of a set to itself: a pair of blocks is looked at once and adds to both."""
        dim = self.dim

        def run(batches):
            out = lambda b, v: pa.record_batch([pa.array(b.rows), pa.array(v)], names=["__row", name])
            block, total, others = None, None, {}
            for left, right in _read(batches, dim):
                if left.rows[0] > right.rows[0]:
                    continue
                mine, its = f(left, right)
                if block is not left:
                    if block is not None:
                        yield out(block, total)
                    block, total = left, np.zeros(len(left.rows))
                total = total + mine
                if left.rows[0] < right.rows[0]:
                    held = others.setdefault(int(right.rows[0]), (right, np.zeros(len(right.rows))))
                    np.add(held[1], its, out=held[1])
            if block is not None:
                yield out(block, total)
            for b, v in others.values():
                yield out(b, v)

        return self.pairs.mapInArrow(run, f"__row long, {name} double").groupBy("__row").agg(F.sum(name).alias(name))

    def total(self, f: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """``f`` of all squared distances of a set to itself, summed: a pair of blocks is looked at once and counts twice."""
        dim = self.dim

        def run(batches):
            out = np.zeros(size)
            for left, right in _read(batches, dim):
                if left.rows[0] <= right.rows[0]:
                    for _, g in _stepwise(left, right):
                        out += f(g) * (1 if left.rows[0] == right.rows[0] else 2)
            yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["part"])

        return _total(self.pairs.mapInArrow(run, "part binary"), size)


def _stepwise(left: _Block, right: _Block):
    """Squared distances step by step: first row of the step, rows x reference rows. Equal rows are nearly 0; a step's array is used again."""
    held = np.empty((min(STEP, len(left.z)), len(right.z)))
    for i in range(0, len(left.z), STEP):
        rows = left.left[i : i + STEP]
        yield i, np.matmul(rows, right.right, out=held[: len(rows)])


def _quantile_gap(pairs: _Pairs, high: float, shares: Sequence[float]) -> tuple[list[float], int]:
    """Exact values at shares of the squared distances above zero, by histograms of ever narrower brackets, and their number."""
    least = 1e-12 * pairs.dim

    def histogram(low: float, high: float) -> np.ndarray:
        width = (high - low) / BINS

        def count(g: np.ndarray) -> np.ndarray:
            v = g[(g >= max(low, least)) & (g < high)]
            return np.bincount(np.minimum(((v - low) / width).astype(np.int64), BINS - 1), minlength=BINS)

        return pairs.total(count, BINS)

    def find(ranks: set, low: float, high: float, below: int, bins: np.ndarray) -> dict:
        ends, width = below + np.cumsum(bins).astype(np.int64), (high - low) / BINS
        at = {r: min(int(np.searchsorted(ends, r, side="right")), BINS - 1) for r in ranks}
        # Bins narrower than this hold one value but for rounding.
        if width < 1e-9 * high:
            return {r: low + (i + 0.5) * width for r, i in at.items()}
        out = {}
        for i in set(at.values()):
            a, z = low + i * width, low + (i + 1) * width
            out |= find({r for r in ranks if at[r] == i}, a, z, int(ends[i - 1]) if i else below, histogram(a, z))
        return out

    bins = histogram(0.0, high)
    count = int(bins.sum())
    if not count:
        return [], 0
    ranks = [min(max(int(share * (count - 1)), 0), count - 1) for share in shares]
    ends = [((count - 1) // 2, count // 2) if share == 0.5 else (rank,) for share, rank in zip(shares, ranks)]
    at = find({r for e in ends for r in e}, 0.0, high, 0, bins)
    return [float(np.mean([at[r] for r in e])) for e in ends], count


def _median_gap(pairs: _Pairs, high: float, n: int, sample: _Pairs | None) -> float:
    """Exact median of the squared distances above zero.

    Those of a ``sample`` bracket it: the others are counted below the bracket or not looked at, and the
    bracket is told apart in fine bins. A median outside of it is looked for among all.
    """
    least = 1e-12 * pairs.dim

    def within(low: float, high: float) -> tuple[int, int, np.ndarray]:
        width = (high - low) / FINE_BINS

        def count(g: np.ndarray) -> np.ndarray:
            v = g[(g >= low) & (g < high)]
            bins = np.bincount(np.minimum(((v - low) / width).astype(np.int64), FINE_BINS - 1), minlength=FINE_BINS)
            return np.concatenate([[np.count_nonzero(g < least), np.count_nonzero(g < low)], bins])

        zero, below, *bins = pairs.total(count, FINE_BINS + 2).astype(np.int64)
        return zero, below - zero, np.array(bins)

    if sample is not None:
        low, top = _bracket(sample, high)
        while top > low:
            zero, below, bins = within(low, top)
            count, ends = n * n - zero, below + np.cumsum(bins)
            at = [int(np.searchsorted(ends, r, side="right")) for r in ((count - 1) // 2, count // 2)]
            if (count - 1) // 2 < below or at[1] >= FINE_BINS:
                break
            width = (top - low) / FINE_BINS
            if width < 1e-9 * top:
                return low + (sum(at) / 2 + 0.5) * width
            low, top = low + at[0] * width, low + (at[1] + 1) * width
    found, count = _quantile_gap(pairs, high, (0.5,))
    return found[0] if count else 1.0


def _bracket(sample: _Pairs, high: float) -> tuple[float, float]:
    found, count = _quantile_gap(sample, high, (0.5 - MARGIN, 0.5 + MARGIN))
    return (max(found[0], 2e-12 * sample.dim), found[1]) if count else (0.0, 0.0)


def _kernel_sums(pairs: _Pairs, gamma: float) -> DataFrame:
    """Sum ``k`` of the kernel of every row with all reference rows."""

    def part(left: _Block, right: _Block) -> np.ndarray:
        return np.concatenate([_kernel(g, gamma).sum(axis=1) for _, g in _stepwise(left, right)])

    return pairs.sums(part, "k", "double")


def _own_kernel_sums(pairs: _Pairs, gamma: float) -> DataFrame:
    """``_kernel_sums`` of a set with itself."""

    def part(left: _Block, right: _Block) -> tuple[np.ndarray, np.ndarray]:
        mine, its = [], np.zeros(len(right.z))
        for _, g in _stepwise(left, right):
            k = _kernel(g, gamma)
            mine.append(k.sum(axis=1))
            its += k.sum(axis=0)
        return np.concatenate(mine), its

    return pairs.own_sums(part, "k")


def _kernel(g: np.ndarray, gamma: float) -> np.ndarray:
    """Kernel of squared distances, in their place."""
    np.multiply(g, -gamma, out=g)
    return np.exp(g, out=g)


def _no_less(pairs: _Pairs, gamma: float, slack: float) -> DataFrame:
    """Reference rows ``c`` whose statistic in the pool is no less than the row's own.

    That is so if a reference row's kernel sum with the pool is no more than the row's; one kernel value
    lies in [0, 1], so only reference rows whose sums ``k`` are within one of the row's are looked at.
    """

    def part(left: _Block, right: _Block) -> np.ndarray:
        c, most = np.zeros(len(left.rows), np.int64), left.k + 1 + slack
        order, mine = np.argsort(right.k, kind="stable"), np.argsort(most, kind="stable")
        z, total = right.z[order], right.k[order]
        for i in range(0, len(mine), STEP):
            at = mine[i : i + STEP]
            own = most[at]
            low, high = np.searchsorted(total, own[0] - 1), np.searchsorted(total, own[-1], side="right")
            k = np.exp(-gamma * _gaps(left.z[at], z[low:high])) + total[None, low:high]
            c[at] = low + (k <= own[:, None]).sum(axis=1)
        return c

    return pairs.sums(part, "c", "long")


def typicality(df: DataFrame, key: str | Sequence[str], vector: str, dim: int, reference: DataFrame | None = None) -> DataFrame:
    """``key``, ``typicality`` (1 - exact p over the n+1 choices) and ``mmd_stat``; under three reference rows (0.5, 0).

    ``reference`` has ``vector`` in all rows that are normal; by default they are the rows of ``df``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    numbered = lambda d, *c: d.select(*c, F.col(vector).alias("x"), F.monotonically_increasing_id().alias("__row"))
    rows = materialize(numbered(df, *keys), "typicality-rows")
    ref = rows.select("x", "__row") if reference is None else materialize(numbered(reference), "typicality-reference")
    n = ref.count()
    if n < 3:
        return rows.select(*keys, F.lit(0.5).alias("typicality"), F.lit(0.0).alias("mmd_stat"))
    mu = _summed(ref, lambda pdf: _vectors(pdf, dim).sum(axis=0), dim) / n
    sd = np.sqrt(_summed(ref, lambda pdf: ((_vectors(pdf, dim) - mu) ** 2).sum(axis=0), dim) / n)
    sd[sd < 1e-12] = 1.0

    def scaled(batches):
        for pdf in batches:
            z = (_vectors(pdf, dim) - mu) / sd
            yield pd.DataFrame({"__row": pdf["__row"], "z": [v.tobytes() for v in z], "size": (z * z).sum(axis=1)})

    scale = lambda d, label: materialize(d.select("__row", "x").mapInPandas(scaled, "__row long, z binary, size double"), label)
    ref_z = scale(ref, "typicality-z")
    rows_z = ref_z if reference is None else scale(rows, "typicality-x")
    n_rows = n if reference is None else rows.count()
    ref_b = _blocks(ref_z, n, "typicality-reference-blocks")
    rows_b = ref_b if reference is None else _blocks(rows_z, n_rows, "typicality-row-blocks")
    within = _Pairs(ref_b, ref_b, dim)
    # No squared distance exceeds four times the largest squared norm.
    high = 4.0 * float(ref_z.agg(F.max("size")).first()[0]) + 1.0
    sample = None
    if n > 2 * SAMPLE_ROWS:
        # Lowest bits of a hash, so the same rows are drawn whatever the partitions.
        drawn = ref_z.where(F.pmod(F.xxhash64("z"), F.lit(n // SAMPLE_ROWS)) == 0)
        blocks = _blocks(drawn, SAMPLE_ROWS, "typicality-sample-blocks")
        sample = _Pairs(blocks, blocks, dim)
    gamma = 1.0 / max(_median_gap(within, high, n, sample), 1e-12)
    ref_k = materialize(_own_kernel_sums(within, gamma), "typicality-sums")
    row_k = ref_k if reference is None else materialize(_kernel_sums(_Pairs(rows_b, ref_b, dim), gamma), "typicality-row-sums")
    with_sums = lambda z, k, m, label: _blocks(z.select("__row", "z").join(k, "__row"), m, label)
    ref_s = with_sums(ref_z, ref_k, n, "typicality-reference-scored")
    scored = _Pairs(ref_s if reference is None else with_sums(rows_z, row_k, n_rows, "typicality-scored"), ref_s, dim)
    counts = _no_less(scored, gamma, 1e-12 / (2 / n**2 + 2 / n))
    total = float(ref_k.agg(F.sum("k")).first()[0])
    own = F.col("k") + 1
    stat = (F.lit(total) + 2 * F.col("k") + 1 - 2 * own + 1) / float(n) ** 2 + 1 - 2 * (own - 1) / n
    out = rows.select(*keys, "__row").join(row_k, "__row").join(counts, "__row")
    return out.select(*keys, F.greatest(F.lit(0.0), 1 - (F.col("c") + 1) / (n + 1)).alias("typicality"), F.greatest(stat, F.lit(0.0)).alias("mmd_stat"))
