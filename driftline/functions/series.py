"""Series statistics as Spark expressions over a window array (no Python worker).

Arguments are ``array<double>`` columns. Short or degenerate windows give the neutral value
named in each function. ``array_repeat`` feeds per-window constants to ``zip_with`` so they are
computed once per window, not once per element.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _zero() -> Column:
    return F.lit(0.0)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), f), 1)


def with_const(arr: Column, const: Column, f) -> Column:
    """``f(element, const)`` for every element; ``const`` is evaluated once."""
    return F.zip_with(arr, F.array_repeat(const, F.size(arr)), f)


def indexed(arr: Column, f) -> Column:
    """``f(element, zero-based index)`` for every element."""
    return F.transform(arr, lambda x, i: f(x, i))


def diffs(v: Column) -> Column:
    n = F.size(v)
    return F.when(
        n >= 2,
        F.zip_with(
            F.slice(v, F.lit(2), n - 1), F.slice(v, F.lit(1), n - 1), lambda b, a: b - a
        ),
    ).otherwise(F.array().cast("array<double>"))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def mean(arr: Column) -> Column:
    return total(arr) / F.size(arr)


def quantile(arr: Column, q: float) -> Column:
    """Linear-interpolated quantile of an unsorted array."""

    def pick(acc, s):
        h = (F.size(s) - 1) * F.lit(float(q))
        lo = F.floor(h).cast("int")
        a, b = F.element_at(s, lo + 1), F.element_at(s, F.ceil(h).cast("int") + 1)
        return a + (b - a) * (h - lo)

    # The sorted array is the single element of an outer array, so it is sorted once.
    return F.when(
        F.size(arr) > 0, F.aggregate(F.array(F.array_sort(arr)), F.lit(None).cast("double"), pick)
    )


def median(arr: Column) -> Column:
    return quantile(arr, 0.5)


def pop_std(arr: Column) -> Column:
    ss = total(with_const(arr, mean(arr), lambda x, m: (x - m) * (x - m)))
    return F.sqrt(ss / F.size(arr))


# --- change detectors -------------------------------------------------------------------


def robust_z(v: Column, floor: float = 0.05) -> Column:
    """Robustly standardised differences of ``v``; fewer than 8 differences give ``[]``.

    The baseline leaves out the last difference, so a jump cannot widen its own scale.
    """

    def scale(b, m):
        dev = median(F.transform(b, lambda x: F.abs(x - m)))
        core = lambda mad: F.when(
            mad * 1.4826 < 1e-12, F.greatest(pop_std(b), F.lit(1e-9))
        ).otherwise(mad * 1.4826)
        return F.greatest(let(dev, core), F.lit(float(floor)))

    def standardise(d, b, m):
        return let(scale(b, m), lambda s: F.transform(d, lambda x: (x - m) / s))

    def run(d):
        base = F.slice(d, F.lit(1), F.size(d) - 1)
        z = let(base, lambda b: let(median(b), lambda m: standardise(d, b, m)))
        return F.when(F.size(d) >= 8, z).otherwise(F.array().cast("array<double>"))

    return let(diffs(v), run)


def robust_innovations(df: DataFrame, v: str, out: str = "z", floor: float = 0.05) -> DataFrame:
    """Add ``robust_z`` of column ``v`` as ``out``."""
    return df.withColumn(out, robust_z(F.col(v), floor))


def page_cusum(z: Column, k: float = 0.5, h: float = 4.0) -> Column:
    """Two-sided cumulative-sum chart, maximum over h, in [0, 1]. No data: 0."""
    zero = F.struct(_zero().alias("p"), _zero().alias("n"), _zero().alias("m"))

    def step(a, x):
        p = F.greatest(_zero(), a["p"] + x - k)
        n = F.greatest(_zero(), a["n"] - x - k)
        return F.struct(p.alias("p"), n.alias("n"), F.greatest(a["m"], p, n).alias("m"))

    return F.aggregate(z, zero, step, lambda a: clip(a["m"] / h, 0, 1))


def regime_changes(z: Column, k: float = 0.5, h: float = 4.0, refractory: int = 5) -> Column:
    """Alarm episodes of the two-sided chart: reset on alarm, at least ``refractory`` apart."""
    i0 = F.lit(0)
    zero = F.struct(
        _zero().alias("p"), _zero().alias("n"), i0.alias("c"), F.lit(-refractory).alias("last"), i0.alias("i")
    )

    def step(a, x):
        p = F.greatest(_zero(), a["p"] + x - k)
        n = F.greatest(_zero(), a["n"] - x - k)
        hit = ((p >= h) | (n >= h)) & (a["i"] - a["last"] >= refractory)
        return F.struct(
            F.when(hit, _zero()).otherwise(p).alias("p"),
            F.when(hit, _zero()).otherwise(n).alias("n"),
            (a["c"] + hit.cast("int")).alias("c"),
            F.when(hit, a["i"]).otherwise(a["last"]).alias("last"),
            (a["i"] + 1).alias("i"),
        )

    return F.aggregate(z, zero, step, lambda a: a["c"].cast("double"))


def ewma_chart(z: Column, lam: float = 0.2, width: float = 3.0) -> Column:
    """Exponentially weighted chart, largest deviation over its limit, in [0, 1]."""
    limit = width * math.sqrt(lam / (2.0 - lam))
    zero = F.struct(_zero().alias("e"), _zero().alias("m"))

    def step(a, x):
        e = x * lam + a["e"] * (1.0 - lam)
        return F.struct(e.alias("e"), F.greatest(a["m"], F.abs(e)).alias("m"))

    return F.aggregate(z, zero, step, lambda a: clip(a["m"] / limit, 0, 1))


def kalman_gains(n: int, dt: float = 1.0, q_acc: float = 1e-4, r_meas: float = 0.01):
    """Gain vector and innovation variance per step of the constant-acceleration filter.

    They do not depend on the data, so they are computed once and passed as literals.
    """
    f = np.array([[1.0, dt, dt * dt / 2], [0.0, 1.0, dt], [0.0, 0.0, 1.0]])
    g = np.array([dt * dt / 2, dt, 1.0])
    cov = np.eye(3) * 1e-2
    gains = []
    for _ in range(1, n):
        cov = f @ cov @ f.T + q_acc * np.outer(g, g)
        s = max(cov[0, 0] + r_meas, 1e-12)
        k = cov[:, 0] / s
        cov = cov - np.outer(k, cov[0])
        gains.append((float(k[0]), float(k[1]), float(k[2]), float(s)))
    return gains


def kalman_innovation(v: Column, n: int, dt: float = 1.0) -> Column:
    """Largest normalised innovation squared over a window of exactly ``n`` values.

    Fewer than 10 values: 0. Divide by 10.83 (the 99.9 % point of chi-square with one degree of
    freedom) and clip for the score.
    """
    if n < 10:
        return F.lit(0.0)
    gains = F.array(
        *[
            F.struct(
                F.lit(a).alias("k0"), F.lit(b).alias("k1"), F.lit(c).alias("k2"), F.lit(s).alias("s")
            )
            for a, b, c, s in kalman_gains(n, dt)
        ]
    )
    steps = F.zip_with(
        F.slice(v, F.lit(2), F.size(v) - 1),
        gains,
        lambda y, g: F.struct(y.alias("y"), g.alias("g")),
    )
    start = F.struct(
        F.element_at(v, 1).alias("a"), _zero().alias("b"), _zero().alias("c"), _zero().alias("m")
    )

    def step(x, o):
        pred = x["a"] + x["b"] * dt + x["c"] * (0.5 * dt * dt)
        slope = x["b"] + x["c"] * dt
        e = o["y"] - pred
        g = o["g"]
        return F.struct(
            (pred + g["k0"] * e).alias("a"),
            (slope + g["k1"] * e).alias("b"),
            (x["c"] + g["k2"] * e).alias("c"),
            F.greatest(x["m"], e * e / g["s"]).alias("m"),
        )

    return F.aggregate(steps, start, step, lambda x: x["m"])


# --- information measures ---------------------------------------------------------------


def _log2(p: Column) -> Column:
    return F.log2(p)


def shannon_entropy(d: Column, bins: int = 10) -> Column:
    """Entropy in bits of an equal-width histogram of ``d`` (last bin closed)."""
    rng = F.struct(F.array_min(d).alias("lo"), F.array_max(d).alias("hi"))
    codes = with_const(
        d,
        rng,
        lambda x, r: F.when(r["hi"] <= r["lo"], F.lit(0)).otherwise(
            F.least(
                F.floor((x - r["lo"]) / (r["hi"] - r["lo"]) * bins), F.lit(bins - 1).cast("bigint")
            ).cast("int")
        ),
    )
    return _entropy_of_codes(codes, bins)


def _code_counts(codes: Column, n_codes: int) -> Column:
    """Occurrences of each code 0..n_codes-1, as doubles."""
    zero = F.array_repeat(F.lit(0.0), n_codes)
    return F.aggregate(
        codes,
        zero,
        lambda a, c: F.transform(a, lambda x, i: x + F.when(i == c, 1.0).otherwise(0.0)),
    )


def _entropy_of_codes(codes: Column, n_codes: int) -> Column:
    n = F.size(codes).cast("double")
    terms = with_const(
        _code_counts(codes, n_codes),
        n,
        lambda c, m: F.when(c > 0, -(c / m) * _log2(c / m)).otherwise(0.0),
    )
    return F.when(F.size(codes) > 0, total(terms)).otherwise(0.0)


def ordinal_codes(d: Column) -> Column:
    """Rank pattern (0..5) of each run of three values; ties keep their order."""
    n = F.size(d) - 2
    part = lambda s: F.slice(d, F.lit(s), F.greatest(n, F.lit(0)))
    pairs = F.zip_with(part(1), part(2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def code(p, c):
        a, b = p["a"], p["b"]
        return (
            F.when((a <= b) & (b <= c), 0)
            .when((a <= c) & (c < b), 1)
            .when((b < a) & (a <= c), 2)
            .when((b <= c) & (c < a), 3)
            .when((c < a) & (a <= b), 4)
            .otherwise(5)
        )

    return F.zip_with(pairs, part(3), code)


def permutation_entropy(d: Column) -> Column:
    """Entropy of the rank patterns over log2(6). Fewer than three differences: 0."""
    h = _entropy_of_codes(ordinal_codes(d), 6) / math.log2(6)
    return F.when(F.size(d) >= 3, clip(h, 0, 1)).otherwise(0.0)


def jensen_shannon(d: Column) -> Column:
    """Normalised Jensen-Shannon divergence of the rank patterns from uniform."""
    s = 6.0
    u = 1.0 / s
    top = -0.5 * ((s + 1) / s * math.log(s + 1) + math.log(s) - 2 * math.log(2 * s))
    n = (F.size(d) - 2).cast("double")

    def term(c, m):
        p = c / m
        mid = (p + u) / 2
        return F.when(p > 0, p * F.ln(p / mid)).otherwise(0.0) + u * F.ln(F.lit(u) / mid)

    jsd = total(with_const(_code_counts(ordinal_codes(d), 6), n, term)) * 0.5
    return F.when(F.size(d) >= 3, clip(jsd / top, 0, 1)).otherwise(0.0)


def hill_tail(v: Column, q: float = 0.85) -> Column:
    """Tail rank of the last absolute difference above the ``q`` quantile (else 0)."""

    def rank(a, t, logs):
        k, last = F.size(logs), F.element_at(a, -1)
        tail = lambda s: F.when(
            (k >= 3) & (s >= 1e-9) & (last >= t), clip(F.lit(1.0) - F.pow(last / t, -(k / s)), 0, 1)
        ).otherwise(0.0)
        return let(total(logs), tail)

    def above(a, t):
        ok = (F.size(a) >= 14) & t.isNotNull() & (t > 1e-15)
        logs = F.transform(F.filter(a, lambda x: x >= t), lambda x: F.ln(x / t))
        return F.when(ok, let(logs, lambda l: rank(a, t, l))).otherwise(0.0)

    mags = F.transform(diffs(v), lambda x: F.abs(x))
    return let(mags, lambda a: let(quantile(a, q), lambda t: above(a, t)))


def kernel_smooth(v: Column, n: int, bandwidth: float = 1.5) -> Column:
    """Gaussian kernel smoother over the index of an ``n``-value window."""
    w = np.exp(-0.5 * ((np.arange(n)[:, None] - np.arange(n)[None, :]) / bandwidth) ** 2)
    w = w / w.sum(axis=1, keepdims=True)
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in w])
    return F.zip_with(
        rows,
        F.array_repeat(v, n),
        lambda r, y: total(F.zip_with(r, y, lambda a, b: a * b)),
    )


# --- segment line fits ------------------------------------------------------------------


def _profile(d: Column) -> Column:
    """Cumulative sum of the centred array."""
    c = with_const(d, mean(d), lambda x, m: x - m)
    return F.aggregate(
        c,
        F.array().cast("array<double>"),
        lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), _zero()))),
    )


def _line_sse(y: Column, start: int, size: int) -> Column:
    """Residual sum of squares of a straight-line fit to ``size`` values from ``start``."""
    seg = F.slice(y, start + 1, size)
    xm = (size - 1) / 2.0
    sxx = size * (size * size - 1) / 12.0
    acc = F.aggregate(
        F.transform(seg, lambda v, i: F.struct(v.alias("v"), (i - F.lit(xm)).alias("x"))),
        F.struct(_zero().alias("s"), _zero().alias("q"), _zero().alias("xy")),
        lambda a, p: F.struct(
            (a["s"] + p["v"]).alias("s"),
            (a["q"] + p["v"] * p["v"]).alias("q"),
            (a["xy"] + p["x"] * p["v"]).alias("xy"),
        ),
        lambda a: a["q"] - a["s"] * a["s"] / size - a["xy"] * a["xy"] / sxx,
    )
    return F.greatest(acc, _zero())


def dfa_exponent(d: Column, n: int, min_scale: int = 4, frac: float = 0.25) -> Column:
    """Fluctuation exponent of ``n`` differences, in [0, 1].

    Fewer than three usable scales (n below 24) give the neutral 0.5.
    """
    scales = [s for s in range(min_scale, int(n * frac) + 1) if n // s >= 2]
    if n < 11 or len(scales) < 3:
        return F.lit(0.5)
    lx = np.log(np.array(scales, dtype=float))
    wx = (lx - lx.mean()) / ((lx - lx.mean()) ** 2).sum()

    def alpha(_, y):
        out = F.lit(0.0)
        for s, w in zip(scales, wx):
            segs = n // s
            sse = F.lit(0.0)
            for k in range(segs):
                sse = sse + _line_sse(y, k * s, s)
            out = out + F.lit(float(w)) * 0.5 * F.ln(sse / (segs * s))
        return out

    # The profile rides in a one-element array so it is built once.
    raw = F.aggregate(F.array(_profile(d)), F.lit(0.0), alpha)
    return F.when(raw.isNull() | F.isnan(raw), 0.5).otherwise(clip(raw, 0, 1))


# --- evidence fusion --------------------------------------------------------------------


def fuse_evidence(scores: Column, age_hours: Column | None = None, base: float = 0.30) -> Column:
    """Dempster-Shafer fusion of scores in [0, 1] on the frame {normal, anomalous}.

    Stale data raises the ignorance mass: ``clip(base + age / 168 * 0.45, 0, 0.85)``. The conflict
    of a step is measured between the new mass and the mass already combined with it. An empty
    list gives (0, 0.5, 0).
    """
    ig = F.lit(float(base)) if age_hours is None else clip(
        F.lit(float(base)) + age_hours / 168.0 * 0.45, 0.0, 0.85
    )
    ig = F.least(ig, F.lit(0.9))
    masses = with_const(
        scores,
        ig,
        lambda s, g: F.struct(
            ((F.lit(1.0) - clip(s, 0, 1)) * (F.lit(1.0) - g)).alias("n"),
            (clip(s, 0, 1) * (F.lit(1.0) - g)).alias("a"),
            g.alias("t"),
        ),
    )
    start = F.struct(
        _zero().alias("n"), _zero().alias("a"), F.lit(1.0).alias("t"), _zero().alias("k"), F.lit(0).alias("c")
    )

    def merge(m, x):
        clash = m["n"] * x["a"] + m["a"] * x["n"]
        norm = F.lit(1.0) - clash
        dead = norm <= 0
        n = F.when(dead, _zero()).otherwise((m["n"] * x["n"] + m["n"] * x["t"] + m["t"] * x["n"]) / norm)
        a = F.when(dead, _zero()).otherwise((m["a"] * x["a"] + m["a"] * x["t"] + m["t"] * x["a"]) / norm)
        t = F.when(dead, F.lit(1.0)).otherwise(m["t"] * x["t"] / norm)
        step = F.when(m["c"] > 0, x["n"] * a + x["a"] * n).otherwise(_zero())
        return F.struct(
            n.alias("n"), a.alias("a"), t.alias("t"), (m["k"] + step).alias("k"),
            (m["c"] + 1).alias("c"),
        )

    def finish(m):
        empty = m["c"] == 0
        return F.struct(
            F.when(empty, 0.0).otherwise(clip(m["a"], 0, 1)).alias("belief_anomalous"),
            F.when(empty, 0.5).otherwise(clip(m["a"] + m["t"], 0, 1)).alias("plausibility_anomalous"),
            F.when(m["c"] > 1, clip(m["k"] / (m["c"] - 1), 0, 1)).otherwise(0.0).alias("conflict_k"),
        )

    return F.aggregate(masses, start, merge, finish)


def inject_shift(v: Column, delta: Column | float, at: Column | int | None = None) -> Column:
    """Copy of the window with ``delta`` added from index ``at`` (default: the middle) on."""
    n = F.size(v)
    idx = F.floor(n / 2).cast("int") if at is None else (at if isinstance(at, Column) else F.lit(at))
    idx = F.greatest(F.lit(0), F.least(n - 1, idx))
    c = F.struct(
        (F.lit(float(delta)) if not isinstance(delta, Column) else delta).alias("d"), idx.alias("i")
    )
    zipped = with_const(v, c, lambda x, k: F.struct(x.alias("x"), k.alias("k")))
    return F.transform(
        zipped, lambda p, i: p["x"] + F.when(i >= p["k"]["i"], p["k"]["d"]).otherwise(_zero())
    )
