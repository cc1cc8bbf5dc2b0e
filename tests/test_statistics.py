"""Arrow statistics against plain loops, and the expected orderings of the detectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import arrow as A
from driftline.functions import series as S


def walk(seed, n=30, s=0.1):
    return 7000 + np.cumsum(np.random.default_rng(seed).normal(0, s, n))


def test_parse_count_known_string():
    assert A.parse_count("0001101001000101") == 6
    assert A.parse_count("") == 0 and A.parse_count("A") == 1 and A.parse_count("AAAA") == 2


def test_ramp_is_simpler_than_noise():
    ramp, noise = 7000 + 0.5 * np.arange(30), walk(1, 30, 0.5)
    assert A._lz_rate(ramp[None])[0] < A._lz_rate(noise[None])[0]
    assert A._lz_rate(np.ones((1, 3)))[0] == 0.0


def test_spectrum_residual_against_loops():
    y = walk(3, 20)
    n, length = 20, 10
    k = n - length + 1
    x = np.column_stack([y[i : i + length] for i in range(k)])
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    low = (u[:, :3] * s[:3]) @ vt[:3]
    rec = [np.mean([low[i, t - i] for i in range(length) if 0 <= t - i < k]) for t in range(n)]
    res = y - np.array(rec)
    last, energy = A._ssa(y[None])
    assert last[0] == pytest.approx(min(20, abs(res[-1]) / max(res.std(), 1e-9)), rel=1e-6)
    assert energy[0] == pytest.approx(s[0] ** 2 / (s**2).sum())


def test_run_length_against_loops():
    d = np.diff(walk(4, 20))
    h, m = 1 / 30, len(d) + 1
    post, par = [1.0] + [0.0] * (m - 1), [(0.0, 1.0, 1.0, 1.0)] * m

    def pdf(x, p):
        mu, k, a, b = p
        df, sc = 2 * a, math.sqrt(b * (k + 1) / (k * a))
        z = (x - mu) / sc
        lg = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - math.log(sc) - (df + 1) / 2 * math.log1p(z * z / df)
        return math.exp(max(-50.0, min(0.0, lg)))

    for x in d:
        w = [r * pdf(x, p) for r, p in zip(post, par)]
        nll = -math.log(max(sum(w), 1e-12))
        nxt = [sum(w) * h] + [v * (1 - h) for v in w[:-1]]
        post = [v / sum(nxt) for v in nxt]
        grow = lambda p: ((p[1] * p[0] + x) / (p[1] + 1), p[1] + 1, p[2] + 0.5, p[3] + p[1] * (x - p[0]) ** 2 / (2 * (p[1] + 1)))
        par = [grow((0.0, 1.0, 1.0, 1.0))] + [grow(p) for p in par[:-1]]
    prob, ll = A._run_length(walk(4, 20)[None], h)
    assert prob[0] == pytest.approx(sum(post[:4]), rel=1e-6)
    assert ll[0] == pytest.approx(nll, rel=1e-6)


def test_unit_root_separates_noise_from_walks():
    rng = np.random.default_rng(5)
    noise = A.adf_p(rng.normal(size=(40, 120)))
    walks = A.adf_p(np.cumsum(rng.normal(size=(40, 120)), axis=1))
    assert np.median(noise) < 0.01 and np.median(walks) > 0.1
    assert A.adf_p(np.ones((1, 19)))[0] == 0.0
    # 5 % and 1 % critical values of the constant-only distribution.
    assert A.unit_root_p(-2.86) == pytest.approx(0.05, abs=0.003)
    assert A.unit_root_p(-3.43) == pytest.approx(0.01, abs=0.002)


def test_shadow_pair_is_cointegrated():
    a = walk(6, 120)
    b = a + 12 + np.random.default_rng(9).normal(0, 0.08, 120)
    assert A.coint_p(a[None], b[None])[0] < 0.05
    assert A.coint_p(a[None], walk(11, 120)[None])[0] > 0.05
    assert A.coint_p(a[None, :10], b[None, :10])[0] == 1.0
    # 5 % and 1 % critical values for two series.
    assert A.unit_root_p(-3.34, 2) == pytest.approx(0.05, abs=0.003)
    assert A.unit_root_p(-3.90, 2) == pytest.approx(0.01, abs=0.002)
    assert A.dcca(a[None], a[None])[0] == pytest.approx(1.0)


def test_detectors_rise_on_a_jump(spark):
    quiet = walk(8, 30, 0.02)
    jump = quiet + 4.0 * (np.arange(30) >= 18)
    df = spark.createDataFrame([("q", quiet.tolist()), ("j", jump.tolist()), ("s", [1.0, 2.0, 3.0]), ("f", [1.0] * 20)], "k string, v array<double>")
    z = S.robust_innovations(df, "v")
    r = {
        x["k"]: x
        for x in z.select(
            "k", S.page_cusum(F.col("z")).alias("c"), S.ewma_chart(F.col("z")).alias("e"), S.regime_changes(F.col("z")).alias("n"), S.hill_tail(F.col("v")).alias("t")
        ).collect()
    }
    assert r["j"]["c"] > r["q"]["c"] and r["j"]["e"] > r["q"]["e"] and r["j"]["n"] >= 1
    assert r["s"]["c"] == 0.0 and r["f"]["t"] == 0.0


def test_fusion_edges(spark):
    df = spark.createDataFrame(
        [("none", [], 0.0), ("fresh", [0.9], 0.0), ("stale", [0.9], 160.0), ("agree", [0.99] * 3, 0.0)], "k string, s array<double>, age double"
    )
    r = {x["k"]: x["f"] for x in df.select("k", S.fuse_evidence(F.col("s"), F.col("age")).alias("f")).collect()}
    assert (r["none"]["belief_anomalous"], r["none"]["plausibility_anomalous"]) == (0.0, 0.5)
    assert r["stale"]["belief_anomalous"] < r["fresh"]["belief_anomalous"]
    assert r["stale"]["plausibility_anomalous"] >= r["fresh"]["plausibility_anomalous"]
    assert r["agree"]["belief_anomalous"] > 0.5


def test_typicality_identity_and_outlier(spark):
    from driftline.operators.typicality import _Reference, typicality

    rng = np.random.default_rng(2)
    ref = rng.normal(size=(30, 4))
    m = _Reference(ref)
    x = rng.normal(size=(1, 4))
    pool = np.vstack([m.z, (x - m.mu) / m.sd])
    k = np.exp(-m.gamma * ((pool[:, None] - pool[None]) ** 2).sum(-1))

    def mmd2(j):
        a = [i for i in range(31) if i != j]
        return k[np.ix_(a, a)].mean() + 1.0 - 2 * k[np.ix_(a, [j])].mean()

    stats = np.array([mmd2(j) for j in range(31)])
    t, s = m.score(x)
    assert s[0] == pytest.approx(stats[30], abs=1e-9)
    assert t[0] == pytest.approx(1 - (stats >= stats[30] - 1e-12).mean())
    far = ref.copy()
    far[0, 0] += 6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(far)], "id long, x array<double>")
    out = {r["id"]: r["mmd_stat"] for r in typicality(df, "id", "x", 4).collect()}
    assert max(out, key=out.get) == 0


def test_exact_rank_p_values():
    from driftline.operators.calibration import upper_p

    assert upper_p(5, 7, 35, 0) == pytest.approx(1 / math.comb(12, 5))
    assert upper_p(11, 7, 64, 0) == pytest.approx(325 / math.comb(18, 7))


def test_lag_order_from_one_triangle_is_that_of_single_fits():
    """Every lag's design was factored anew."""
    rng = np.random.default_rng(9)
    calls = []
    for constant in (False, True):
        for n in (21, 40, 66):
            x = rng.normal(size=(20, n)).cumsum(axis=1)
            got, extra = A.unit_root_stat(x, constant), int(constant)
            most = min(n // 2 - extra - 1, int(np.ceil(12.0 * (n / 100.0) ** 0.25)))
            for row, stat in zip(x, got):
                d = np.diff(row)

                def fit(lag, start):
                    at = np.arange(start, len(d))
                    m = np.stack([row[at], *[d[at - j] for j in range(1, lag + 1)], *([np.ones(len(at))] if constant else [])], axis=1)
                    b, *_ = np.linalg.lstsq(m, d[at], rcond=None)
                    return m, b, ((d[at] - m @ b) ** 2).sum()

                aic = [(len(d) - most) * np.log(fit(k, most)[2]) + 2 * k for k in range(most + 1)]
                m, b, ssr = fit(int(np.argmin(aic)), int(np.argmin(aic)))
                assert stat == pytest.approx(b[0] / np.sqrt(np.linalg.inv(m.T @ m)[0, 0] * ssr / (len(m) - m.shape[1])), rel=1e-6)
            calls.append(_factored(x, constant))
    assert max(calls) == 2  # one for all lags, one for the chosen lag


def _factored(x, constant):
    """Factorings that one row takes."""
    real, seen = np.linalg.qr, []
    np.linalg.qr = lambda m, *a, **k: seen.append(len(m)) or real(m, *a, **k)
    try:
        A.unit_root_stat(x[:1], constant)
    finally:
        np.linalg.qr = real
    return len(seen)
