"""Series statistics over 20-row windows of every entity."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import arrow as A
from driftline.functions import series as S
from driftline.plans.inputs import D20_SQL, EV_SQL, W20_SQL, Z20_SQL, events, windows20
from driftline.plans.registry import query

KEYS = ("user_id", "pos")


def r6(c):
    return F.round(c, 6)


@query(
    "i1_shannon_entropy",
    f"""WITH {D20_SQL},
    e AS (SELECT user_id, pos, unnest(d) AS x, list_min(d) AS lo, list_max(d) AS hi FROM wd),
    b AS (SELECT user_id, pos, CASE WHEN hi <= lo THEN 0
            ELSE least(floor((x-lo)/(hi-lo)*10), 9) END AS bin FROM e),
    c AS (SELECT user_id, pos, bin, count(*)/19.0::DOUBLE AS p FROM b GROUP BY ALL)
    SELECT user_id, pos, round(sum(-p*log2(p)), 6) AS entropy FROM c GROUP BY ALL""",
)
def i1(spark, sf):
    w = windows20(spark, sf)
    return w.select(*KEYS, S.diffs(F.col("v")).alias("d")).select(
        *KEYS, r6(S.shannon_entropy(F.col("d"))).alias("entropy")
    )


@query("i2_parse_complexity")
def i2(spark, sf):
    return windows20(spark, sf).select(*KEYS, A.lz_complexity("v").alias("lz"))


DFA_SQL = """WITH ev AS (
  SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos
  FROM events),
w AS (SELECT user_id, pos, list(value) OVER (PARTITION BY user_id ORDER BY pos ROWS 29 PRECEDING) AS v FROM ev),
wd AS (SELECT user_id, pos, list_transform(range(1, 30), lambda i: v[i+1] - v[i]) AS d FROM w
       WHERE pos >= 30 AND (pos - 30) % 5 = 0),
x AS (SELECT user_id, pos, unnest(d) AS dv, unnest(range(0, 29)) AS i, list_avg(d) AS m FROM wd),
y AS (SELECT user_id, pos, i, sum(dv - m) OVER (PARTITION BY user_id, pos ORDER BY i) AS y FROM x),
sc AS (SELECT unnest([4,5,6,7]) AS s),
seg AS (SELECT user_id, pos, s, i // s AS k,
          regr_syy(y, i % s) - regr_sxy(y, i % s)*regr_sxy(y, i % s)/regr_sxx(y, i % s) AS sse
        FROM y, sc WHERE i < (29 // s)*s GROUP BY ALL),
f AS (SELECT user_id, pos, s, sqrt(sum(sse)/any_value((29 // s)*s)) AS fl FROM seg GROUP BY user_id, pos, s)
SELECT user_id, pos, round(least(1, greatest(0, regr_slope(ln(fl), ln(s)))), 5) AS alpha FROM f GROUP BY ALL"""


@query("i3_fluctuation_exponent", DFA_SQL)
def i3(spark, sf):
    from driftline.operators.windows import sliding_windows

    w = sliding_windows(events(spark, sf), "user_id", "ts", ["value"], ["event_id"], size=30, step=5)
    return w.select(*KEYS, S.diffs(F.col("value_w")).alias("d")).select(
        *KEYS, F.round(S.dfa_exponent(F.col("d"), 29), 5).alias("alpha")
    )


@query(
    "i4_cloud_topology",
    """WITH ev AS (SELECT user_id, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
    el AS (SELECT user_id, 20 - r AS i, 6900.0::DOUBLE + (user_id % 40)*12.5::DOUBLE + value/50 AS a,
           radians(40.0::DOUBLE + (user_id % 11)*5.0::DOUBLE + value/1000) AS inc,
           radians((user_id*37) % 360) AS o, 0.001::DOUBLE + (event_id % 10)/10000.0::DOUBLE AS e,
           radians((20 - r)*360.0::DOUBLE/19) AS nu FROM ev WHERE r <= 20),
    p AS (SELECT user_id, i, a*(1-e*e)/(1+e*cos(nu)) AS rr, nu, inc, o FROM el),
    c AS (SELECT user_id, i, cos(o)*rr*cos(nu) - sin(o)*cos(inc)*rr*sin(nu) AS x,
           sin(o)*rr*cos(nu) + cos(o)*cos(inc)*rr*sin(nu) AS y, sin(inc)*rr*sin(nu) AS z FROM p),
    m AS (SELECT *, x - avg(x) OVER w AS cx, y - avg(y) OVER w AS cy, z - avg(z) OVER w AS cz
          FROM c WINDOW w AS (PARTITION BY user_id)),
    s AS (SELECT *, avg(sqrt(cx*cx+cy*cy+cz*cz)) OVER (PARTITION BY user_id) AS sc FROM m),
    d AS (SELECT a.user_id, sqrt((a.cx-b.cx)**2+(a.cy-b.cy)**2+(a.cz-b.cz)**2)/a.sc AS d
          FROM s a JOIN s b ON a.user_id = b.user_id AND a.i < b.i)
    SELECT user_id, round(quantile_cont(d, 0.1), 6) AS h0,
           round(least(5, quantile_cont(d, 0.75) - quantile_cont(d, 0.25)), 6) AS h1
    FROM d GROUP BY user_id HAVING count(*) = 190""",
)
def i4(spark, sf):
    from driftline.operators.pairs import cloud_topology
    from driftline.operators.windows import latest_windows
    from driftline.plans.inputs import elements

    w = latest_windows(
        elements(spark, sf), "norad_id", "ts", ["sma", "inc", "raan", "ecc"], ["event_id"]
    )
    t = cloud_topology(F.col("sma_w"), F.col("inc_w"), F.col("raan_w"), F.col("ecc_w"), 20)
    return w.select(F.col("norad_id").alias("user_id"), t.alias("t")).select(
        "user_id", r6("t.h0").alias("h0"), r6("t.h1").alias("h1")
    )


@query("i5_kernel_typicality")
def i5(spark, sf):
    from driftline.operators.typicality import typicality
    from driftline.session import table

    emb = table(spark, sf, "embeddings")
    return typicality(
        emb.select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "vec_id", "x", 64
    ).select("vec_id", r6("typicality").alias("typicality"), r6("mmd_stat").alias("mmd_stat"))


@query(
    "i6_robust_innovations",
    f"WITH {Z20_SQL} SELECT user_id, pos, round(sigma, 6) AS sigma_ref, round(z[19], 6) AS z_last, "
    "round(list_aggregate(z, 'max'), 6) AS z_max FROM zz",
)
def i6(spark, sf):
    w = S.robust_innovations(windows20(spark, sf), "v")
    # sigma is recovered from two standardised differences of the window.
    d = S.diffs(F.col("v"))
    w = w.withColumn("d", d).withColumn("hi", F.array_max("d")).withColumn("lo", F.array_min("d"))
    return w.select(
        *KEYS,
        r6((F.col("hi") - F.col("lo")) / (F.array_max("z") - F.array_min("z"))).alias("sigma_ref"),
        r6(F.element_at("z", -1)).alias("z_last"),
        r6(F.array_max("z")).alias("z_max"),
    )


def _z(spark, sf):
    return S.robust_innovations(windows20(spark, sf), "v")


CUSUM_SQL = f"""WITH {Z20_SQL},
  x AS (SELECT user_id, pos, unnest(z) AS z, unnest(range(1, 20)) AS i FROM zz),
  p AS (SELECT user_id, pos, i, sum(z - 0.5) OVER w AS up, sum(-z - 0.5) OVER w AS dn
        FROM x WINDOW w AS (PARTITION BY user_id, pos ORDER BY i)),
  s AS (SELECT user_id, pos, up - least(0, min(up) OVER w) AS sp, dn - least(0, min(dn) OVER w) AS sn
        FROM p WINDOW w AS (PARTITION BY user_id, pos ORDER BY i))
  SELECT user_id, pos, round(least(1, greatest(max(sp), max(sn))/4), 6) AS cusum FROM s GROUP BY ALL"""


@query("i7_page_cusum", CUSUM_SQL)
def i7(spark, sf):
    return _z(spark, sf).select(*KEYS, r6(S.page_cusum(F.col("z"))).alias("cusum"))


@query(
    "i8_regime_changes",
    f"""WITH RECURSIVE {Z20_SQL},
  r AS (SELECT user_id, pos, z, 0 AS i, 0.0::DOUBLE AS sp, 0.0::DOUBLE AS sn, 0 AS c, -5 AS last FROM zz
    UNION ALL
    SELECT user_id, pos, z, i+1,
      CASE WHEN hit THEN 0 ELSE np END, CASE WHEN hit THEN 0 ELSE nn END,
      c + hit::INT, CASE WHEN hit THEN i ELSE last END
    FROM (SELECT *, (np >= 4 OR nn >= 4) AND i - last >= 5 AS hit FROM
      (SELECT *, greatest(0, sp + z[i+1] - 0.5) AS np, greatest(0, sn - z[i+1] - 0.5) AS nn FROM r WHERE i < 19)))
  SELECT user_id, pos, c::DOUBLE AS changes FROM r WHERE i = 19""",
)
def i8(spark, sf):
    return _z(spark, sf).select(*KEYS, S.regime_changes(F.col("z")).alias("changes"))


@query(
    "i9_ewma_chart",
    f"""WITH {Z20_SQL},
  x AS (SELECT user_id, pos, unnest(z) AS z, unnest(range(1, 20)) AS i FROM zz),
  e AS (SELECT user_id, pos, 0.2*pow(0.8, i)*sum(z*pow(0.8, -i)) OVER (PARTITION BY user_id, pos ORDER BY i) AS e
        FROM x)
  SELECT user_id, pos, round(least(1, max(abs(e))/(3*sqrt(0.2::DOUBLE/1.8))), 6) AS ewma FROM e GROUP BY ALL""",
)
def i9(spark, sf):
    return _z(spark, sf).select(*KEYS, r6(S.ewma_chart(F.col("z"))).alias("ewma"))


ORD_SQL = D20_SQL + """, tr AS (
  SELECT user_id, pos, unnest(d[1:17]) AS a, unnest(d[2:18]) AS b, unnest(d[3:19]) AS c FROM wd),
oc AS (SELECT user_id, pos, CASE WHEN a<=b AND b<=c THEN 0 WHEN a<=c AND c<b THEN 1 WHEN b<a AND a<=c THEN 2
   WHEN b<=c AND c<a THEN 3 WHEN c<a AND a<=b THEN 4 ELSE 5 END AS code FROM tr),
pr AS (SELECT user_id, pos, code, count(*)/17.0::DOUBLE AS p FROM oc GROUP BY ALL)"""


@query(
    "i10_permutation_entropy",
    f"""WITH {ORD_SQL} SELECT user_id, pos, round(greatest(0, least(1, sum(-p*log2(p))/log2(6))), 6) AS pe
    FROM pr GROUP BY ALL""",
)
def i10(spark, sf):
    return windows20(spark, sf).select(*KEYS, S.diffs(F.col("v")).alias("d")).select(
        *KEYS, r6(S.permutation_entropy(F.col("d"))).alias("pe")
    )


@query(
    "i11_jensen_shannon",
    f"""WITH {ORD_SQL},
    g AS (SELECT k.user_id, k.pos, coalesce(p, 0) AS p FROM
       (SELECT user_id, pos, unnest(range(0, 6)) AS code FROM wd) k LEFT JOIN pr USING (user_id, pos, code))
    SELECT user_id, pos, round(0.5*sum(CASE WHEN p > 0 THEN p*ln(p/((p+1/6.0::DOUBLE)/2)) ELSE 0 END
       + 1/6.0::DOUBLE*ln(1/6.0::DOUBLE/((p+1/6.0::DOUBLE)/2)))
       / (-0.5*(7/6.0::DOUBLE*ln(7.0::DOUBLE)+ln(6.0::DOUBLE)-2*ln(12.0::DOUBLE))), 6) AS jsd
    FROM g GROUP BY ALL""",
)
def i11(spark, sf):
    return windows20(spark, sf).select(*KEYS, S.diffs(F.col("v")).alias("d")).select(
        *KEYS, r6(S.jensen_shannon(F.col("d"))).alias("jsd")
    )


@query("i12_spectrum_residual")
def i12(spark, sf):
    return windows20(spark, sf).select(*KEYS, A.ssa_residual("v").alias("s")).select(
        *KEYS, "s.last_residual", "s.energy_ratio"
    )


@query("i13_run_length_change")
def i13(spark, sf):
    return windows20(spark, sf).select(*KEYS, A.run_length_change("v").alias("s")).select(
        *KEYS, "s.change_prob", "s.pred_ll"
    )


@query(
    "i14_tail_rank",
    f"""WITH {D20_SQL},
    a AS (SELECT user_id, pos, list_transform(d, lambda x: abs(x)) AS a FROM wd),
    t AS (SELECT *, list_aggregate(a, 'quantile_cont', 0.85)::DOUBLE AS thr FROM a),
    l AS (SELECT *, list_filter(a, lambda x: x >= thr) AS tail FROM t),
    s AS (SELECT *, len(tail) AS k, CASE WHEN thr > 1e-15 THEN
            list_sum(list_transform(tail, lambda x: ln(x/thr))) END AS s FROM l)
    SELECT user_id, pos, round(CASE WHEN thr > 1e-15 AND k >= 3 AND s >= 1e-9 AND a[19] >= thr
       THEN greatest(0, least(1, 1 - pow(a[19]/thr, -(k/s)))) ELSE 0 END, 6) AS tail FROM s""",
)
def i14(spark, sf):
    return windows20(spark, sf).select(*KEYS, r6(S.hill_tail(F.col("v"))).alias("tail"))


@query("i15_unit_root")
def i15(spark, sf):
    return windows20(spark, sf).select(*KEYS, A.adf_pvalue("v").alias("adf_p"))


@query("i16_cointegration")
def i16(spark, sf):
    from driftline.operators.pairs import aligned_tails
    from driftline.plans.q_pairs import pair_series

    s, a = pair_series(spark, sf)
    al = aligned_tails(s, a)
    return al.select(
        "suspect_id", "asset_id", F.size("sa").alias("n"), A.coint_pvalue("sa", "sb").alias("coint_p")
    )


KF_SQL = f"""WITH RECURSIVE {W20_SQL},
  m AS (SELECT 0 AS i, 0.01::DOUBLE AS p00, 0.0::DOUBLE AS p01, 0.0::DOUBLE AS p02, 0.01::DOUBLE AS p11,
          0.0::DOUBLE AS p12, 0.01::DOUBLE AS p22, 0.0::DOUBLE AS k0, 0.0::DOUBLE AS k1, 0.0::DOUBLE AS k2, 1.0::DOUBLE AS s
    UNION ALL
    SELECT i+1, m00-m00*m00/s, m01-m00*m01/s, m02-m00*m02/s, m11-m01*m01/s, m12-m01*m02/s, m22-m02*m02/s,
       m00/s, m01/s, m02/s, s FROM (SELECT *, m00 + 0.01 AS s FROM (
       SELECT i, p00+2*p01+p02+p11+p12+0.25*p22 + 0.25*1e-4 AS m00, p01+p11+1.5*p12+p02+0.5*p22 + 0.5*1e-4 AS m01,
         p02+p12+0.5*p22 + 0.5*1e-4 AS m02, p11+2*p12+p22+1e-4 AS m11, p12+p22+1e-4 AS m12, p22+1e-4 AS m22
       FROM m WHERE i < 19))),
  r AS (SELECT user_id, pos, v, 0 AS i, v[1] AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 0.0::DOUBLE AS e FROM w
    UNION ALL
    SELECT user_id, pos, v, i, pa + k0*y, pb + k1*y, c + k2*y, greatest(e, y*y/s) FROM (
      SELECT user_id, pos, v, m.i, a+b+0.5*c AS pa, b+c AS pb, c, e, k0, k1, k2, s, v[m.i+1] - (a+b+0.5*c) AS y
      FROM r JOIN m ON m.i = r.i + 1))
  SELECT user_id, pos, round(e, 1) AS max_eps, round(least(1, e/10.83), 6) AS score FROM r WHERE i = 19"""


@query("i18_kalman_innovation", KF_SQL)
def i18(spark, sf):
    eps = S.kalman_innovation(F.col("v"), 20)
    return windows20(spark, sf).select(*KEYS, eps.alias("eps")).select(
        *KEYS, F.round("eps", 1).alias("max_eps"), r6(S.clip(F.col("eps") / 10.83, 0, 1)).alias("score")
    )


@query("i19_changepoints")
def i19(spark, sf):
    from driftline.operators.changepoints import binary_segmentation

    return binary_segmentation(events(spark, sf), "user_id", "ts", "value", ["event_id"])


@query(
    "i20_shift_probe",
    f"""WITH RECURSIVE {EV_SQL}, t AS (SELECT user_id, list(value ORDER BY pos) AS v0 FROM ev
       WHERE n >= 20 AND pos > n - 20 GROUP BY user_id),
    g AS (SELECT user_id, dl, list_transform(range(1, 21), lambda i: v0[i] + CASE WHEN i > 10 THEN dl ELSE 0 END) AS v
          FROM t, (SELECT unnest([0.0, 4.5, 50.0, 500.0]::DOUBLE[]) AS dl)),
    wd AS (SELECT user_id, dl, list_transform(range(1, 20), lambda i: v[i+1] - v[i]) AS d FROM g),
    zb AS (SELECT *, d[1:18] AS b, list_median(d[1:18]) AS med FROM wd),
    zm AS (SELECT *, list_median(list_transform(b, lambda x: abs(x - med))) AS mad FROM zb),
    zz AS (SELECT user_id, dl, list_transform(d, lambda x: (x - med)/greatest(CASE WHEN 1.4826*mad < 1e-12
         THEN greatest(list_aggregate(b, 'stddev_pop'), 1e-9) ELSE 1.4826*mad END, 0.05)::DOUBLE) AS z FROM zm),
    r AS (SELECT user_id, dl, z, 0 AS i, 0.0::DOUBLE AS sp, 0.0::DOUBLE AS sn, 0 AS c, -5 AS last,
            0.0::DOUBLE AS cp, 0.0::DOUBLE AS cn, 0.0::DOUBLE AS cm, 0.0::DOUBLE AS e, 0.0::DOUBLE AS em FROM zz
      UNION ALL SELECT user_id, dl, z, i+1, CASE WHEN hit THEN 0 ELSE np END, CASE WHEN hit THEN 0 ELSE nn END,
        c + hit::INT, CASE WHEN hit THEN i ELSE last END, qp, qn, greatest(cm, qp, qn), ne, greatest(em, abs(ne))
      FROM (SELECT *, (np >= 4 OR nn >= 4) AND i - last >= 5 AS hit FROM
        (SELECT *, greatest(0, sp + z[i+1] - 0.5) AS np, greatest(0, sn - z[i+1] - 0.5) AS nn,
           greatest(0, cp + z[i+1] - 0.5) AS qp, greatest(0, cn - z[i+1] - 0.5) AS qn,
           0.2*z[i+1] + 0.8*e AS ne FROM r WHERE i < 19))),
    o AS (SELECT user_id, dl, least(1, cm/4) AS cusum, least(1, em/(3*sqrt(0.2::DOUBLE/1.8))) AS ewma, c
          FROM r WHERE i = 19)
    SELECT a.user_id, a.dl AS delta, round(a.cusum - b.cusum, 4) AS delta_cusum,
      round(a.ewma - b.ewma, 4) AS delta_ewma,
      (a.cusum > b.cusum + 0.05 OR a.ewma > b.ewma + 0.05 OR a.c > b.c) AS fired
    FROM o a JOIN o b ON a.user_id = b.user_id AND b.dl = 0 WHERE a.dl > 0""",
)
def i20(spark, sf):
    from driftline.operators.windows import latest_windows

    w = latest_windows(events(spark, sf), "user_id", "ts", ["value"], ["event_id"])
    return shift_probe(w, "user_id", "value_w", [4.5, 50.0, 500.0])


def shift_probe(w, key: str, v: str, deltas, margin: float = 0.05):
    """Inject each level shift into each window and report which detectors react."""

    def metrics(z):
        return F.named_struct(
            F.lit("cusum"), S.page_cusum(z), F.lit("ewma"), S.ewma_chart(z), F.lit("changes"), S.regime_changes(z)
        )

    grid = F.explode(F.array(*[F.lit(float(x)) for x in deltas]))
    base = w.select(key, v, S.let(S.robust_z(F.col(v)), metrics).alias("a"), grid.alias("delta"))
    hot = base.select(
        key, "delta", "a", S.let(S.robust_z(S.inject_shift(F.col(v), F.col("delta"))), metrics).alias("b")
    )
    up = lambda f, m: F.col(f"b.{f}") > F.col(f"a.{f}") + m
    return hot.select(
        key,
        "delta",
        F.round(F.col("b.cusum") - F.col("a.cusum"), 4).alias("delta_cusum"),
        F.round(F.col("b.ewma") - F.col("a.ewma"), 4).alias("delta_ewma"),
        (up("cusum", margin) | up("ewma", margin) | up("changes", 0.0)).alias("fired"),
    )


@query("i21_feature_vector")
def i21(spark, sf):
    from driftline.plans.features import full_features

    return full_features(spark, sf)


@query(
    "i22_short_window_twin",
    f"""WITH {W20_SQL}, t AS (SELECT user_id, pos, v, v[11:20] AS s FROM w),
    d AS (SELECT user_id, pos, list_transform(range(1, 10), lambda i: s[i+1] - s[i]) AS d FROM t),
    e AS (SELECT user_id, pos, unnest(d) AS x, list_min(d) AS lo, list_max(d) AS hi FROM d),
    b AS (SELECT user_id, pos, CASE WHEN hi <= lo THEN 0 ELSE least(floor((x-lo)/(hi-lo)*10), 9) END AS bin FROM e),
    c AS (SELECT user_id, pos, bin, count(*)/9.0::DOUBLE AS p FROM b GROUP BY ALL)
    SELECT user_id, pos, round(sum(-p*log2(p)), 6) AS entropy_short, 0.5::DOUBLE AS dfa_short, 0.0::DOUBLE AS dfa_gap
    FROM c GROUP BY ALL""",
)
def i22(spark, sf):
    n_short = min(12, max(8, 20 // 2))
    w = windows20(spark, sf).select(*KEYS, F.slice("v", -n_short, n_short).alias("s"), "v")
    full, short = S.dfa_exponent(S.diffs(F.col("v")), 19), S.dfa_exponent(S.diffs(F.col("s")), n_short - 1)
    return w.select(
        *KEYS,
        r6(S.shannon_entropy(S.diffs(F.col("s")))).alias("entropy_short"),
        short.alias("dfa_short"),
        S.clip(full - short, -1, 1).alias("dfa_gap"),
    )
