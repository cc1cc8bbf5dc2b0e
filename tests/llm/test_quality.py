import random
import zlib

import numpy as np

from driftline.llm.q_quality import op13_quality
from driftline.llm.quality import FEATURES, fit, least_ratio, measure, score


def test_measurements():
    x = measure([None, "", "Aa 1.\nAa 1.", "ü|"])
    assert x.shape == (4, FEATURES) and np.isfinite(x).all() and (x[0] == x[1]).all()
    # Lower after upper twice in ten pairs; two different words of four, one different line of two, both end well.
    assert np.isclose(x[2][8], np.sqrt(2 / 10)) and x[2][-4] == 0.5 and x[2][-3] == 0.5 and x[2][-1] == 1.0
    assert (measure(["one", "two words", "ü|"])[2] == x[3]).all()  # rows do not touch each other


def test_least_ratio():
    good, bad = np.bincount(np.minimum(np.random.default_rng(0).normal(70, 8, 20_000).astype(int), 99), minlength=100), np.zeros(100)
    bad[10:40] = 1000
    assert abs(least_ratio(good, good * 3 + bad) - 60_000 / 90_000) < 0.03


def test_learns_from_positives_alone(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(8, 60))]
        good = rng.random() < 0.7
        rows.append((i, " ".join(words) + "." if good else " | ".join(w.upper() + "$#" for w in words)))
        if good and rng.random() < 0.3:
            labels.append((i, 1))
    truth = {i: int("|" not in t) for i, t in rows}
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = fit(docs, known)
    assert abs(model.prior - 0.7) < 0.1
    got = {r["doc_id"]: r["predicted"] for r in score(docs, model).collect()}
    assert np.mean([got[i] == t for i, t in truth.items()]) > 0.97


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = op13_quality(spark, sf).toPandas()
    assert len(got) == got["doc_id"].nunique() == 10_000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").toPandas()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    right = held["predicted"] == held["quality"]
    assert right.mean() > 0.97 and right[held["quality"] == 0].mean() > 0.9 and right[held["quality"] == 1].mean() > 0.97


def test_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (None, 1), (4, 0), (7, 1), (5, None)], "doc_id long, quality int")
    got = score(edge, fit(edge, labels)).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 8}) == 1
    assert score(none, fit(none, labels)).count() == 0
    assert score(edge, fit(edge, labels.limit(0))).agg({"predicted": "max"}).first()[0] == 0
