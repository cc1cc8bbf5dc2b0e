import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm.ann import nearest
from driftline.llm.graph_index import beam_search, build, prune


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 5 == 0:
            near = sorted((-float((v * w).sum()), j) for j, w in good if j != i and len(w) == len(v))[:k]
            out[i] = [j for _, j in near]
    return out


@pytest.mark.parametrize("shard_rows", [16384, 150])
def test_recall_and_order(spark, shard_rows):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 16)) * rng.uniform(0.2, 3, size=(900, 1)))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = nearest(vectors, F.col("vec_id") % 5 == 0, shard_rows=shard_rows).toPandas()
    want, data = brute(rows, 20), dict(rows)
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and (np.diff(g["score"]) <= 0).all() and q not in set(g["vec_id"])
        assert np.allclose(g["score"], [np.dot(data[q], data[v]) for v in g["vec_id"]])
        hits += len(set(g["vec_id"]) & set(want[q]))
    assert hits / (20 * len(want)) > 0.95


def test_small_and_odd(spark):
    """Few candidates, ties of equal vectors, a very common vector, and vectors that take no part."""
    rows = [(i, [1.0, 0.0]) for i in range(100, 160)] + [(i, [0.5, float(i)]) for i in range(7)]
    rows += [(200, None), (205, []), (210, [0.0, 0.0]), (215, [float("nan"), 1.0]), (220, [None, 1.0]), (225, [float("inf"), 1.0]), (None, [1.0, 1.0]), (230, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in nearest(vectors, F.col("vec_id") % 5 == 0, k=8).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: v for q, v in brute(rows, 8).items() if v}
    assert nearest(vectors.limit(0), F.lit(True)).count() == 0


def test_prune_keeps_diverse_edges():
    x = np.array([[1, 0, 0], [0.99, 0.14, 0], [0.98, 0.2, 0], [0.9, 0, 0.43]], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = prune(x, np.array([0]), np.array([[1, 2, 3]]), (x[0] @ x[[1, 2, 3]].T)[None, :], 3, 1.0)
    assert kept[0].tolist() == [1, 3, -1]


def test_graph_reaches_all():
    x = np.random.default_rng(2).normal(size=(1500, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges, starts = build(x)
    ids, _ = beam_search(x, edges, starts, x[:300], 32)
    assert np.mean([i in set(r) for i, r in enumerate(ids.tolist())]) > 0.99
