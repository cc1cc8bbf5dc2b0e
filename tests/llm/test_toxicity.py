import random

from driftline.llm.toxicity import fit, keep_clean, score, segments
from driftline.llm.q_toxicity import op8_toxicity


def best_runs(values):
    """All maximal-scoring runs by definition: the best run, then those left and right of it."""
    sums = [(sum(values[i:j]), -i, i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)]
    if not sums or max(sums)[0] <= 0:
        return []
    top = max(s[0] for s in sums)
    i, j = min(((a, b) for s, _, a, b in sums if s == top), key=lambda x: (x[1] - x[0], x[0]))
    return [*best_runs(values[:i]), (i, j), *[(a + j, b + j) for a, b in best_runs(values[j:])]]


def test_segments_are_the_maximal_ones():
    rng = random.Random(3)
    for _ in range(200):
        values = [rng.choice([-5, -3, -2, 2, 3, 4, 7]) + rng.random() / 100 for _ in range(rng.randint(1, 14))]
        up = [i for i, v in enumerate(values) if v > 0]
        found = segments([values[i] for i in up], [sum(values[:i]) for i in up])
        assert sorted((up[a], up[b] + 1) for a, b, _ in found) == sorted(best_runs(values))


def test_planted_toxic_texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        if toxic := i % 5 == 0:
            for _ in range(4):
                w.insert(rng.randint(0, len(w)), rng.choice(["zzidiot", "zzmoron", "zzscum"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit(docs, known)
    got = {r["doc_id"]: r for r in score(docs, model).collect()}
    assert all(got[i]["predicted"] == t for i, t in labels)
    assert all(bool(got[i]["passages"]) == bool(t) for i, t in labels)
    kept = keep_clean(docs, known)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in labels if not t}


def test_edges(spark, edge, none, sf):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    got = score(edge, fit(edge, labels)).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got)
    assert score(none, fit(none, labels)).count() == 0
    assert score(edge, fit(edge, labels.limit(0))).agg({"predicted": "max"}).first()[0] == 0
    assert keep_clean(edge, labels.where("toxic = 0")).columns == edge.columns


def test_held_out_rows(spark, sf):
    import zlib

    got = op8_toxicity(spark, sf).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert len(got) == 200 or len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
