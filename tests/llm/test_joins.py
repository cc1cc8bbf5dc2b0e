"""Line dedup, n-gram join, sharding and their shared parts."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.llm import joins
from driftline.llm.components import components
from driftline.llm.line_dedup import dedup_lines
from driftline.llm.ngram_join import Rule, keep_first, near_groups
from driftline.llm.sharding import assign, write


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_lines(rows):
    """Kept text per row: a line goes if an earlier one is within the allowed edits."""
    places = [((i is not None, i or 0, t), k, line) for i, t in rows for k, line in enumerate((t or "").split("\n")) if line.strip(" ")]
    gone = set()
    for p, k, line in places:
        for q, j, other in places:
            if (q[:2], q[2], j) < (p[:2], p[2], k) and not (q[:2] == p[:2] and q[2] != p[2]):
                short = min(len(line), len(other))
                if line == other or abs(len(line) - len(other)) <= min(2, short // 5) and edits(line, other) <= min(2, short // 5):
                    gone.add((p, k))
    return [(i, None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if ((i is not None, i or 0, t), k) not in gone)) for i, t in rows]


@pytest.mark.parametrize("most", [joins.BROADCAST_ROWS, 0])
def test_lines(spark, monkeypatch, most):
    monkeypatch.setattr(joins.sized, "__defaults__", (most,))
    rng = random.Random(6)
    line = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 16)))
    seen = [line() for _ in range(60)]

    def near():
        x = list(rng.choice(seen))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(x))
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "ü"])
        return "".join(x)

    rows = [(i, "\n".join(rng.choice([line, near])() for _ in range(rng.randint(1, 6)))) for i in range(60)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("row.doc_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute_lines(rows))


def test_common_segments_lose_nothing(spark):
    rng = random.Random(8)
    head = "a common beginning of many lines "
    lines = sorted({head + "".join(rng.choice("xy") for _ in range(12)) for _ in range(150)})
    rows = [(i, t) for i, t in enumerate(lines)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute_lines(rows))


def test_line_edges(edge, none):
    rows = [(r[0], r[1]) for r in edge.select("doc_id", "text").collect()]
    got = dedup_lines(edge).select("row.*", F.col("kept").alias("new")).collect()
    assert sorted(((r["doc_id"] or 0, r["new"] or "") for r in got)) == sorted((i or 0, t or "") for i, t in rows)
    assert dedup_lines(none).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 9), (2, 9), (300, 301), (4, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 2: 2, 5: 2, 7: 2, 9: 2, 300: 300, 301: 300}


def brute_groups(rows, rule):
    from driftline.llm.ngram_join import shingles

    sets = [set(s.tolist()) for s in shingles([t for _, t in rows], rule.words)]
    group = list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rule.linked(both, len(sets[i]) + len(sets[j])):
                group[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("rule", [Rule(), Rule(words=5, percent=80), Rule(words=1, percent=60)])
def test_groups(spark, monkeypatch, rule):
    """One large family of near-copies, cut into many small blocks, and small families."""
    monkeypatch.setattr("driftline.llm.ngram_join.BLOCK", 8)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in [[rng.choice(words) for _ in range(n)] for n in (60, 25, 200, 8, 4)]:
        for _ in range(60 if len(base) == 60 else 12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 50)))) for i in range(60)]
    rng.shuffle(rows)
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rule=rule).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_groups(rows, rule)


def test_group_edges(edge, none):
    got = near_groups(edge).collect()
    assert len(got) == edge.count()
    assert all(r["component_id"] == r["doc_id"] for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] in (1, 2, 3, 4, 5, 8)} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 8: 4}
    assert near_groups(none).count() == 0
    kept = keep_first(edge)
    assert kept.columns == edge.columns and kept.count() == edge.count()


def test_shards(spark, docs):
    limit = 20_000
    got = assign(docs, limit).toPandas()
    assert len(got) == docs.count()
    size = got.groupby("shard")["n_bytes"].agg(["sum", "count"])
    assert ((size["sum"] <= limit) | (size["count"] == 1)).all()
    shards = set(size.index)
    assert not any(s[:k] in shards for s in shards for k in range(len(s)))  # no shard is part of another
    for s in shards - {""}:  # the bucket that was split was too large
        mine = got["shard"].str.startswith(s[:-1])
        assert got.loc[mine, "n_bytes"].sum() > limit and mine.sum() > 1


def test_shards_of_one_id(spark, edge, none, tmp_path):
    rows = spark.range(400).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x" * 100).alias("text"))
    size = assign(rows, 1500).groupBy("shard").agg(F.sum("n_bytes").alias("b")).toPandas()
    assert size["b"].max() <= 1500 and size["b"].sum() == 40_000
    got = assign(edge, 10)
    assert got.count() == edge.count() and assign(none, 10).count() == 0
    write(edge, str(tmp_path / "out"), 100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == edge.count() and set(edge.columns) < set(back.columns)


def test_dual_traversal_keeps_every_pair_that_links():
    import numpy as np

    from driftline.llm import ngram_join as J

    rng = np.random.default_rng(4)
    rule = J.Rule(3, 80)
    sets, part = [], []
    for family in range(6):
        base = rng.integers(0, 2**63, rng.integers(30, 900), dtype=np.uint64)
        for k in range(40):
            keep = rng.random(len(base)) > rng.choice([0.0, 0.02, 0.1, 0.3])
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, rng.integers(0, 30), dtype=np.uint64)])))
            part.append(family if k < 10 else 1000 + len(sets))

    def bitmap(s):
        few = int(J._thinned(len(s)))
        some = J.mix(s)
        return J._bitmap(some[some >> np.uint64(64 - few) == 0] if few else some, J.BITMAP)

    n, part, bits = np.array([len(s) for s in sets]), np.array(part), np.array([bitmap(s) for s in sets])
    links = {(i, j) for i in range(len(sets)) for j in range(i) if part[i] != part[j] and rule.linked(J._common(sets[i], sets[j]), n[i] + n[j])}
    tree = J.Signatures(n, part, bits, 4)
    found = {(max(i, j), min(i, j)) for x, y in J._traversed(tree, tree, rule) for i, j in zip(x.tolist(), y.tolist())}
    assert len(links) > 300 and links <= found and len(found) < len(sets) ** 2 / 4
    assert all(part[i] != part[j] for i, j in found)
    half = np.arange(len(sets)) % 2 == 0
    one, two = (J.Signatures(n[k], part[k], bits[k], 3) for k in (half, ~half))
    at = [np.flatnonzero(half), np.flatnonzero(~half)]
    across = {tuple(sorted((int(at[0][i]), int(at[1][j])), reverse=True)) for x, y in J._traversed(one, two, rule) for i, j in zip(x, y)}
    assert {p for p in links if (p[0] + p[1]) % 2} <= across


def test_fine_bitmaps_lose_no_link(spark):
    import numpy as np

    from driftline.llm import ngram_join as J

    rng = np.random.default_rng(6)
    rule, rows, pairs, want = J.Rule(3, 90), [], [], set()
    for k in range(300):
        base = rng.integers(0, 2**63, rng.integers(1, 1200), dtype=np.uint64)
        keep = rng.random(len(base)) > rng.choice([0.0, 0.01, 0.05, 0.2])
        x, y = np.unique(base), np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, rng.integers(0, 20), dtype=np.uint64)]))
        rows += [(2 * k, len(x), J._fine(x)), (2 * k + 1, len(y), J._fine(y))]
        pairs.append((2 * k, 2 * k + 1))
        if len(y) and rule.linked(J._common(x, y), len(x) + len(y)):
            want.add((2 * k, 2 * k + 1))
    assert len(rows[0][2]) * 8 >= 2 * rows[0][1] and all(len(f) % 8 == 0 and len(f) >= 8 for _, _, f in rows)
    got = {tuple(r) for r in J._refined(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "id long, n long, fine binary"), rule).collect()}
    assert want <= got and len(want) > 50 and len(got) < len(want) + 60
