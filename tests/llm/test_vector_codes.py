import math

import numpy as np
import pytest

from driftline.llm.q_vector_codes import op12_vector_codes
from driftline.llm.vector_codes import assign, compress, decoded, digest, with_label_error


def plainly(rows, parts, entries, rounds):
    """Every part against every entry in every round, in whole numbers of Python."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    grid = [[math.floor(256 * x) for x in v] for _, v in rows]
    w = len(grid[0]) // parts
    cut = [[g[p * w : p * w + w] for p in range(parts)] for g in grid]
    book = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book[p])) for p, x in enumerate(c)] for c in cut]

    for _ in range(rounds):
        near = nearest()
        for p in range(parts):
            for k in range(len(book[p])):
                mine = [c[p] for c, n in zip(cut, near) if n[p][1] == k]
                if mine:
                    book[p][k] = [sum(v) // len(mine) for v in zip(*mine)]
    return sorted((r[0] is None, r[0], "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n)) for r, n in zip(rows, nearest())), book


def codes(coded):
    return sorted((r["vec_id"] is None, r["vec_id"], bytes(r["codes"]).hex(), r["error"]) for r in coded.collect())


@pytest.mark.parametrize(("parts", "entries", "rounds", "scale"), [(4, 8, 2, 1.0), (2, 16, 5, 0.02), (4, 5, 0, 1.0), (2, 6, 3, 60_000.0)])
def test_against_whole_numbers(spark, parts, entries, rounds, scale):
    rng = np.random.default_rng(parts * entries)
    middles = rng.normal(size=(5, 8)) * scale
    rows = [(i, (middles[i % 5] + rng.normal(size=8) * scale / 4).astype(np.float32).tolist(), i % 3) for i in range(300)]
    rows += [(7, rows[8][1], 1), (7, rows[8][1], 1), (None, rows[9][1], None)]  # repeated rows, ties, a null id
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    coded, books = compress(table, parts=parts, entries=entries, rounds=rounds)
    want, book = plainly([r[:2] for r in rows], parts, entries, rounds)
    assert codes(coded) == want and books[-1].tolist() == book and len(books) == rounds + 1


def test_bounds_spare_parts():
    rng = np.random.default_rng(1)
    grid = np.rint(rng.normal(size=(4000, 2, 4)) * 20 + rng.integers(0, 8, (4000, 2, 1)) * 200).astype(np.int64)
    history = [np.stack([grid[:16, p] for p in range(2)])]
    state, first = assign(grid, history, None)
    assert (first == 2).all()
    seen = []
    for _ in range(4):
        book = history[-1].copy()
        for p in range(2):
            for k in range(16):
                if (mine := grid[state.codes[:, p] == k, p]).size:
                    book[p, k] = mine.sum(axis=0) // len(mine)
        history.append(book)
        state, scans = assign(grid, history, state)
        seen.append(scans.mean())
        for p in range(2):
            d = ((grid[:, p, None, :] - book[p][None]) ** 2).sum(axis=2)
            assert (state.codes[:, p] == d.argmin(axis=1)).all()
    assert seen[-1] < 1.0  # of two parts


def test_left_out_and_labels(spark):
    good = [float(x) for x in range(16)]
    rows = [(1, good, 1), (2, None, 1), (3, [], 1), (4, [math.nan, *good[1:]], 1), (5, [math.inf, *good[1:]], None), (6, [None, *good[1:]], 1), (7, good[:8], 1), (8, [3e30, *good[1:]], 1)]
    rows += [(9, [x + 1 for x in good], None), (10, good, None), (10, good, None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, codes string, error int")
    coded, books = compress(table, entries=2)
    assert sorted(r["vec_id"] for r in coded.collect()) == [1, 9, 10, 10]
    errors = {r["vec_id"]: (r["error"], r["label_error"]) for r in with_label_error(coded).collect()}
    assert errors[1][1] == errors[1][0] and errors[9][1] == errors[10][1] == errors[9][0] + 2 * errors[10][0]
    assert np.allclose(decoded(bytes(coded.where("vec_id = 9").first()["codes"]), books[-1]), np.array(good) + 1, atol=1)
    empty, books = compress(table.limit(0))
    assert empty.count() == 0 and with_label_error(empty).count() == 0 and digest(books[-1])


def test_query_shape(spark, sf):
    got = op12_vector_codes(spark, sf).toPandas()
    assert got["code"].str.fullmatch("[0-9a-f]{32}").all() and got["codebooks_sha256"].nunique() == 1
