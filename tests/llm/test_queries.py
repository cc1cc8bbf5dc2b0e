"""Queries with SQL against DuckDB; the others run and keep their columns."""

import duckdb
import pytest

from driftline.llm.queries import ORACLES, QUERIES
from driftline.session import TABLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, sf).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(map(tuple, d[columns].astype(str).to_numpy().tolist())) for d in (got, want)]
    assert rows[0] == rows[1]


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_ngram_join_against_sets(spark, sf, texts):
    import re

    got = QUERIES["op7_ngram_join"](spark, sf).toPandas().set_index("doc_id")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} if w else set()
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a]) < 90 * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    assert {i: len(s) for i, s in sets.items()} == got["n_shingles"].to_dict()
    assert {i: find(i) for i in sets} == got["component_id"].to_dict()
