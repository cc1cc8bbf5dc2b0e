"""Every query that has SQL gives the same rows as DuckDB on the same files."""

import math

import duckdb
import pytest

from driftline.plans.catalogue import ORACLES, QUERIES
from driftline.session import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, int):
        return float(v)
    f = float(v)
    return None if math.isnan(f) else round(f, 6) + 0.0


def table(rows, cols, order):
    idx = [cols.index(c) for c in order]
    return sorted((tuple(norm(r[i]) for i in idx) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    want = table(cur.fetchall(), names, order)
    got = table([tuple(r) for r in df.collect()], df.columns, order)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
