"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from attesta.plans import MODULES

SF = "/root/testdata/sf0.001"
QUERIES = {k: f for m in MODULES for k, f in m.queries().items()}
SQL = {k: q for m in MODULES for k, q in m.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(v):
    import decimal

    return str(round(float(v), 6)) if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    cols = sorted(want.columns)
    assert cols == sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
