"""Every registered query of the engine against its SQL in DuckDB."""

import decimal
import math

import duckdb
import pytest

from orbitile.plans.registry import QUERIES
from orbitile.sources.views import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return f"{float(v) + 0.0:.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    fn, sql = QUERIES[name]
    df = fn(spark, DATA)
    names = sorted(df.columns)
    rows = sorted(tuple(map(shown, r)) for r in df.select(*names).collect())
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    assert rows == sorted(tuple(shown(r[i]) for i in order) for r in cursor.fetchall())
