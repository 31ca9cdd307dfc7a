"""Every query with SQL against DuckDB on the smallest tables; the others give a stable schema."""

import duckdb
import pytest

from factloom.plans import catalog
from factloom.session import TABLES

D = "/root/testdata/sf0.001"


def shown(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns and rows
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert shown(df.columns, rows) == shown(want.columns, want.fetchall())
