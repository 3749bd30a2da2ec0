"""Driver contract: entry runs, every registered query runs at sf0.001, and every
query with an oracle matches DuckDB (rows, columns, values)."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["lookup_id", "out_degree", "in_degree", "depth_level", "node_type"]


def test_contract_keys():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rows = df.collect()
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    r = con.execute(sql)
    ocols = [d[0] for d in r.description]
    orows = r.fetchall()
    assert sorted(ocols) == sorted(df.columns)
    cols = sorted(df.columns)
    idx = [ocols.index(c) for c in cols]
    a = sorted(repr(tuple(_norm(x[c]) for c in cols)) for x in rows)
    b = sorted(repr(tuple(_norm(x[i]) for i in idx)) for x in orows)
    assert a == b
