"""Every query with an SQL twin gives its rows; all queries run on the smallest data."""

import decimal
import math
from pathlib import Path

import pytest

from weftline import registry

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(v[i]) for i in order]) for v in values)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    got = df.collect()
    if name not in SQL:
        assert df.columns and len(got) >= 0
        return
    twin = duck.execute(SQL[name])
    names = [x[0] for x in twin.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in got]) == rows(names, twin.fetchall())


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
