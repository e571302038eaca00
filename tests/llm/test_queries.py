"""All training-data queries run on the smallest data; those with an SQL twin give its rows."""

from pathlib import Path

import pytest

from weftline import llm

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = llm.queries(), llm.oracle_sql()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    got = sorted(map(tuple, df.collect()), key=repr)
    if name in SQL:
        twin = duck.execute(SQL[name])
        assert [x[0] for x in twin.description] == df.columns
        assert got == sorted(twin.fetchall(), key=repr)


def test_every_problem_has_queries():
    assert {int(n[1]) for n in QUERIES} == set(range(1, 9)) and set(SQL) <= set(QUERIES)
