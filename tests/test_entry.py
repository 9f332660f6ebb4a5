import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def norm(x):
    if x is None or (isinstance(x, float) and x != x):
        return "-"
    return repr(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    return con


def test_every_query_has_a_name_of_its_own():
    q, sql = entry.queries(), entry.oracle_sql()
    assert len(q) > 60 and set(sql) <= set(q)
    assert not entry.llm or sum(n.startswith("op") for n in q) == 13


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in entry.base.SQL))
def test_query_against_sql(spark, tables, name):
    got = entry.base.QUERIES[name](spark, SF)
    want = tables.sql(entry.base.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(norm(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(norm(r[i]) for i in order) for r in want.fetchall())
