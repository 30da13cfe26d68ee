"""All queries run on the smallest data; those with SQL agree with DuckDB."""

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
LLM = tuple(f"p{n}_" for n in (1, 3, 4, 5, 6, 8, 9, 10))


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6)) if v != int(v) else str(int(v))
    return str(v).lower() if isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith(LLM)))
def test_query(spark, sf, tables, name):
    df = entry.queries()[name](spark, sf)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql:
        result = tables.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in sorted(names)]
        wanted = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
        assert sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in got) == wanted


def test_flagship(spark):
    assert entry.entry(spark).count() == 10
