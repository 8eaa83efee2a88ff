"""Every registered query runs; those with check SQL return exactly the same rows."""

import math

import pytest

import __spark_entry__ as entry_module

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


def canon(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return tuple(canon(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([canon(r[i]) for i in order] for r in rows), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_check_sql(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["neighborhood_name", "median_price", "median_eur_m2", "n"]
    assert df.count() > 0
