"""Every query with SQL gives the SQL's rows on the small tables."""

import datetime
import decimal

import duckdb
import pytest

from brindle.plans import catalog as queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    got = in_order(tuple(cell(r[c]) for c in columns) for r in df.collect())
    want = in_order(tuple(cell(r[k]) for k in order) for r in expected.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_others_give_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
