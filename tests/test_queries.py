"""Every catalogue query against its SQL in DuckDB."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sheaf import queries as catalogue
from sheaf import store_queries

ALL = catalogue.QUERIES | store_queries.QUERIES
SQL = catalogue.ORACLE_SQL | store_queries.ORACLE_SQL
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    frame = ALL[name](spark, str(DATA))
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted((repr(tuple(plain(r[columns.index(c)]) for c in sorted(columns))) for r in found.fetchall()))
    got = sorted((repr(tuple(plain(r[c]) for c in sorted(columns))) for r in frame.collect()))
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["filter_and"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "EqualNullSafe(c_mktsegment,BUILDING)" in plan or "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "GreaterThanOrEqual(p_size,25)" in catalogue.QUERIES["filter_gte"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in catalogue.QUERIES["sort_asc_topk"](spark, str(DATA))._jdf.queryExecution().toString()
