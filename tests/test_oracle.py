"""Every registered query against its SQL oracle (DuckDB) on the sf0.001
tables: row count, column names and the order-insensitive multiset of rows.
Set CATCHMENT_ORACLE_SF to check another folder."""

import collections
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from catchment.queries import ORACLES, QUERIES

SF = os.environ.get("CATCHMENT_ORACLE_SF", "/root/testdata/sf0.001")
TABLES = ["supplier", "customer"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    s_rows = df.collect()
    cur = con.execute(ORACLES[name])
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    assert sorted(df.columns) == sorted(o_cols)
    assert len(s_rows) == len(o_rows)
    assert _bag(df.columns, s_rows) == _bag(o_cols, o_rows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.queries()[E.FLAGSHIP](spark, E.SMOKE_DIR).columns
