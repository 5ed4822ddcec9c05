"""Queries with SQL against DuckDB on the sf0.001 tables."""

import collections

import duckdb
import pytest

from catchment.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    df = QUERIES[name](spark, sf_small)
    columns = sorted(df.columns)
    found = con.execute(ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = collections.Counter(tuple(r[i] for i in at) for r in found.fetchall())
    assert collections.Counter(tuple(r[c] for c in columns) for r in df.collect()) == want
