"""Queries with check SQL, value by value."""

import duckdb
import pytest

from tests.llm.conftest import SF
from visitlens.llm.oracle import ORACLES
from visitlens.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
