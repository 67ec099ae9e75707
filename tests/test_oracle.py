"""Every registered query against its check SQL, and its plan against what must not be in one."""

import duckdb
import pytest

from checks.catalog import QUERIES
from checks.oracle import ORACLES
from checks.run import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "ArrowEvalPython", "BatchEvalPython", "MapInPandas")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [node for node in FORBIDDEN if node in plan] == []
    status, _, _, note = compare(spark, con, SF, name, df)
    assert status == "ok", note
