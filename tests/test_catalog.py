"""Every registered query: same rows as its SQL on the smallest data, and no join of all pairs in its plan."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_oracle import TABLES, rows_of, types_of  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for pairwise in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert pairwise not in plan
    got = df.toArrow()
    assert got.num_rows > 0
    if name in contract.oracle_sql():
        want = con.sql(contract.oracle_sql()[name]).to_arrow_table()
        assert rows_of(got) == rows_of(want)
        assert types_of(got) == types_of(want)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
