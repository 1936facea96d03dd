"""Every registered query against its reference SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import connect, differences

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    found = QUERIES[name](spark, SF)
    if name in SQL:
        assert differences(found, connection, SQL[name]) == []
    else:
        assert found.count() > 0


def test_every_reference_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0]["context"].startswith("[Match #1 | Source: ")


def test_no_forbidden_plans_in_registered_queries(spark):
    for name in ("search", "observations_for_matches", "harmonise", "rerank"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
