"""Every registered query next to its SQL twin on the smallest tables."""

import os

import pytest

from bindloom import catalog
from oracle_check import compare, connect

catalog.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    _n, problem = compare(df, con, catalog.ORACLES[name])
    assert not problem
    # one-row sides are scalar subqueries, so no query needs a product of two inputs
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", [q for q in catalog.QUERIES if q not in catalog.ORACLES])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
