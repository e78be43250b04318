"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from stormline.plans.catalog import QUERIES
from tests.compare import connect, differences

SF_DIR = os.environ.get("STORMLINE_TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = connect(SF_DIR)
    yield con
    con.close()


def test_registry_is_consistent():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(QUERIES) <= set(driver.queries())
    assert set(QUERIES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    result = driver.queries()[name](spark, SF_DIR)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert differences(result, tables, driver.oracle_sql()[name]) == ""


def test_refit_runs(spark):
    rows = driver.queries()["cso_refit"](spark, SF_DIR).collect()
    assert rows and all(r["n"] >= 7 for r in rows)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
