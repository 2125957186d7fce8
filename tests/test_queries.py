"""Every registered query against its SQL twin, on the smallest tables."""

import pytest
from compare import compare, database
from conftest import TABLES, plan_of

import __spark_entry__ as entry
from shelfmark.plans import QUERIES


@pytest.fixture(scope="module")
def con():
    return database(TABLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, TABLES)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    error, n, _, _ = compare(df, con, entry.oracle_sql()[name])
    assert error is None
    assert n > 0 or name == "resource_by_path"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
