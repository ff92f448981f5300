"""Every registered query against its SQL, and what its plan must not contain."""

import pytest

import __spark_entry__ as entry
from oracle import compare
from trialgrid import queries as library

QUERIES = library.queries()
ORACLES = library.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_equal_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, QUERIES[name], ORACLES[name]) == []


def test_entry_is_stable(spark):
    assert entry.entry(spark).columns == entry.entry(spark).columns


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"run_suite", "dependency_order", "prune_unused"}))
def test_no_pairwise_join(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
