"""Every registered query against its SQL on the smallest scale."""

import pytest

import __spark_entry__ as entry
from workbook.registry import ORACLES, QUERIES
from tests.compare import compare, oracle_connection


#: Fits that go on until they end: SQL repeats their first steps in queries of their own, and tests compare score and information with brute force.
TO_THE_END = {"fit_dynamic_converged"}


@pytest.fixture(scope="module")
def con(small):
    return oracle_connection(small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TO_THE_END))
def test_matches_sql(spark, small, con, name):
    problem, _, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), small)
    assert problem is None


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) <= TO_THE_END


def test_entry_registers_all():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TO_THE_END))
def test_plan_has_no_python_rows_and_no_pairs(spark, small, name, capsys):
    df = QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
