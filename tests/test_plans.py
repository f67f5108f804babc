"""Plan checks: pushdown and pruning reach the scan, Python stays out of
operators that SQL expresses, per-tenant top-k is limited before the
shuffle, and only size-proven tables are broadcast explicitly."""

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
# operators that are Python by design (the pluggable model stage)
PYTHON_ALLOWED = {"model_stage"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in E.queries() if n not in PYTHON_ALLOWED))
def test_no_python_in_plan(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert not any(x in p for x in PYTHON_NODES), name


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_tenant_filter_pushed_to_scan(spark):
    p = plan(E.queries()["tenant_view"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,7)]" in p


def test_column_pruning(spark):
    p = plan(E.queries()["docs_per_type"](spark, SF_SMALL))
    # only the columns the query needs are read from orders
    scan = [line for line in p.splitlines() if "FileScan parquet" in line and "orders" in line][0]
    assert "o_totalprice" not in scan


def test_top_k_limited_before_shuffle(spark):
    p = plan(E.queries()["recent_activity"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


def test_model_stage_uses_arrow_batches(spark):
    p = plan(E.queries()["model_stage"](spark, SF_SMALL))
    assert "MapInPandas" in p
