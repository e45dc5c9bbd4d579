"""Every registered query against its SQL, on the smallest tables."""

import re

import pytest
from compare import connect, difference

import __spark_entry__ as entry
import bench
from paperloom import workload

NAMES = sorted(workload.all_queries())


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def check_plan(plan: str) -> None:
    """No product of two sides, nothing whole in one task, no row-wise or grouped Python."""
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas", plan)
    # A window without a key may only run over the one row per slice that holds its totals.
    for line in plan.splitlines():
        if "Window " in line:
            spec = re.search(r"windowspecdefinition\(([^()]*(?:\([^()]*\)[^()]*)*)\)", line)
            assert "_rows" in line or not (spec and re.match(r"\s*\w+#\d+L? (ASC|DESC)", spec.group(1))), line


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    check_plan(plan_of(df))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, duck, sql) is None


@pytest.fixture
def compiled(spark):
    """The settings a user has: compiled plans."""
    names = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("name", bench.HEADLINE)
def test_headline_query_compiled(spark, small, duck, compiled, name):
    assert difference(entry.queries()[name](spark, small), duck, entry.oracle_sql()[name]) is None


def test_comparison_can_fail(spark, small, duck):
    df = entry.queries()["session_results"](spark, small).limit(10)
    assert difference(df, duck, entry.oracle_sql()["session_results"]) is not None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(NAMES) == set(workload.all_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = plan_of(entry.queries()["session_results"](spark, small))
    lineitem = next(line for line in plan.splitlines() if "FileScan" in line and "lineitem" in line)
    assert "l_discount" not in lineitem.split("ReadSchema")[1] and "IsNotNull(l_partkey)" in lineitem
