"""The registered queries of the operators against their SQL."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from paperloom import llm

NAMES = sorted(llm.all_queries())


def test_every_operator_and_the_pipeline_are_registered():
    assert [n for n in NAMES if n.startswith("op")] == sorted(NAMES[:-1]) and NAMES[-1] == "pipeline"
    assert {n.split("_")[0] for n in NAMES[:-1]} == {f"op{i}" for i in range(1, 14)}
    assert set(NAMES) <= set(entry.queries()) and set(llm.all_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(llm.all_sql()))
def test_query(spark, small, name):
    assert difference(llm.all_queries()[name](spark, small), connect(small), llm.all_sql()[name]) is None


@pytest.mark.parametrize("name", ["op4_virtual_slots", "op5_low_discrepancy_mix", "op9_deletion_lines"])
def test_native_queries_run_no_python(spark, small, name):
    plan = llm.all_queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
