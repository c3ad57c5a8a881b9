"""Plan guards: the scale rules stay true as the code changes."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin"]


@pytest.mark.parametrize("key", sorted(E.catalog.all_queries()))
def test_no_cross_product(spark, key):
    df = E.queries()[key](spark, SF)
    qe = df._jdf.queryExecution()
    text = qe.executedPlan().toString() + qe.optimizedPlan().toString()
    assert not [w for w in FORBIDDEN if w in text]


def test_filter_and_pruning_reach_the_scan(spark):
    df = E.queries()["aspect_filter"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan


def test_topn_windows_have_partial_limits(spark):
    for key in ["dense_topk", "bm25_topk", "final_report"]:
        plan = E.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan, key


def test_preferred_types_are_keys_of_the_join(spark):
    plan = E.queries()["hard_filter_in"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan
