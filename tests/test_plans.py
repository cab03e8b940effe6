"""Shapes of physical plans that must hold at any scale."""

import pytest

from stewardry.plans import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_joins_and_no_python(spark, data, name):
    plan = plan_of(QUERIES[name](spark, data))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "EvalPython" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("name", ["C7_interval_overlap", "C8_cidr_containment"])
def test_range_joins_are_equi_joins_without_broadcast(spark, data, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES[name](spark, data))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["E3_incidents", "E5_red_to_green", "E6_allocate_next", "E8_stitch_tracebacks"])
def test_ordered_work_is_partitioned(spark, data, name):
    plan = plan_of(QUERIES[name](spark, data))
    assert "SinglePartition" not in plan
    assert "_chunk" in plan


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = plan_of(QUERIES["L8_unused_flags"](spark, data))
    assert "IsNotNull(l_quantity)" in plan.split("PushedFilters", 1)[1] and "l_extendedprice" not in plan


@pytest.mark.parametrize("name", ["E7_log_tail", "F2_truncate_report", "F3_top_matches"])
def test_top_rows_are_limited_before_the_shuffle(spark, data, name):
    assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, data))
