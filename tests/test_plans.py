"""Physical-plan checks: no Python UDF anywhere, filters and columns pushed to
the Parquet scan, no un-partitioned window over customer rows, no cross join."""

from __future__ import annotations

import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as E

# jobs whose plan is built from DataFrames only (the tree jobs run pyspark.ml first)
PLAN_JOBS = sorted(set(E.queries()) - {"return_risk_tree", "tree_roc_auc", "feature_importance",
                                       "impact_summary", "publish_outputs", "csv_source_roundtrip"})


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAN_JOBS)
def test_no_python_udf_and_no_cartesian(spark, wh, name):
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name}: {bad}"


def test_cohort_filter_and_columns_reach_the_scan(spark, wh):
    plan = plan_of(E.queries()["sell_through_cohort"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(week_number), LessThanOrEqual(week_number,16)" in plan
    # only the columns the job reads are scanned from the inventory table
    assert "ReadSchema: struct<product_id:bigint,week_number:int,opening_stock:int,units_sold:int," in plan
    assert "inventory_id" not in plan


def test_ntile_is_not_a_global_window(spark, wh):
    plan = plan_of(E.queries()["rfm_scores_ntile"](spark, SF_SMALL))
    assert "ntile(" not in plan.lower()


def test_clean_dedup_limits_before_the_shuffle(spark, wh):
    from tillpoint.plans.audit import clean_transactions
    plan = plan_of(clean_transactions(wh["fact_transactions"]))
    assert "WindowGroupLimit" in plan
    assert "revenue > 0" in plan or "GreaterThan(revenue" in plan or "(revenue#" in plan
