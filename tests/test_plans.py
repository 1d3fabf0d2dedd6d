"""Plan shapes: no single-partition ranking windows, no Python UDFs, no Expand for the
milestone pivot, filters pushed into the Parquet scan."""

import re

import pytest

import __spark_entry__ as E
from retainr.plans import cohorts, common
from retainr.plans.registry import QUERIES
from retainr.sources import tables
from retainr.sources.mapping import canonical_tables
from tests.conftest import SF_ORACLE, SF_SMALL


_JOIN = re.compile(r"(?:SortMerge|BroadcastHash|ShuffledHash|BroadcastNestedLoop)Join")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _unbounded_single_partition(plan: str) -> list[str]:
    """``Exchange SinglePartition`` nodes that do not merge partial aggregates (the final step
    of a global aggregate moves one row per task and is fine)."""
    lines = plan.splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1] if i + 1 < len(lines) else ""
            if not ("HashAggregate(keys=[]" in child and "partial_" in child):
                bad.append(child.strip())
    return bad


# Ranking inputs that grow with the data (one row per user / per distinct basket value).
@pytest.mark.parametrize("name", ["rfm_user_ltv", "rfm_segment_summary", "rfm_segments_calendar",
                                  "rfm_segments_calendar_summary", "winsorize_basket"])
def test_no_single_partition_windows(spark, name):
    # sf0.01 has ~1,500 users: enough rows for several ranges
    plan = _plan(E.queries()[name](spark, SF_ORACLE))
    assert _unbounded_single_partition(plan) == []


def test_no_python_udfs_anywhere(spark):
    for name in QUERIES:
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas"):
            assert node not in plan, (name, node)


def test_milestone_pivot_has_no_expand(spark):
    plan = _plan(cohorts.cohort_milestone_pivot(canonical_tables(spark, SF_SMALL)["fact_orders"]))
    assert "Expand" not in plan


def test_status_filter_and_columns_reach_the_scan(spark, scratch):
    orders = canonical_tables(spark, SF_SMALL)["fact_orders"]
    tables.save_tables({"fact_orders": orders}, scratch)
    stored = tables.load_table(spark, "fact_orders", f"{scratch}/fact_orders.parquet", fmt="parquet")
    plan = _plan(common.delivered(stored).select("user_id", "order_ts"))
    assert "EqualTo(order_status,delivered)" in plan
    assert "ReadSchema: struct<user_id:bigint,order_ts:timestamp_ntz,order_status:string>" in plan


@pytest.mark.parametrize("name", ["eda_overview", "session_features", "daily_kpis", "link_sessions_orders", "wau_mau_stickiness"])
def test_sessions_do_not_look_up_users(spark, name):
    """The session's city and device come from the users: queries that name neither scan sessions alone."""
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    # eda_overview counts the users themselves, whose city is looked up in two small tables
    assert plan.count("nation.parquet") == (name == "eda_overview")
    assert plan.count("customer.parquet") == (name == "eda_overview")
    if name == "eda_overview":
        assert len(_JOIN.findall(plan)) == 2
