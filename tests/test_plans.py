"""Properties of the physical plans that matter at scale."""

import re

import pytest

import __spark_entry__ as contract
from subscope.plans import reports
from subscope.sources import tables as t

QUERIES, SQL = contract.queries(), contract.oracle_sql()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan: str, table: str) -> list[str]:
    return [line for line in plan.splitlines() if "FileScan" in line and f"{table}.parquet" in line]


@pytest.mark.parametrize("name", sorted(SQL))
def test_no_query_compares_all_pairs(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["q1_monthly_revenue", "q3_top_customers_per_city", "q4_tariff_changes",
                                  "q5_cohort_retention", "q6_churn_by_segment", "q7_days_to_next", "kpi_overview"])
def test_order_lines_are_read_only_for_usage(spark, small, name):
    assert scans(plan_of(QUERIES[name](spark, small)), "lineitem") == []


def test_scans_read_only_what_is_used(spark, small):
    plan = plan_of(QUERIES["q1_monthly_revenue"](spark, small))
    # the fact, and the dates that the calendar takes its years from
    read = sorted(re.search(r"ReadSchema: struct<(.*?)>", scan).group(1) for scan in scans(plan, "orders"))
    assert read == ["o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz", "o_orderdate:timestamp_ntz"]
    plan = plan_of(QUERIES["segment_explorer"](spark, small))
    assert any("EqualTo(r_name,ASIA)" in line for line in scans(plan, "region"))

    plan = plan_of(t.drift_sides(spark, small)[1])
    (scan,) = scans(plan, "lineitem")
    assert "GreaterThanOrEqual(l_shipdate" in scan and "l_orderkey" not in scan.split("ReadSchema")[1]


def test_top_customers_are_limited_before_the_shuffle(spark, small):
    plan = plan_of(QUERIES["q3_top_customers_per_city"](spark, small))
    assert plan.count("WindowGroupLimit") == 2


def test_ranked_reports_sort_within_slices(spark, small):
    whole = reports.value_tiers(t.fact_transactions(spark, small), t.dim_customer(spark, small))
    sliced = reports.value_tiers(t.fact_transactions(spark, small), t.dim_customer(spark, small), slice_rows=20)
    assert "hashpartitioning(_slice" in plan_of(sliced).replace("#", " #").replace("_slice #", "_slice#")
    assert sorted(whole.collect()) == sorted(sliced.collect())
