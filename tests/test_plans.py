"""Plans that must keep their shape: read counts, no percentile in one heap, no nested loops."""

import importlib.util
import os

import pytest

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("plan_audit", os.path.join(ROOT, "tools", "plan_audit.py"))
audit = importlib.util.module_from_spec(spec)
spec.loader.exec_module(audit)


def plan(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", ["n03_quadrants", "n03_quadrants_by_account", "a45_quadrant_summary", "n10_opportunities", "n04_budget_optimizer",
                                  "t04_country_others", "a47_account_comparison", "n14_exec_insights", "a04_channel_breakdown"])
def test_no_forbidden_pattern(spark, name):
    assert not set(audit.findings(name, plan(spark, name))) & set(audit.NEVER)


@pytest.mark.parametrize("name, table, most", [("n04_budget_optimizer", "lineitem", 0), ("n10_opportunities", "lineitem", 0), ("n14_exec_insights", "lineitem", 2)])
def test_facts_are_read_once(spark, name, table, most):
    """N04 and N10 read a materialized campaign or keyword frame; N14 reads paid and organic lines once each."""
    assert plan(spark, name).count(f"/{table}.parquet") <= most


def test_large_account_is_ranked_by_ranges(spark):
    windows = [x for x in plan(spark, "a47_account_comparison").split("\n") if "row_number()" in x and "windowspecdefinition" in x]
    assert windows and all("_part#" in x for x in windows)
