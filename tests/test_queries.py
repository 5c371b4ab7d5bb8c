"""Every registered query against its DuckDB statement, and the driver contract."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from oracle import compare
from spendlake.plans import registry

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert contract.entry(spark).columns == ["financial_year", "agency", "total_amount", "records"]


def test_every_query_has_an_expected_result():
    assert set(registry.QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    rows, diffs = compare(spark, contract.queries()[name], contract.oracle_sql()[name], SF)
    assert not diffs


def test_total_reads_only_what_it_needs(spark):
    plan = contract.queries()["spend_by_fy_agency_top20"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "p_name" not in plan and "s_name" not in plan and "TakeOrderedAndProject" in plan


def test_filters_reach_the_scan(spark):
    plan = contract.queries()["total_spend_filtered"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_batch_lookup_has_no_nested_loop(spark):
    df = contract.queries()["batch_spend_lookup"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert df.agg(F.count(F.lit(1)).alias("n")).first()["n"] > 0
