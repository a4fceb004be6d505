"""Plan-shape checks over every registered query (sf0.001 driver tables)."""

import os
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")

# queries that must run through files or streams are checked by the oracle test instead
_SKIP = {"load_sales", "load_customers", "load_products", "load_inventory", "load_malformed", "load_customers_segment",
         "medallion_counts", "medallion_reconciliation", "run_metrics", "partitioned_scan", "bronze_ingest", "quarantine",
         "churn_model", *(q for q in E.queries() if q.startswith("gold_"))}
# the training-data queries have tests of their own
_CORE = {q for q in E.queries() if q != "pipeline" and not q.startswith("op")}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("key", sorted(_CORE - _SKIP))
def test_no_cartesian_no_python(spark, key):
    plan = _plan(E.queries()[key](spark, SF))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan), key
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|PythonUDF", plan), key


@pytest.mark.parametrize("key", ["top_customers", "best_worst_products"])
def test_rank_filter_becomes_group_limit(spark, key):
    df = E.queries()[key](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "TakeOrderedAndProject" in plan


def test_kpi_month_filter_reaches_scan(spark):
    df = E.queries()["sql_kpi_month"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)


def test_partitioned_scan_prunes(spark):
    df = E.queries()["partitioned_scan"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "(year" in plan


def test_scan_prunes_columns(spark):
    df = E.queries()["sales_by_channel"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    lineitem = [s for s in scans if "l_orderkey" in s]
    assert lineitem and all("l_shipdate" not in s and "l_tax" not in s for s in lineitem)


def test_date_range_filter_reaches_scan(spark):
    df = E.queries()["date_range_filter"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate[^\]]*LessThan\(o_orderdate", plan)


def test_customer_aggregate_is_partial_before_shuffle(spark):
    from tillscope.operators.customers import customer_fact
    df = customer_fact(E._sales(spark, SF))
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    txt = df._jdf.queryExecution().explainString(mode)
    # a partial HashAggregate (map-side combine) feeds the exchange on customer_id
    assert re.search(r"Exchange\s*\n?.*?Arguments: hashpartitioning\(customer_id", txt, re.S)
    assert "partial_max" in txt and "partial_count" in txt and "partial_sum" in txt


def test_fingerprint_mode_shuffles_hashes_not_rows(spark):
    from tillscope.operators import quality as Q
    from tillscope.settings import Settings
    df = Q.quality_report(E._sales(spark, SF), "s", settings=Settings(duplicate_mode="hash"))
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    txt = df._jdf.queryExecution().explainString(mode)
    parts = re.findall(r"Arguments: hashpartitioning\(([^)]*)\)", txt)
    assert any("__h1" in p for p in parts)
    # whole rows are shuffled only behind the semi join with repeated fingerprints (the subquery)
    main, _, sub = txt.partition("===== Subqueries =====")
    assert all("transaction_id" not in p for p in re.findall(r"Arguments: hashpartitioning\(([^)]*)\)", main))
    assert "LeftSemi" in sub


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_top_n_stays_distributed(spark):
    from tillscope.operators import customers as C
    from tillscope.operators import sales as S
    from tillscope.sources import testdata as T
    sales = E._sales(spark, SF)
    for df in (C.top_customers(sales, 5000), S.best_worst_products(sales, T.products(spark, SF), 5000)):
        plan = _final_plan(df)
        assert "TakeOrderedAndProject(limit=5000" in plan
        # nothing reaches a single task but the limit's own rows
        assert not re.search(r"Exchange SinglePartition, ENSURE_REQUIREMENTS, \[plan_id=\d+\]\s*\n\s*\+- \*?\(?\d*\)? ?"
                             r"(HashAggregate|SortMergeJoin)", plan)


def _formatted(df) -> str:
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("key", ["sql_revenue_by_region", "sql_channel_comparison", "vw_executive_dashboard",
                                 "category_performance", "sql_kpi_month"])
def test_several_distinct_counts_do_not_multiply_rows(spark, key):
    assert "Expand" not in _formatted(E.queries()[key](spark, SF)), key


def test_rollup_expands_reduced_rows_only(spark):
    txt = _formatted(E.queries()["dashboard_rollup"](spark, SF))
    tree = txt.split("\n\n")[0]
    # each Expand stands above an aggregate (the reduction), never directly above the joined rows
    lines = [x for x in tree.splitlines() if "(" in x]
    for i, line in enumerate(lines):
        if "Expand" in line:
            below = " ".join(lines[i + 1:i + 4])
            assert "HashAggregate" in below


def test_approximate_counts_reach_the_dashboards(spark):
    from tillscope.operators import sales as S
    from tillscope.settings import Settings
    approx = Settings(distinct_mode="approx")
    sales = E._sales(spark, SF)
    for f in (S.region_scorecard, S.channel_scorecard, S.executive_dashboard, S.month_kpis, S.dashboard_rollup):
        txt = _formatted(f(sales, approx))
        assert "approx_count_distinct" in txt
