"""Cross-operator invariants on the sf0.001 driver tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")


def q(spark, key):
    return E.queries()[key](spark, SF)


def test_region_totals_sum_to_total(spark):
    total = q(spark, "key_metrics").first()["total_revenue"]
    regions = q(spark, "regional_performance").agg(F.sum("total_revenue")).first()[0]
    channels = q(spark, "sales_by_channel").agg(F.sum("total_revenue")).first()[0]
    assert regions == pytest.approx(total, rel=1e-12) and channels == pytest.approx(total, rel=1e-12)


def test_product_ranks_are_one_to_n(spark):
    ranks = sorted(r["revenue_rank"] for r in q(spark, "product_performance").select("revenue_rank").collect())
    assert ranks == list(range(1, len(ranks) + 1))


def test_segments_partition_customers(spark):
    view = q(spark, "customer_360")
    n = view.count()
    by_segment = view.groupBy("customer_segment").count().agg(F.sum("count")).first()[0]
    assert by_segment == n and view.where(F.col("customer_segment").isNull()).count() == 0
    churn = view.groupBy("churn_risk").count().agg(F.sum("count")).first()[0]
    assert churn == n


def test_daily_rolls_up_to_monthly(spark):
    daily = q(spark, "daily_trend").groupBy(F.date_format("sale_date", "yyyy-MM").alias("ym")) \
        .agg(F.sum("daily_revenue").alias("r"))
    monthly = q(spark, "monthly_trends").groupBy(F.col("year_month").alias("ym")).agg(F.sum("monthly_revenue").alias("m"))
    rows = daily.join(monthly, "ym", "full").collect()
    assert all(r["r"] == pytest.approx(r["m"], rel=1e-9) for r in rows)


def test_rollup_grand_total(spark):
    total = q(spark, "key_metrics").first()["total_revenue"]
    grand = q(spark, "dashboard_rollup").where(F.col("grouping_level") == 3).collect()
    assert len(grand) == 1 and grand[0]["revenue"] == pytest.approx(total, rel=1e-12)


def test_cohorts_cover_all_customers(spark):
    first_month = q(spark, "cohort_retention").where(F.col("months_since_first_purchase") == 0) \
        .agg(F.sum("active_customers")).first()[0]
    assert first_month == q(spark, "key_metrics").first()["unique_customers"]


def test_silver_is_dedup_of_bronze(spark):
    rec = q(spark, "silver_reconciliation").first()
    silver = q(spark, "silver_sales")
    assert silver.count() == rec["silver_records"]
    assert silver.select("transaction_id").distinct().count() == rec["silver_records"]
