"""The class API on the sample shop."""

import pytest
from pyspark.sql import functions as F

from tillscope.api import CustomerAnalytics, DataValidator, SalesAnalytics

REF = "2023-05-12"


@pytest.fixture(scope="module")
def ca(spark):
    return CustomerAnalytics(spark)


@pytest.fixture(scope="module")
def sa(spark):
    return SalesAnalytics(spark)


@pytest.fixture(scope="module")
def dv(spark):
    return DataValidator(spark, {"min_record_count": 3, "max_null_percentage": 0.1, "duplicate_threshold": 0.01})


def test_rfm_metrics(ca, sample_sales, sample_customers):
    rfm = ca.calculate_rfm_metrics(sample_sales, sample_customers, REF)
    for c in ("recency_days", "frequency", "monetary_value", "rfm_score"):
        assert c in rfm.columns
    c1 = rfm.where(F.col("customer_id") == "K-ada").first()
    assert c1["frequency"] == 3 and c1["monetary_value"] == pytest.approx(280.0)


def test_segments_not_null(ca, sample_sales, sample_customers):
    seg = ca.segment_customers(ca.calculate_rfm_metrics(sample_sales, sample_customers, REF))
    assert "customer_segment" in seg.columns
    assert seg.where(F.col("customer_segment").isNull()).count() == 0


def test_clv(ca, sample_sales, sample_customers):
    clv = ca.calculate_customer_lifetime_value(sample_sales, sample_customers)
    c1 = clv.where(F.col("customer_id") == "K-ada").first()
    assert c1["historical_clv"] == pytest.approx(280.0) and c1["projected_clv"] is not None


def test_daily_sales_total(sa, sample_sales):
    total = sample_sales.agg(F.sum("total_amount")).first()[0]
    assert sa.calculate_daily_sales(sample_sales).agg(F.sum("total_revenue")).first()[0] == pytest.approx(total, abs=0.01)


def test_product_quantity(sa, sample_sales, sample_products):
    p = sa.analyze_product_performance(sample_sales, sample_products).where(F.col("product_id") == "P-lamp").first()
    assert p["total_quantity_sold"] == 13


def test_regional(sa, sample_sales):
    n = sa.analyze_regional_performance(sample_sales).where(F.col("region") == "Coast").first()
    assert n["transaction_count"] == 3 and n["unique_customers"] == 1


def test_validation_report(dv, sample_sales):
    df, rep = dv.validate_dataframe(sample_sales, "sales", ["transaction_id", "customer_id"])
    assert set(rep) >= {"dataset_name", "validation_timestamp", "checks", "overall_status"}
    assert {"record_count", "required_columns", "null_values", "duplicates", "data_types"} <= set(rep["checks"])


def test_remove_duplicates(dv, duplicate_rows):
    assert dv.remove_duplicates(duplicate_rows, ["transaction_id"]).count() == 2


def test_date_range(dv, sample_sales):
    df, rep = dv.validate_date_range(sample_sales, "transaction_date", "2023-03-01", "2023-03-31")
    assert df.count() == 3 and rep["valid_records"] == 3 and rep["invalid_records"] == 3


def test_pipeline_validate_rfm_segment(dv, ca, sample_sales, sample_customers):
    df, rep = dv.validate_dataframe(sample_sales, "sales")
    seg = ca.segment_customers(ca.calculate_rfm_metrics(df, sample_customers, REF))
    assert seg.count() == sample_customers.count()


def test_pipeline_validate_product_region(dv, sa, sample_sales, sample_products):
    df, _ = dv.validate_dataframe(sample_sales, "sales")
    assert sa.analyze_product_performance(df, sample_products).count() > 0
    assert sa.analyze_regional_performance(df).count() > 0
    assert sa.calculate_category_performance(df, sample_products).count() > 0
    assert sa.calculate_monthly_trends(df).count() > 0
    assert sa.calculate_sales_velocity(df).count() > 0
    assert sa.identify_top_customers(df, 2).count() == 2


def test_loader_and_360_view(spark, ca, sample_sales, sample_customers):
    from tillscope.api import DataLoader
    from tillscope.session import fresh_path
    from tillscope.sources.schemas import SALES_SCHEMA, conform
    from tillscope.sources.sinks import write_table
    path = write_table(conform(sample_sales, SALES_SCHEMA), fresh_path(spark, "api-csv"), "csv")
    sales = DataLoader(spark).load_sales_data(path, "csv")
    assert sales.count() == 6
    rfm = ca.segment_customers(ca.calculate_rfm_metrics(sales, sample_customers, REF))
    clv = ca.calculate_customer_lifetime_value(sales, sample_customers)
    churn = ca.identify_churn_risk(sales, sample_customers, reference_date="2023-10-12")
    view = ca.create_customer_360_view(sample_customers, rfm, clv, churn)
    c1 = view.where(F.col("customer_id") == "K-ada").first()
    assert (c1["customer_segment"], c1["churn_risk"], c1["historical_clv"]) == ("At Risk", "High", 280.0)
    with pytest.raises(ValueError):
        DataLoader(spark).load_product_data(path, "xml")


def test_bi_run_all(spark, sample_sales, sample_customers, sample_products):
    from tillscope.operators import customers as C
    from tillscope.operators import sales as S
    from tillscope.plans import bi
    bi.register_views(spark, sales=sample_sales,
                      customers=C.customer_360_from_sales(sample_sales, sample_customers, REF),
                      products=S.product_performance(sample_sales, sample_products))
    out = bi.run_all(spark, "2023-03-15")
    assert len(out) == 14
    k = out["kpi_month"].first()
    assert (k["total_transactions"], k["unique_customers"], k["total_revenue"]) == (3, 2, 245.0)
    assert out["day_of_week"].count() == 5 and out["customer_health"].count() == 3
    assert out["monthly_growth"].orderBy("month").collect()[1]["mom_growth_pct"] == pytest.approx(-2.04, abs=0.001)
