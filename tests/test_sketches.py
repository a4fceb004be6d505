"""Stored sketches against exact counts and ranks; no sales in the plan of a period."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tillscope.plans import sketches as SK
from tillscope.session import materialize
from tillscope.sources import testdata as T

SF = "/root/testdata/sf0.001"


def test_periods_are_within_their_error_and_read_no_sales(spark):
    sales = T.sales(spark, SF).cache()
    stored = materialize(SK.daily_sketches(sales), "t-sketches")
    out = SK.period_measures(stored, "1996-01-01", "1999-12-31", ["region"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "InMemoryTableScan" not in plan and "t-sketches" in plan
    period = sales.where("transaction_date >= '1996-01-01' AND transaction_date < '2000-01-01'")
    want = {r["region"]: r for r in period.groupBy("region").agg(
        F.countDistinct("customer_id").alias("c"), F.count("transaction_id").alias("n"),
        F.sum("total_amount").cast("double").alias("v")).collect()}
    got = {r["region"]: r for r in out.collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert r["transaction_count"] == want[k]["n"] and r["revenue"] == want[k]["v"]
        assert abs(r["customers"] - want[k]["c"]) <= max(1, 0.05 * want[k]["c"])
        below = period.where((F.col("region") == k) & (F.col("total_amount") <= r["q50"])).count() / want[k]["n"]
        assert abs(below - 0.5) < 0.05


def test_nulls_and_empty_tables(spark):
    schema = "transaction_id string, transaction_date timestamp, customer_id string, total_amount double, region string, " \
             "sales_channel string"
    empty = spark.createDataFrame([], schema)
    assert SK.daily_sketches(empty).count() == 0
    import datetime as dt
    rows = [("a", dt.datetime(2024, 1, 1), None, None, None, "x"), ("b", None, "c", 1.0, "r", "x"),
            ("c", dt.datetime(2024, 1, 2), "c", 5.0, None, "x")]
    r = SK.period_measures(SK.daily_sketches(spark.createDataFrame(rows, schema))).first()
    assert (r["transaction_count"], r["customers"], r["revenue"], r["q50"]) == (2, 1, 5.0, 5.0)


def test_registered():
    assert "sketch_periods" in E.queries() and "sketch_periods" in E.oracle_sql()
