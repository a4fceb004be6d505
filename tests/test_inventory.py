import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillscope.operators import inventory as I
from tillscope.operators import sales as S
from tillscope.settings import Settings

D1, D2 = dt.date(2023, 3, 31), dt.date(2023, 4, 30)
SCHEMA = "product_id string, warehouse_id string, quantity_on_hand int, quantity_reserved int, " \
         "quantity_available int, reorder_point int, snapshot_date date"


@pytest.fixture(scope="module")
def inventory(spark):
    rows = [
        ("P-lamp", "N1", 80, 5, 75, 20, D1), ("P-lamp", "N1", 35, 15, 20, 20, D2),   # equal to point
        ("P-lamp", "N2", 45, 0, 45, None, D2),                                        # NULL point -> 50
        ("P-rug", "N1", 150, 0, 150, 40, D1), ("P-rug", "N1", 210, 10, 200, 40, D2),
        ("P-mug", "N1", 12, 0, 12, None, D1),                                         # only old snapshot
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_stock_levels_use_latest_snapshot(inventory):
    r = {x["product_id"]: x for x in I.stock_levels(inventory).collect()}
    assert (r["P-lamp"]["warehouse_count"], r["P-lamp"]["quantity_available"]) == (2, 65)
    assert r["P-rug"]["quantity_on_hand"] == 210 and r["P-rug"]["snapshot_date"] == D2
    assert r["P-mug"]["snapshot_date"] == D1


def test_reorder_alerts(inventory):
    got = {(x["product_id"], x["warehouse_id"]): (x["effective_reorder_point"], x["suggested_order_quantity"])
           for x in I.reorder_alerts(inventory, Settings()).collect()}
    # available == point alerts; NULL point falls back to the low-stock threshold 50
    assert got == {("P-lamp", "N1"): (20, 10), ("P-lamp", "N2"): (50, 30), ("P-mug", "N1"): (50, 63)}


def test_turnover_and_cover(spark, inventory, sample_sales, sample_products):
    t = {x["product_id"]: x for x in I.inventory_turnover(sample_sales, sample_products, inventory,
                                                         "2023-03-01", "2023-04-30").collect()}
    lamp = t["P-lamp"]
    assert lamp["units_sold"] == 13 and lamp["cogs"] == 130.0
    assert lamp["avg_units_on_hand"] == pytest.approx(80.0)  # 80 on D1, 35 + 45 on D2
    assert lamp["turnover"] == pytest.approx(130.0 / (10.0 * 80.0))
    assert lamp["days_of_inventory"] == pytest.approx(61 / lamp["turnover"])
    # a product without a snapshot in the period stays
    assert len(t) == 4 and t["P-kite"]["avg_units_on_hand"] is None and t["P-kite"]["turnover"] is None
    vel = S.sales_velocity(sample_sales, 30)
    c = {x["product_id"]: x for x in I.stock_cover_days(vel, inventory, 30).collect()}
    assert c["P-lamp"]["stock_cover_days"] == pytest.approx(65 / 8.0)
    assert c["P-mug"]["avg_daily_quantity"] == 7.5
    direct = {x["product_id"]: x for x in I.stock_cover(sample_sales, inventory, 30).collect()}
    assert direct == c


def test_tied_revenue_ranks_by_key(spark, sample_products):
    sales = spark.createDataFrame(
        [("T1", dt.datetime(2024, 1, 1), "C1", "P-rug", 1, 50.0), ("T2", dt.datetime(2024, 1, 1), "C1", "P-mug", 1, 50.0)],
        "transaction_id string, transaction_date timestamp, customer_id string, product_id string, quantity int, "
        "total_amount double")
    r = {x["product_id"]: x["revenue_rank"] for x in S.product_performance(sales, sample_products).collect()}
    assert r["P-mug"] == 1 and r["P-rug"] == 2 and sorted(r.values()) == [1, 2, 3, 4]
    assert S.regional_performance(sales.withColumn("region", F.lit("N"))).first()["revenue_rank"] == 1
