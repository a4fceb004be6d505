"""Inventory analytics over stock snapshots
(product_id, warehouse_id, quantity_on_hand, quantity_reserved,
quantity_available, reorder_point, snapshot_date).

The latest snapshot per (product, warehouse) is taken with ``max_by`` inside
an aggregate, so a product stocked in many warehouses or with a long
snapshot history is reduced map-side rather than sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.columns import day_range, safe_div
from tillscope.settings import DEFAULT, Settings

_STOCK = ("quantity_on_hand", "quantity_reserved", "quantity_available", "reorder_point")


def latest_snapshot(inventory_df: DataFrame) -> DataFrame:
    """One row per (product, warehouse): the values of its latest snapshot."""
    packed = F.struct(*[F.col(c) for c in _STOCK])
    g = inventory_df.groupBy("product_id", "warehouse_id").agg(
        F.max("snapshot_date").alias("snapshot_date"),
        F.max_by(packed, F.col("snapshot_date")).alias("__s"))
    return g.select("product_id", "warehouse_id", *[F.col(f"__s.{c}").alias(c) for c in _STOCK], "snapshot_date")


def stock_levels(inventory_df: DataFrame) -> DataFrame:
    """Per product, over the latest snapshot of each warehouse: warehouses,
    on hand, reserved and available stock, and the latest snapshot date."""
    return latest_snapshot(inventory_df).groupBy("product_id").agg(
        F.count("warehouse_id").alias("warehouse_count"),
        F.sum("quantity_on_hand").cast("long").alias("quantity_on_hand"),
        F.sum("quantity_reserved").cast("long").alias("quantity_reserved"),
        F.sum("quantity_available").cast("long").alias("quantity_available"),
        F.max("snapshot_date").alias("snapshot_date"))


def reorder_alerts(inventory_df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Latest (product, warehouse) stock at or below its reorder point (or the
    low-stock threshold when no point is set), with the suggested order
    quantity ceil(multiplier * point) - available, floored at 0."""
    point = F.coalesce(F.col("reorder_point"), F.lit(settings.low_stock_threshold))
    latest = latest_snapshot(inventory_df).withColumn("effective_reorder_point", point.cast("int"))
    target = F.ceil(F.col("effective_reorder_point") * F.lit(settings.reorder_multiplier))
    return latest.where(F.col("quantity_available") <= F.col("effective_reorder_point")).withColumn(
        "suggested_order_quantity", F.greatest(F.lit(0), (target - F.col("quantity_available")).cast("int")))


def inventory_turnover(sales_df: DataFrame, product_df: DataFrame, inventory_df: DataFrame,
                       period_start: str, period_end: str) -> DataFrame:
    """Per product over [period_start, period_end]: cost of goods sold
    (unit_cost x quantity sold), average stock value (unit_cost x on hand,
    averaged over the snapshot dates in the period), turnover = COGS / average
    stock value and days of inventory = period days / turnover. Every product
    stays; without a snapshot in the period its stock and turnover are NULL."""
    lo, hi = F.to_date(F.lit(period_start)), F.to_date(F.lit(period_end))
    sold = sales_df.where(day_range(sales_df, "transaction_date", period_start, period_end)).groupBy("product_id") \
        .agg(F.sum("quantity").cast("long").alias("units_sold"))
    inv = inventory_df.where((F.col("snapshot_date") >= lo) & (F.col("snapshot_date") <= hi)) \
        .groupBy("product_id", "snapshot_date").agg(F.sum("quantity_on_hand").cast("long").alias("__oh")) \
        .groupBy("product_id").agg(F.avg("__oh").alias("avg_units_on_hand"))
    cost = product_df.select("product_id", "unit_cost")
    j = cost.join(inv, "product_id", "left").join(sold, "product_id", "left")
    j = j.withColumns({
        "cogs": F.col("unit_cost") * F.coalesce(F.col("units_sold"), F.lit(0)),
        "avg_stock_value": F.col("unit_cost") * F.col("avg_units_on_hand"),
    })
    days = F.datediff(hi, lo) + 1
    j = j.withColumn("turnover", safe_div("cogs", "avg_stock_value"))
    return j.withColumn("days_of_inventory", F.try_divide(days.cast("double"), F.when(F.col("turnover") > 0,
                                                                                       F.col("turnover"))))


def recent_daily_quantity(sales_df: DataFrame, window_days: int = 30) -> DataFrame:
    """Per product: its last sale day and the average daily quantity over the sale
    days among the ``window_days`` + 1 days that end on it.

    The days of a product are summed first; then only those near its last day
    are kept and averaged (no running window over every product-day)."""
    daily = sales_df.groupBy("product_id", F.to_date("transaction_date").alias("sale_date")) \
        .agg(F.sum("quantity").cast("long").alias("_q"))
    last = F.max("sale_date").over(Window.partitionBy("product_id"))
    near = daily.withColumn("last_sale_date", last) \
        .where(F.col("sale_date") >= F.date_sub("last_sale_date", window_days))
    return near.groupBy("product_id", "last_sale_date").agg(
        safe_div(F.sum("_q"), F.count("_q")).alias("avg_daily_quantity"))


def stock_cover(sales_df: DataFrame, inventory_df: DataFrame, window_days: int = 30) -> DataFrame:
    """Days of stock left: latest available stock / recent average daily quantity
    (``recent_daily_quantity``). NULL when the product has no sales."""
    return _cover(recent_daily_quantity(sales_df, window_days), inventory_df)


def stock_cover_days(velocity_df: DataFrame, inventory_df: DataFrame, window_days: int = 30) -> DataFrame:
    """``stock_cover`` from an already computed ``sales_velocity`` table."""
    col = f"avg_daily_quantity_{window_days}d"
    rate = velocity_df.groupBy("product_id").agg(F.max_by(F.col(col), F.col("sale_date")).alias("avg_daily_quantity"),
                                                 F.max("sale_date").alias("last_sale_date"))
    return _cover(rate, inventory_df)


def _cover(rate: DataFrame, inventory_df: DataFrame) -> DataFrame:
    stock = stock_levels(inventory_df).select("product_id", "quantity_available")
    out = stock.join(rate, "product_id", "left")
    cover = safe_div("quantity_available", F.when(F.col("avg_daily_quantity") > 0, F.col("avg_daily_quantity")))
    return out.select("product_id", "quantity_available", "avg_daily_quantity", "last_sale_date",
                      cover.alias("stock_cover_days"))
