"""Adapter from the TPC-H-like driver tables to the retail entities.

One definition, used by ``__spark_entry__`` and mirrored by its DuckDB SQL:

* sales = lineitem x orders x customer x nation x region, one row per line;
  ``total_amount`` is an exact DECIMAL so every sum is order independent.
* customers / products / inventory are projections of customer / part.
* events give the time-of-day stream (hour of day, streaming tier).

Join order is chosen for scale: orders are enriched with the customer's region
first (orders are ~1/4 of lineitem), then lineitem is joined once on the order
key. nation (25 rows) and region (5 rows) are fixed-size dimensions of the
schema, so broadcasting them is bounded; every other join is left to AQE,
which broadcasts only what it measured below the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: reference date and parameters that fit the driver tables
REFERENCE_DATE = "2001-08-02"
KPI_MONTH_START = "2001-07-01"
DATE_RANGE = ("1996-01-01", "2000-12-31")
HIGH_VALUE_AT_RISK_CLV = 400000.0
UNDERPERFORMING_REVENUE = 1000.0
UNDERPERFORMING_MARGIN = 25.0
INVENTORY_SNAPSHOTS = ("2001-07-01", "2001-08-01")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation key -> nation name, region name: 25 rows by the schema's definition (broadcast)."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey))


def customer_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer key -> nation name, region name (nation/region are bounded, broadcast)."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    geo = _nation_region(spark, sf_dir)
    return c.join(geo, c.c_nationkey == geo.n_nationkey).select("c_custkey", "n_name", "r_name")


def sales(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    """The sales fact. ``dirty=True`` uses (orderkey, linenumber) as the id: a key
    with real duplicates, for the duplicate and cleaning operators."""
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    geo = customer_geo(spark, sf_dir)
    orders = o.join(geo, o.o_custkey == geo.c_custkey).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "r_name")
    j = li.join(orders, li.l_orderkey == orders.o_orderkey)
    if dirty:
        tid = F.concat_ws("-", "l_orderkey", "l_linenumber")
    else:
        tid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    amount = F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    return j.select(
        tid.alias("transaction_id"),
        F.col("o_orderdate").cast("timestamp").alias("transaction_date"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_discount").alias("discount_percentage"),
        amount.alias("total_amount"),
        F.col("o_orderstatus").alias("payment_method"),
        F.col("o_orderpriority").alias("sales_channel"),
        F.col("r_name").alias("region"),
        F.col("l_suppkey").cast("string").alias("store_id"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    geo = _nation_region(spark, sf_dir)
    j = c.join(geo, c.c_nationkey == geo.n_nationkey)
    return j.select(
        F.col("c_custkey").alias("customer_id"),
        F.lit("Customer").alias("first_name"),
        F.element_at(F.split("c_name", "#"), -1).alias("last_name"),
        F.concat(F.lit("customer"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("market_segment"),
        F.when(F.col("c_acctbal") >= 0, "Y").otherwise("N").alias("is_active"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.concat(F.col("p_type"), F.lit("_"), F.col("p_size").cast("string")).alias("subcategory"),
        F.col("p_brand").alias("brand"),
        (F.lit(1.2) * F.col("p_retailprice")).alias("unit_cost"),
        F.col("p_retailprice").alias("unit_price"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stock snapshots per part (one warehouse), older and latest, from one scan."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    snaps = F.array(*[F.struct(F.lit(factor).alias("factor"), F.to_date(F.lit(day)).alias("day"))
                      for day, factor in zip(INVENTORY_SNAPSHOTS, (10, 20))])
    x = p.select("p_partkey", "p_size", F.explode(snaps).alias("snap"))
    on_hand = F.col("p_size") * F.col("snap.factor")
    return x.select(
        F.col("p_partkey").alias("product_id"),
        F.lit("W1").alias("warehouse_id"),
        on_hand.cast("int").alias("quantity_on_hand"),
        F.col("p_size").cast("int").alias("quantity_reserved"),
        (on_hand - F.col("p_size")).cast("int").alias("quantity_available"),
        F.when(F.col("p_size") % 2 == 0, F.lit(None)).otherwise(F.lit(100)).cast("int").alias("reorder_point"),
        F.col("snap.day").alias("snapshot_date"),
    )


def event_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sales with a time of day (hour-of-day analysis, streaming)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("transaction_date"),
        F.col("user_id").alias("customer_id"),
        F.col("value").cast("decimal(12,2)").alias("total_amount"),
        F.col("event_type").alias("sales_channel"),
    )


def sales_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty sales with NULLs injected into two optional columns (the driver
    tables have none): sales_channel '5-LOW' and store 1 become NULL."""
    s = sales(spark, sf_dir, dirty=True)
    return s.withColumns({
        "sales_channel": F.nullif(F.col("sales_channel"), F.lit("5-LOW")),
        "store_id": F.nullif(F.col("store_id"), F.lit("1")),
    })
