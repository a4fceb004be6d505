"""Bronze -> silver -> gold batch job.

* bronze: raw copies of sales, customers and products (overwrite, or
  append-only with ingest metadata); records that did not parse go to the
  quarantine with their raw text;
* silver: sales cleaned by the rule list (non-null keys, valid amount and
  quantity, one valid row per id), master data passed through; rows that break
  a rule go to the quarantine with the names of the rules. A reconciliation
  row compares the written counts: bronze = silver + duplicates + rejects;
* gold: customer lifetime value, product performance, monthly trends and
  regional performance, computed from the silver tables *read back*: each
  layer is a written table, which cuts the lineage (a lost executor only
  recomputes from the last layer) and gives the next layer a fresh,
  partition-pruned scan.

Every write counts its rows in the same job (``observe``) and the counts go
to an append-only metrics table; the job returns a small DataFrame of the
row counts read back from the written layers.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.operators import customers as C
from tillscope.operators import quality as Q
from tillscope.operators import sales as S
from tillscope.session import fresh_path
from tillscope.settings import DEFAULT, Settings
from tillscope.sources.loaders import CORRUPT, split_corrupt
from tillscope.sources.sinks import append_metrics, observed_write, read_table


@dataclass(frozen=True)
class Layout:
    base: str

    def path(self, layer: str, table: str) -> str:
        return f"{self.base.rstrip('/')}/{layer}/{table}"

    def quarantine(self, table: str) -> str:
        return f"{self.base.rstrip('/')}/_quarantine/{table}"

    @property
    def metrics(self) -> str:
        return f"{self.base.rstrip('/')}/_metrics"


#: Sales of a customer bucket, on average, at most.
ROWS_A_BUCKET = 1_000_000

GOLD_TABLES = ("customer_analytics", "product_performance", "monthly_trends", "regional_performance")


def regional_summary(sales_df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Gold regional table (revenue, transactions, customers, average, per customer)."""
    return S.regional_performance(sales_df, settings).select(
        "region", "total_revenue", "transaction_count", "unique_customers", "avg_order_value",
        "revenue_per_customer")


def gold_tables(sales: DataFrame, customers: DataFrame, products: DataFrame,
                settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """The gold tables over the silver ones."""
    return {"customer_analytics": C.calculate_clv(sales, customers),
            "product_performance": S.product_performance(sales, products, settings),
            "monthly_trends": S.monthly_mom(sales, settings),
            "regional_performance": regional_summary(sales, settings)}


def run(spark: SparkSession, sales: DataFrame, customers: DataFrame, products: DataFrame,
        base: str | None = None, fmt: str = "parquet", settings: Settings = DEFAULT,
        pipeline: str = "retail_medallion", customer_buckets: int | None = None,
        parallel_writes: int = 4) -> tuple[Layout, DataFrame]:
    """Run the three layers; returns (layout, row counts per layer table).

    ``customer_buckets=n`` writes silver sales and silver customers bucketed
    (and sorted) by customer_id into n buckets, or more where a bucket would
    hold over ``ROWS_A_BUCKET`` sales (a bucket is read by one task): the gold
    per-customer aggregate then runs without an exchange and its join to the
    customers is co-located (no shuffle on either side).

    The tables of one layer do not depend on each other, so their writes are
    submitted as concurrent Spark jobs (``parallel_writes`` at a time); the
    layers themselves run in order.
    """
    lay = Layout(base or fresh_path(spark, "medallion"))
    tag = uuid.uuid4().hex
    metrics = []
    tables = {}

    def put(df: DataFrame, layer: str, table: str, partition_by=None, bucketed: bool = False):
        kw = {"max_records_per_file": settings.max_records_per_file}
        if bucketed:
            tables[(layer, table)] = f"{layer}_{table}_{tag}"
            # dealt like the buckets: a task writes one bucket, not a piece of each
            df = df.repartition(buckets, "customer_id")
            kw.update(bucket_by=(buckets, ["customer_id"]), table_name=tables[(layer, table)])
        n, sec = observed_write(df, lay.path(layer, table), fmt, "overwrite", partition_by, **kw)
        metrics.append((pipeline, f"{layer}.{table}", sec, n))

    def get(layer: str, table: str) -> DataFrame:
        if (layer, table) in tables:
            return spark.table(tables[(layer, table)])
        return read_table(spark, lay.path(layer, table), fmt)

    def layer(*jobs):
        with ThreadPoolExecutor(max_workers=max(1, parallel_writes)) as pool:
            for f in [pool.submit(j) for j in jobs]:
                f.result()

    def bronze(df: DataFrame, table: str):
        good, bad = split_corrupt(df)
        put(good, "bronze", table)
        if CORRUPT in df.columns:
            metrics.append((pipeline, f"quarantine.corrupt_{table}", *reversed(observed_write(
                bad.withColumn("quarantined_at", F.current_timestamp()), lay.quarantine(f"corrupt_{table}"), fmt))))

    layer(lambda: bronze(sales, "sales"),
          lambda: bronze(customers, "customers"),
          lambda: bronze(products, "products"))

    bucketed = bool(customer_buckets)
    ingested = next(n for _, stage, _, n in metrics if stage == "bronze.sales")
    buckets = max(customer_buckets or 1, -(-ingested // ROWS_A_BUCKET))
    b_sales = read_table(spark, lay.path("bronze", "sales"), fmt)
    _, rejects = Q.split_quarantine(b_sales, settings)
    layer(lambda: put(Q.silver_sales(b_sales, settings), "silver", "sales", bucketed=bucketed),
          lambda: metrics.append((pipeline, "quarantine.rejected_sales", *reversed(observed_write(
              rejects.withColumn("quarantined_at", F.current_timestamp()), lay.quarantine("rejected_sales"), fmt)))),
          lambda: put(read_table(spark, lay.path("bronze", "customers"), fmt), "silver", "customers",
                      bucketed=bucketed),
          lambda: put(read_table(spark, lay.path("bronze", "products"), fmt), "silver", "products"))

    s_sales = get("silver", "sales")
    s_cust = get("silver", "customers")
    s_prod = get("silver", "products")
    gold = gold_tables(s_sales, s_cust, s_prod, settings)
    layer(*[lambda t=t, df=df: put(df, "gold", t) for t, df in gold.items()])

    append_metrics(spark, lay.metrics, metrics)
    return lay, layer_counts(spark, lay, fmt)


def reconciliation(spark: SparkSession, lay: Layout, fmt: str = "parquet", settings: Settings = DEFAULT) -> DataFrame:
    """The written layers compared: bronze rows = silver rows + duplicates + quarantined rejects."""
    return Q.silver_reconciliation(read_table(spark, lay.path("bronze", "sales"), fmt),
                                   read_table(spark, lay.path("silver", "sales"), fmt),
                                   read_table(spark, lay.quarantine("rejected_sales"), fmt), settings)


def layer_counts(spark: SparkSession, lay: Layout, fmt: str = "parquet") -> DataFrame:
    """(layer, table_name, record_count) read back from the written tables."""
    parts = []
    for layer, tables in (("bronze", ("sales", "customers", "products")),
                          ("silver", ("sales", "customers", "products")),
                          ("gold", GOLD_TABLES)):
        for t in tables:
            parts.append(read_table(spark, lay.path(layer, t), fmt).agg(F.count(F.lit(1)).alias("record_count"))
                         .select(F.lit(layer).alias("layer"), F.lit(t).alias("table_name"), "record_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metrics_table(spark: SparkSession, lay: Layout) -> DataFrame:
    return read_table(spark, lay.metrics, "parquet")


def main(argv: list[str] | None = None) -> list[dict]:
    """Command-line job (``spark-submit -m tillscope.plans.medallion`` or
    ``python -m tillscope.plans.medallion``): load the three sources, run the
    layers below ``--out`` (default: a new folder below spark.checkpoint.dir)
    and print the row counts per layer table."""
    import argparse
    import json

    from tillscope.session import shared_dir
    from tillscope.sources import loaders as L

    ap = argparse.ArgumentParser(prog="tillscope.plans.medallion")
    ap.add_argument("--sales", required=True)
    ap.add_argument("--customers", required=True)
    ap.add_argument("--products", required=True)
    ap.add_argument("--format", default="parquet", help="format of the three sources")
    ap.add_argument("--out", default=None)
    ap.add_argument("--customer-buckets", type=int, default=None)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("tillscope-medallion").getOrCreate()
    shared_dir(spark)
    kw = {"keep_corrupt": True}
    lay, counts = run(spark, L.load_sales(spark, args.sales, args.format, **kw),
                      L.load_customers(spark, args.customers, args.format, **kw),
                      L.load_products(spark, args.products, args.format, **kw),
                      base=args.out, customer_buckets=args.customer_buckets)
    rows = [r.asDict() for r in counts.collect()]
    balance = reconciliation(spark, lay).first().asDict()
    print(json.dumps({"base": lay.base, "counts": rows, "sales": balance}))
    return rows


if __name__ == "__main__":
    main()
