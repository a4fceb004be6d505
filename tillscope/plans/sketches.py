"""Stored sketches: distinct customers and revenue quantiles for any period without reading sales.

A day's sales of a region and channel are kept as a HyperLogLog sketch of their
customers and a KLL sketch of their amounts, beside exact sums. Sketches of any
days, regions and channels are united by a merge of small rows, so a dashboard
over years reads days x regions x channels, not sales; counts and quantiles of
united sketches have the error of one sketch over all those rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Log of a HyperLogLog sketch's registers: 2^12 registers, standard error 1.04 / 64 (1.6 per cent).
DISTINCT_LOG = 12
#: Size of a KLL sketch: rank error about 1.7 per cent at 200.
QUANTILE_SIZE = 200
BY = ("region", "sales_channel")


def daily_sketches(sales_df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """sale_date, ``by``, transaction_count, revenue, customers (sketch), amounts (sketch).

    Rows with a null date are left out; a null customer or amount is in no sketch.
    """
    return sales_df.where("transaction_date IS NOT NULL").groupBy(F.to_date("transaction_date").alias("sale_date"), *by).agg(
        F.count("transaction_id").alias("transaction_count"), F.sum("total_amount").alias("revenue"),
        F.hll_sketch_agg(F.col("customer_id"), F.lit(DISTINCT_LOG)).alias("customers"),
        F.kll_sketch_agg_double(F.col("total_amount").cast("double"), F.lit(QUANTILE_SIZE)).alias("amounts"))


def period_measures(sketches: DataFrame, since=None, until=None, by: Sequence[str] = (),
                    quantiles: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """``by``, transaction_count, revenue, customers (estimate), q<percent> of the days in [since, until]."""
    days = sketches
    if since is not None:
        days = days.where(F.col("sale_date") >= F.to_date(F.lit(str(since))))
    if until is not None:
        days = days.where(F.col("sale_date") <= F.to_date(F.lit(str(until))))
    united = days.groupBy(*by).agg(
        F.sum("transaction_count").alias("transaction_count"), F.sum("revenue").cast("double").alias("revenue"),
        F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("customers"),
        F.kll_merge_agg_double("amounts").alias("_amounts"))
    return united.select(*by, "transaction_count", "revenue", "customers", *[
        F.kll_sketch_get_quantile_double("_amounts", F.lit(float(q))).alias(f"q{round(100 * q)}") for q in quantiles])
