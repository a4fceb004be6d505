"""Class API with the method names and signatures of the original library.

Each method delegates to the DataFrame operators of ``tillscope.operators`` /
``tillscope.sources``; nothing here computes on its own. Differences that
matter to a caller: dates that defaulted to "today" can be passed
explicitly (``reference_date``), deduplication keeps a deterministic row, and
the master-data segment column is called ``market_segment``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tillscope.operators import customers as C
from tillscope.operators import quality as Q
from tillscope.operators import sales as S
from tillscope.settings import Settings
from tillscope.sources import loaders as L


class DataLoader:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def load_sales_data(self, path: str, file_format: str = "parquet") -> DataFrame:
        return L.load_sales(self.spark, path, file_format)

    def load_customer_data(self, path: str, file_format: str = "parquet") -> DataFrame:
        return L.load_customers(self.spark, path, file_format)

    def load_product_data(self, path: str, file_format: str = "parquet") -> DataFrame:
        return L.load_products(self.spark, path, file_format)

    def load_inventory_data(self, path: str, file_format: str = "parquet") -> DataFrame:
        return L.load_inventory(self.spark, path, file_format)


class DataValidator:
    """``config`` keys: min_record_count (default 0), max_null_percentage (0.1),
    duplicate_threshold (0.01) — the defaults of the original class."""

    def __init__(self, spark: SparkSession, config: dict | None = None):
        self.spark = spark
        self.config = config or {}
        self.settings = Settings(
            min_record_count=self.config.get("min_record_count", 0),
            max_null_percentage=self.config.get("max_null_percentage", 0.1),
            duplicate_threshold=self.config.get("duplicate_threshold", 0.01),
        )

    def validate_dataframe(self, df: DataFrame, dataset_name: str,
                           required_columns: list[str] | None = None) -> tuple[DataFrame, dict]:
        df, report = Q.validate_dataframe(df, dataset_name, required_columns, self.settings)
        report["validation_timestamp"] = dt.datetime.now().isoformat()
        return df, report

    def quality_report(self, df: DataFrame, dataset_name: str, required_columns: list[str] | None = None) -> DataFrame:
        """The same checks as a DataFrame (no action)."""
        return Q.quality_report(df, dataset_name, required_columns, self.settings)

    def remove_duplicates(self, df: DataFrame, subset: list[str] | None = None) -> DataFrame:
        return Q.remove_duplicates(df, subset)

    def handle_null_values(self, df: DataFrame, strategy: str = "drop", fill_values: dict | None = None) -> DataFrame:
        return Q.handle_null_values(df, strategy, fill_values)

    def validate_date_range(self, df: DataFrame, date_column: str, min_date: str | None = None,
                            max_date: str | None = None) -> tuple[DataFrame, dict]:
        return Q.validate_date_range(df, date_column, min_date, max_date)


class CustomerAnalytics:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, quantile_mode: str = "exact"):
        self.spark = spark
        self.settings = settings or Settings()
        self.quantile_mode = quantile_mode

    def calculate_rfm_metrics(self, sales_df: DataFrame, customer_df: DataFrame,
                              reference_date: str | None = None) -> DataFrame:
        return C.calculate_rfm(sales_df, customer_df, reference_date, self.settings, self.quantile_mode)

    def segment_customers(self, rfm_df: DataFrame) -> DataFrame:
        return C.segment_customers(rfm_df)

    def calculate_customer_lifetime_value(self, sales_df: DataFrame, customer_df: DataFrame,
                                          projection_months: int = 12) -> DataFrame:
        return C.calculate_clv(sales_df, customer_df, projection_months)

    def identify_churn_risk(self, sales_df: DataFrame, customer_df: DataFrame, inactivity_threshold_days: int = 180,
                            reference_date: str | None = None) -> DataFrame:
        return C.identify_churn_risk(sales_df, customer_df, reference_date, inactivity_threshold_days)

    def create_customer_360_view(self, customer_df: DataFrame, rfm_df: DataFrame, clv_df: DataFrame,
                                 churn_df: DataFrame) -> DataFrame:
        return C.customer_360(customer_df, rfm_df, clv_df, churn_df)


class SalesAnalytics:
    def __init__(self, spark: SparkSession, settings: Settings | None = None):
        self.spark = spark
        self.settings = settings or Settings()

    def calculate_daily_sales(self, sales_df: DataFrame) -> DataFrame:
        return S.daily_sales(sales_df, self.settings)

    def calculate_monthly_trends(self, sales_df: DataFrame) -> DataFrame:
        return S.monthly_trends(sales_df, settings=self.settings)

    def analyze_product_performance(self, sales_df: DataFrame, product_df: DataFrame) -> DataFrame:
        return S.product_performance(sales_df, product_df, self.settings)

    def calculate_category_performance(self, sales_df: DataFrame, product_df: DataFrame) -> DataFrame:
        return S.category_performance(sales_df, product_df, self.settings)

    def analyze_regional_performance(self, sales_df: DataFrame) -> DataFrame:
        return S.regional_performance(sales_df, self.settings)

    def calculate_sales_velocity(self, sales_df: DataFrame, window_days: int = 30) -> DataFrame:
        return S.sales_velocity(sales_df, window_days)

    def identify_top_customers(self, sales_df: DataFrame, top_n: int = 100) -> DataFrame:
        return C.top_customers(sales_df, top_n)
