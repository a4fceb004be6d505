"""Declared schemas of the four retail entities and a ``conform`` step.

File sources report every column as nullable, so declared NOT NULL columns are
checked by the quality operators, not by the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# fixed values: names, types and nullability of the four source files (the file contract)
SALES_SCHEMA = StructType([
    StructField("transaction_id", StringType(), False),
    StructField("transaction_date", TimestampType(), False),
    StructField("customer_id", StringType(), False),
    StructField("product_id", StringType(), False),
    StructField("quantity", IntegerType(), False),
    StructField("unit_price", DoubleType(), False),
    StructField("discount_percentage", DoubleType(), True),
    StructField("total_amount", DoubleType(), False),
    StructField("payment_method", StringType(), True),
    StructField("sales_channel", StringType(), True),
    StructField("region", StringType(), True),
    StructField("store_id", StringType(), True),
])

# The master-data segment is called market_segment so that it never clashes
# with the RFM label customer_segment in the single customer view.
CUSTOMER_SCHEMA = StructType([
    StructField("customer_id", StringType(), False),
    StructField("first_name", StringType(), True),
    StructField("last_name", StringType(), True),
    StructField("email", StringType(), True),
    StructField("phone", StringType(), True),
    StructField("registration_date", DateType(), False),
    StructField("country", StringType(), True),
    StructField("region", StringType(), True),
    StructField("city", StringType(), True),
    StructField("market_segment", StringType(), True),
    StructField("is_active", StringType(), True),
])

PRODUCT_SCHEMA = StructType([
    StructField("product_id", StringType(), False),
    StructField("product_name", StringType(), False),
    StructField("category", StringType(), True),
    StructField("subcategory", StringType(), True),
    StructField("brand", StringType(), True),
    StructField("unit_cost", DoubleType(), True),
    StructField("unit_price", DoubleType(), False),
    StructField("launch_date", DateType(), True),
    StructField("is_active", StringType(), True),
])

INVENTORY_SCHEMA = StructType([
    StructField("product_id", StringType(), False),
    StructField("warehouse_id", StringType(), False),
    StructField("quantity_on_hand", IntegerType(), False),
    StructField("quantity_reserved", IntegerType(), True),
    StructField("quantity_available", IntegerType(), False),
    StructField("reorder_point", IntegerType(), True),
    StructField("snapshot_date", DateType(), False),
])

SCHEMAS = {
    "sales": SALES_SCHEMA,
    "customers": CUSTOMER_SCHEMA,
    "products": PRODUCT_SCHEMA,
    "inventory": INVENTORY_SCHEMA,
}


def conform(df: DataFrame, schema: StructType, rename: dict | None = None, extra: list | None = None) -> DataFrame:
    """Cast and order the columns of ``df`` to ``schema``; missing columns become NULL.

    ``rename`` maps source names to schema names (e.g. a master-data
    ``customer_segment`` to ``market_segment``); where the source has both, the
    schema's own name goes first and the other fills its NULLs. Columns outside
    the schema are dropped, except the ``extra`` expressions.
    """
    rename = rename or {}
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        sources = [f.name] + [src for src, to in rename.items() if to == f.name and src != f.name]
        found = [F.col(f"`{c}`").cast(f.dataType) for c in sources if c in have]
        value = F.coalesce(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast(f.dataType)
        cols.append(value.alias(f.name))
    return df.select(*cols, *(extra or []))
