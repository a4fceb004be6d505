import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T  # noqa: E402

from tillscope.session import build_session, shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=4, app="tillscope-tests")
    shared_dir(s)
    yield s


def ts(s):
    return dt.datetime.fromisoformat(s)


SALES_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("transaction_date", T.TimestampType(), False),
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("product_id", T.StringType(), False),
    T.StructField("quantity", T.IntegerType(), False),
    T.StructField("unit_price", T.DoubleType(), False),
    T.StructField("discount_percentage", T.DoubleType(), True),
    T.StructField("total_amount", T.DoubleType(), False),
    T.StructField("sales_channel", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
])


@pytest.fixture(scope="session")
def sample_sales(spark):
    """Six sales of a small shop: three customers (one of them once), three products, three months."""
    rows = [
        ("a1", ts("2023-03-10"), "K-ada", "P-lamp", 4, 25.0, 0.0, 100.0, "Web", "Coast"),
        ("a2", ts("2023-03-10"), "K-ben", "P-lamp", 1, 25.0, 0.0, 25.0, "Shop", "Hills"),
        ("a3", ts("2023-03-12"), "K-ada", "P-rug", 2, 80.0, 0.25, 120.0, "Web", "Coast"),
        ("a4", ts("2023-04-15"), "K-ada", "P-mug", 10, 6.0, 0.0, 60.0, "Phone", "Coast"),
        ("a5", ts("2023-04-20"), "K-cy", "P-lamp", 8, 25.0, 0.1, 180.0, "Shop", "Plain"),
        ("a6", ts("2023-05-02"), "K-ben", "P-mug", 5, 6.0, 0.0, 30.0, "Web", "Hills"),
    ]
    return spark.createDataFrame(rows, SALES_SCHEMA)


@pytest.fixture(scope="session")
def sample_customers(spark):
    schema = "customer_id string, first_name string, last_name string, email string, registration_date date, " \
             "region string, is_active string"
    rows = [
        ("K-ada", "Ada", "Lind", "ada@mail.test", dt.date(2022, 5, 1), "Coast", "Y"),
        ("K-ben", "Ben", "Okoro", "ben@mail.test", dt.date(2022, 11, 20), "Hills", "N"),
        ("K-cy", "Cy", "Marsh", "cy@mail.test", dt.date(2023, 4, 20), "Plain", "Y"),
    ]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def customers_plus(spark, sample_customers):
    """The customers plus one without sales, with a master-data segment column."""
    from pyspark.sql import functions as F
    extra = spark.createDataFrame(
        [("K-dee", "Dee", "Ruiz", "dee@mail.test", dt.date(2023, 2, 2), "Plain", "N")], sample_customers.schema)
    return sample_customers.unionByName(extra).withColumn("customer_segment", F.lit("Trade"))


@pytest.fixture(scope="session")
def sample_products(spark):
    schema = "product_id string, product_name string, category string, subcategory string, unit_cost double, " \
             "unit_price double"
    rows = [
        ("P-lamp", "Desk lamp", "Home", "Lighting", 10.0, 25.0),
        ("P-rug", "Rug", "Textiles", "Floor", 50.0, 80.0),
        ("P-mug", "Mug", "Home", "Kitchen", 2.0, 6.0),
        ("P-kite", "Kite", "Outdoor", "Toys", None, 12.0),
    ]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def duplicate_rows(spark):
    return spark.createDataFrame([("d1", "K-ada", 7.5), ("d2", "K-cy", 20.0), ("d1", "K-ada", 7.5)],
                                 "transaction_id string, customer_id string, amount double")
