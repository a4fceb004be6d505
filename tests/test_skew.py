"""Hot keys: a third of all rows on one customer, one product and one transaction id."""

import datetime as dt
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillscope.operators import customers as C
from tillscope.operators import quality as Q
from tillscope.operators import sales as S

N = 3000


@pytest.fixture(scope="module")
def skewed(spark):
    rows = []
    for i in range(N):
        hot = i % 3 == 0
        rows.append((
            "TXHOT" if hot and i % 2 == 0 else f"T{i}",
            dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 90),
            "C0" if hot else f"C{i % 200}",
            "P0" if hot else f"P{i % 50}",
            1 + i % 4,
            float(10 + i % 17),
        ))
    df = spark.createDataFrame(rows, "transaction_id string, transaction_date timestamp, customer_id string, "
                                     "product_id string, quantity int, total_amount double").repartition(6)
    return rows, df


def test_customer_measures_under_skew(spark, skewed):
    rows, df = skewed
    rev, cnt = defaultdict(float), Counter()
    for r in rows:
        rev[r[2]] += r[5]
        cnt[r[2]] += 1
    got = {r["customer_id"]: (r["frequency"], r["monetary_value"]) for r in C.rfm_metrics(df, "2024-06-01").collect()}
    assert got["C0"] == (cnt["C0"], pytest.approx(rev["C0"])) and len(got) == len(cnt)
    top = C.top_customers(df, 3).collect()
    assert top[0]["customer_id"] == "C0" and [r["revenue_rank"] for r in top] == [1, 2, 3]
    master = spark.createDataFrame([(c,) for c in cnt], "customer_id string")
    view = C.customer_360_from_sales(df, master, "2024-06-01")
    assert view.count() == len(cnt) and view.where(F.col("customer_segment").isNull()).count() == 0


def test_dedup_and_report_under_skew(skewed):
    rows, df = skewed
    ids = {r[0] for r in rows}
    assert Q.remove_duplicates(df, ["transaction_id"]).count() == len(ids)
    rep = {r["check"]: r["observed"] for r in Q.quality_report(df, "s").collect() if r["column_name"] is None}
    assert rep["record_count"] == N
    assert rep["duplicates"] == pytest.approx((N - len(set(rows))) / N)


def test_product_rank_under_skew(spark, skewed):
    rows, df = skewed
    rev = defaultdict(float)
    for r in rows:
        rev[r[3]] += r[5]
    products = spark.createDataFrame([(p, p, "cat", 1.0) for p in rev], "product_id string, product_name string, "
                                                                      "category string, unit_cost double")
    got = {r["product_id"]: r["revenue_rank"] for r in S.product_performance(df, products).collect()}
    want = {p: i + 1 for i, p in enumerate(sorted(rev, key=lambda p: (-rev[p], p)))}
    assert got == want
