"""The churn model learns from one window and is judged on the next."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tillscope.operators import churn_model as M


def _sales(spark):
    """Regular customers buy about every 10 days all year; leavers stop at a random day."""
    rng, rows = random.Random(4), []
    for c in range(240):
        stop = rng.randint(40, 300) if c % 2 else 400
        day = rng.randint(0, 20)
        while day < min(stop, 365):
            rows.append((f"T{len(rows)}", dt.datetime(2023, 1, 1) + dt.timedelta(days=day), f"C{c}",
                         float(rng.randint(5, 50))))
            day += rng.randint(5, 15)
    return spark.createDataFrame(rows, "transaction_id string, transaction_date timestamp, customer_id string, "
                                       "total_amount double")


def test_held_out_accuracy(spark):
    sales = _sales(spark).cache()
    scores = M.churn_scores(sales, "2023-06-30", "2023-10-31", horizon_days=45)
    truth = M.churn_labels(sales, "2023-10-31", 45).select("customer_id", "label")
    j = scores.join(truth, "customer_id")
    right = j.where(F.col("churn_predicted") == (F.col("label") == 1.0)).count()
    assert scores.count() == truth.count() == j.count() and right / j.count() > 0.9
    p = scores.agg(F.min("churn_probability"), F.max("churn_probability")).first()
    assert 0 <= p[0] < p[1] <= 1


def test_labels_of_one_kind(spark):
    sales = _sales(spark)
    out = M.churn_scores(sales, "2025-01-01", "2025-01-01", horizon_days=30)
    assert out.where("churn_probability = 1.0 AND churn_predicted").count() == out.count() > 0
