"""A churn model with a time split, fitted by Spark's logistic regression.

Features of a customer are measured on the sales up to a cut-off day; the
customer churned when no sale follows within the horizon after it. The split is
in time: the model is fitted on the label window that ends where the scored
features end, so nothing of the scored period is seen in training.

At most ``max_training_rows`` labelled customers (the least by a hash of the id)
train the model; every customer is scored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.columns import as_date, day_range, safe_div
from tillscope.operators.customers import CUSTOMER_KEY, customer_fact
from tillscope.settings import DEFAULT, Settings

#: None of them grows just because the cut-off is later: a model of one window holds for the next.
FEATURES = ("recency_days", "days_between", "overdue", "purchase_rate", "avg_amount")


def churn_features(sales_df: DataFrame, cutoff) -> DataFrame:
    """Per customer with sales up to the cut-off day: days since the last sale, mean days between sales, the one
    relative to the other, sales a day since the first, and the average amount."""
    past = sales_df.where(day_range(sales_df, "transaction_date", None, cutoff))
    day = as_date(cutoff)
    f = customer_fact(past).where(F.col(CUSTOMER_KEY).isNotNull())
    n = F.col("transaction_count").cast("double")
    recency = F.datediff(day, "last_purchase_date").cast("double")
    between = F.datediff("last_purchase_date", "first_purchase_date") / F.greatest(n - 1, F.lit(1.0))
    since_first = F.datediff(day, "first_purchase_date").cast("double")
    return f.select(
        CUSTOMER_KEY, recency.alias("recency_days"), between.alias("days_between"),
        (recency / (between + 1)).alias("overdue"), (n / (since_first + 1)).alias("purchase_rate"),
        F.coalesce(safe_div("_revenue", "_amount_count"), F.lit(0.0)).alias("avg_amount"))


def churn_labels(sales_df: DataFrame, cutoff, horizon_days: int | None = None,
                 settings: Settings = DEFAULT) -> DataFrame:
    """``churn_features`` with ``label``: 1.0 when no sale follows within the horizon (default: the churn days)."""
    horizon = settings.churn_days if horizon_days is None else horizon_days
    d, day = F.to_date("transaction_date"), as_date(cutoff)
    back = sales_df.where((d > day) & (d <= F.date_add(day, horizon))).select(CUSTOMER_KEY).distinct() \
        .withColumn("_back", F.lit(0.0))
    return churn_features(sales_df, cutoff).join(back, CUSTOMER_KEY, "left") \
        .withColumn("label", F.coalesce("_back", F.lit(1.0))).drop("_back")


def fit_churn_model(labelled: DataFrame, max_training_rows: int = 200_000) -> PipelineModel:
    """Scaled logistic regression over a bounded sample of labelled customers."""
    sample = labelled.orderBy(F.xxhash64(CUSTOMER_KEY), CUSTOMER_KEY).limit(max_training_rows)
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(FEATURES), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(maxIter=50, regParam=0.01),
    ]).fit(sample)


def churn_scores(sales_df: DataFrame, train_cutoff, score_cutoff, horizon_days: int | None = None,
                 max_training_rows: int = 200_000, settings: Settings = DEFAULT) -> DataFrame:
    """customer_id, the features at ``score_cutoff``, churn_probability, churn_predicted.

    With labels of one kind only, every probability is that label."""
    labelled = churn_labels(sales_df, train_cutoff, horizon_days, settings)
    kinds = labelled.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    scored = churn_features(sales_df, score_cutoff)
    if kinds["lo"] == kinds["hi"]:
        p = F.lit(kinds["lo"]).cast("double")
        return scored.withColumn("churn_probability", p).withColumn("churn_predicted", p > 0.5)
    out = fit_churn_model(labelled, max_training_rows).transform(scored)
    p = vector_to_array("probability")[1]
    return out.select(CUSTOMER_KEY, *FEATURES, p.alias("churn_probability"), (p > 0.5).alias("churn_predicted"))
