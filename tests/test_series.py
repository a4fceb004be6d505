"""Seasonal forecasts, change points and retention curves against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tillscope.operators import series as SE


def plain_holt_winters(y, period, horizon, a=0.3, b=0.05, g=0.2):
    if len(y) <= period:
        return None
    level, trend = sum(y[:period]) / period, 0.0
    season, error = [v - level for v in y[:period]], 0.0
    for i in range(period, len(y)):
        s = season[i % period]
        error += abs(y[i] - (level + trend + s))
        new = a * (y[i] - s) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        level = new
        season[i % period] = g * (y[i] - level) + (1 - g) * s
    return level, trend, [max(0.0, level + h * trend + season[(len(y) + h - 1) % period]) for h in range(1, horizon + 1)], \
        error / (len(y) - period)


def test_holt_winters_matches_the_plain_recurrence(spark):
    rng = random.Random(4)
    rows = [(k, [float(rng.randrange(0, 60)) for _ in range(n)]) for k, n in enumerate([1, 4, 5, 9, 40, 80])]
    out = {r["k"]: r for r in SE.holt_winters(spark.createDataFrame(rows, "k int, y array<double>"), 4, 6).collect()}
    for k, y in rows:
        want, r = plain_holt_winters(y, 4, 6), out[k]
        assert r["periods"] == len(y)
        if want is None:
            assert r["level"] is None and r["forecast"] is None and r["mae"] is None
        else:
            assert r["level"] == pytest.approx(want[0]) and r["trend"] == pytest.approx(want[1])
            assert r["forecast"] == pytest.approx(want[2]) and r["mae"] == pytest.approx(want[3])


def test_a_seasonal_product_is_forecast_better_than_by_a_line(spark):
    rng = random.Random(6)
    rows = []
    for month in range(60):
        day = dt.datetime(2019 + month // 12, month % 12 + 1, 10)
        q = int(100 + 60 * math.sin(2 * math.pi * month / 12) + month + rng.randrange(8))
        rows += [("ice", day, q), ("flat", day, 50 + rng.randrange(3))]
    sales = spark.createDataFrame(rows, "product_id string, transaction_date timestamp, quantity int")
    out = {r["product_id"]: r for r in SE.seasonal_forecast(sales).collect()}
    assert out["ice"]["mae"] < 0.4 * out["ice"]["line_mae"]
    want = [100 + 60 * math.sin(2 * math.pi * m / 12) + m + 3.5 for m in range(60, 63)]
    assert out["ice"]["forecast"] == pytest.approx(want, rel=0.15)


def test_months_without_sales_are_zeros(spark):
    rows = [("p", dt.datetime(2024, 1, 31), 2), ("p", dt.datetime(2024, 4, 1), 3), ("q", dt.datetime(2024, 6, 5), 1),
            (None, dt.datetime(2024, 2, 1), 9), ("p", None, 9)]
    sales = spark.createDataFrame(rows, "product_id string, transaction_date timestamp, quantity int")
    got = {r["product_id"]: r["y"] for r in SE.monthly_series(sales, "product_id").collect()}
    assert got == {"p": [2.0, 0.0, 0.0, 3.0, 0.0, 0.0], "q": [1.0]}


def test_a_planted_shift_is_found_near_its_day(spark):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    rows = [("up", start + dt.timedelta(days=d), rng.gauss(100 if d < 120 else 130, 10)) for d in range(180)]
    rows += [("calm", start + dt.timedelta(days=d), 70.0) for d in range(180)]
    sales = spark.createDataFrame(rows, "region string, transaction_date timestamp, total_amount double")
    out = SE.change_points(sales, threshold=6.0, slack=0.6).orderBy("change_day").collect()
    assert {r["region"] for r in out} == {"up"}
    ups = [r for r in out if r["direction"] == "up"]
    assert ups and abs((ups[0]["shift_began"] - dt.date(2024, 4, 30)).days) <= 5
    assert all(r["score"] > 6.0 for r in out)


def plain_curve(spans, until, lapse, step):
    rows = [((z - a).days // step, (until - z).days >= lapse) for a, z in spans]
    out, survival = [], 1.0
    for s in sorted({s for s, _ in rows}):
        at_risk = sum(x >= s for x, _ in rows)
        lapsed = sum(x == s and gone for x, gone in rows)
        survival *= 1 - lapsed / at_risk
        out.append((s, at_risk, lapsed, sum(x == s and not gone for x, gone in rows), pytest.approx(survival)))
    return out


def test_retention_curve_with_censored_customers(spark):
    rng = random.Random(9)
    first = dt.datetime(2023, 1, 1)
    rows, spans = [], []
    for c in range(200):
        a = first + dt.timedelta(days=rng.randrange(200))
        days = sorted({0, *(rng.randrange(0, 400) for _ in range(rng.randrange(5)))})
        rows += [(f"c{c}", a + dt.timedelta(days=d)) for d in days]
        inside = [a + dt.timedelta(days=d) for d in days if a + dt.timedelta(days=d) < dt.datetime(2024, 1, 1)]
        spans.append((min(inside), max(inside)))
    rows += [(None, first), ("late", dt.datetime(2024, 5, 1))]
    sales = spark.createDataFrame(rows, "customer_id string, transaction_date timestamp") \
        .withColumns({"transaction_id": F.lit("t"), "total_amount": F.lit(1.0)})
    got = [tuple(r) for r in SE.retention_curve(sales, "2023-12-31", 90, 30).orderBy("step").collect()]
    want = plain_curve(spans, dt.datetime(2023, 12, 31), 90, 30)
    assert got == want and any(r[3] for r in want) and got[-1][4].__class__ is float


def test_empty_tables(spark):
    sales = spark.createDataFrame([], "customer_id string, product_id string, region string, transaction_id string, "
                                      "transaction_date timestamp, quantity int, total_amount double")
    assert SE.seasonal_forecast(sales).count() == 0 and SE.change_points(sales).count() == 0
    assert SE.retention_curve(sales, "2024-01-01").count() == 0
    assert SE.retention_curve(sales, "2024-01-01", by="region").count() == 0
