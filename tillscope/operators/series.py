"""Operators over ordered periods: seasonal forecast, change points, retention curve.

A series is folded in order inside one aggregate (``aggregate`` over the sorted
array of its periods), so the state of one period enters the next without a
window or a Python loop. A series has one entry a period, not a sale: sales are
summed by key and period before anything is gathered, and a hot product costs no
more than a quiet one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.columns import as_date, money_sum, safe_div
from tillscope.operators.customers import CUSTOMER_KEY, customer_fact


def monthly_series(sales_df: DataFrame, by: str, value: str = "quantity") -> DataFrame:
    """``by``, first_month, y: the monthly sums from the first to the last month of all sales, 0 where nothing sold.

    A key's series begins with its first month of sales.
    """
    month = F.trunc("transaction_date", "month")
    sums = sales_df.where(F.col(by).isNotNull() & F.col("transaction_date").isNotNull()) \
        .groupBy(by, month.alias("m")).agg(F.sum(value).cast("double").alias("q"))
    last = sales_df.select(F.max(month)).scalar()
    of_key = sums.groupBy(by).agg(F.min("m").alias("first_month"),
                                  F.map_from_entries(F.collect_list(F.struct("m", "q"))).alias("q"))
    of_key = of_key.withColumn("_months", F.sequence("first_month", last, F.expr("interval 1 month")))
    return of_key.select(by, "first_month", F.transform(
        "_months", lambda m: F.coalesce(F.try_element_at("q", m), F.lit(0.0))).alias("y"))



def holt_winters(series: DataFrame, period: int = 12, horizon: int = 3, alpha: float = 0.3, beta: float = 0.05,
                 gamma: float = 0.2) -> DataFrame:
    """Additive Holt-Winters state of each series ``y``, its forecast, and its rolling-origin error.

    The first ``period`` values set the level (their mean) and the seasonal
    offsets (value less level); the trend starts at 0. Every later value is
    forecast one step ahead from the state before it, and the mean absolute
    errors of that forecast and of the straight line through all earlier values
    are given side by side. A series of ``period`` values or fewer has no state:
    its forecast is null.

    Result: the columns of ``series`` without ``y``, periods, level, trend,
    forecast (array of the next ``horizon`` values, not below 0), mae, line_mae.
    """
    a, b, g = F.lit(float(alpha)), F.lit(float(beta)), F.lit(float(gamma))
    one, y = F.lit(1.0), F.col("y")
    first = F.slice(y, 1, period)
    # sums are taken in order, in doubles
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    mean = total(first) / F.lit(float(period))
    zero = F.lit(0.0)
    index = F.sequence(F.lit(period + 1), F.size(y))
    # sums of the earlier values and of position times value, for the straight line
    before = F.struct(total(first).alias("s"),
                      F.aggregate(F.sequence(F.lit(1), F.lit(period)), zero,
                                  lambda s, i: s + i.cast("double") * F.element_at(y, i)).alias("t"))
    start = F.struct(mean.alias("level"), zero.alias("trend"), F.transform(first, lambda v: v - mean).alias("season"),
                     zero.alias("error"), zero.alias("line_error"), before.alias("sums"))

    def step(st: Column, i: Column) -> Column:
        value = F.element_at(y, i)
        at = F.pmod(i - 1, F.lit(period)) + 1
        offset = F.element_at(st["season"], at.cast("int"))
        error = F.abs(value - (st["level"] + st["trend"] + offset))
        level = a * (value - offset) + (one - a) * (st["level"] + st["trend"])
        trend = b * (level - st["level"]) + (one - b) * st["trend"]
        new = g * (value - level) + (one - g) * offset
        season = F.transform(st["season"], lambda v, k: F.when(k == at - 1, new).otherwise(v))
        # the line through positions 1 to n - 1, at position n
        n = (i - 1).cast("double")
        sx, sxx = n * (n + 1) / 2, n * (n + 1) * (2 * n + 1) / 6
        slope = (n * st["sums"]["t"] - sx * st["sums"]["s"]) / (n * sxx - sx * sx)
        line = (st["sums"]["s"] - slope * sx) / n + slope * (n + 1)
        sums = F.struct((st["sums"]["s"] + value).alias("s"), (st["sums"]["t"] + i.cast("double") * value).alias("t"))
        return F.struct(level.alias("level"), trend.alias("trend"), season.alias("season"),
                        (st["error"] + error).alias("error"), (st["line_error"] + F.abs(value - line)).alias("line_error"),
                        sums.alias("sums"))

    enough = F.size(y) > period
    state = F.when(enough, F.aggregate(index, start, step))
    kept = [c for c in series.columns if c != "y"]
    out = series.select(*kept, F.size(y).alias("periods"), state.alias("st"))
    tested = (F.col("periods") - period).cast("double")
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.greatest(zero, (
        F.col("st.level") + h.cast("double") * F.col("st.trend") + F.element_at(
            "st.season", (F.pmod(F.col("periods") + h - 1, F.lit(period)) + 1).cast("int")))))
    return out.select(*kept, "periods", F.col("st.level").alias("level"), F.col("st.trend").alias("trend"),
                      F.when(F.col("st").isNotNull(), ahead).alias("forecast"),
                      safe_div("st.error", tested).alias("mae"), safe_div("st.line_error", tested).alias("line_mae"))


def seasonal_forecast(sales_df: DataFrame, by: str = "product_id", horizon: int = 3, **smoothing) -> DataFrame:
    """Holt-Winters over the monthly quantities of each ``by``, season of a year."""
    return holt_winters(monthly_series(sales_df, by), 12, horizon, **smoothing)


def change_points(sales_df: DataFrame, by: str = "region", threshold: float = 5.0, slack: float = 0.5) -> DataFrame:
    """Days on which the mean daily revenue of a ``by`` is found to have shifted: a two-sided CUSUM.

    A day's deviation from the key's mean, in standard deviations of its daily
    revenues, less ``slack``, is added up in both directions, never below 0. Where a
    sum passes ``threshold`` the day is reported with the direction and the day
    the sum last left 0 (where the shift began), and both sums start anew. A key
    whose revenue never varies has no shifts.
    """
    daily = sales_df.where(F.col(by).isNotNull() & F.col("transaction_date").isNotNull()) \
        .groupBy(by, F.to_date("transaction_date").alias("day")).agg(money_sum("total_amount").alias("x")) \
        .where("x IS NOT NULL")
    # squares and sums of whole cents are exact in any order
    cents = F.round(F.col("x") * 100).cast("decimal(38,0)")
    stats = daily.groupBy(by).agg(F.count("x").cast("double").alias("n"), F.sum(cents).cast("double").alias("s"),
                                  F.sum(cents * cents).cast("double").alias("ss"))
    mean = F.col("s") / F.col("n") / 100.0
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n")))) / 100.0
    series = daily.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("day", "x"))).alias("d"))
    rows = series.join(stats.select(by, mean.alias("mean"), spread.alias("sd")), by).where("sd > 0")
    k, h, zero, no_day = F.lit(float(slack)), F.lit(float(threshold)), F.lit(0.0), F.lit(None).cast("date")
    found = "array<struct<day:date,direction:string,since:date,score:double>>"

    def step(st: Column, d: Column) -> Column:
        z = (d["x"] - F.col("mean")) / F.col("sd")
        up, down = F.greatest(zero, st["up"] + z - k), F.greatest(zero, st["down"] - z - k)
        up_since = F.when(up > 0, F.coalesce(st["up_since"], d["day"]))
        down_since = F.when(down > 0, F.coalesce(st["down_since"], d["day"]))
        rose, hit = up > h, (up > h) | (down > h)
        entry = F.struct(d["day"].alias("day"), F.when(rose, "up").otherwise("down").alias("direction"),
                         F.when(rose, up_since).otherwise(down_since).alias("since"),
                         F.when(rose, up).otherwise(down).alias("score"))
        return F.struct(
            F.when(hit, zero).otherwise(up).alias("up"), F.when(hit, zero).otherwise(down).alias("down"),
            F.when(~hit, up_since).alias("up_since"), F.when(~hit, down_since).alias("down_since"),
            F.when(hit, F.concat(st["found"], F.array(entry))).otherwise(st["found"]).cast(found).alias("found"))
    start = F.struct(zero.alias("up"), zero.alias("down"), no_day.alias("up_since"), no_day.alias("down_since"),
                     F.array().cast(found).alias("found"))
    return rows.select(by, F.inline(F.aggregate("d", start, step)["found"])) \
        .select(by, F.col("day").alias("change_day"), "direction", F.col("since").alias("shift_began"), "score")


def retention_curve(sales_df: DataFrame, until, lapse_days: int = 180, step_days: int = 30,
                    by: str | None = None) -> DataFrame:
    """Kaplan-Meier curve of how long customers stay: the share still active after each step, with right censoring.

    A customer's time runs from the first sale to the last one up to ``until``. It
    ends (lapsed) where no sale followed for ``lapse_days``, and is censored (still
    active when last seen) where ``until`` came before that. Times count in whole
    steps of ``step_days``. At each step with a lapse: at_risk, lapsed, censored
    and survival, the product of (1 - lapsed / at_risk) up to it. ``by`` names a
    column of the sales by which customers are grouped, null a group of its own;
    without it all are one group.

    Customers are reduced to counts by step before anything is ordered; the curve
    itself has a row a step.
    """
    group = [by] if by else []
    day = as_date(until)
    past = sales_df.where(F.col(CUSTOMER_KEY).isNotNull() & (F.to_date("transaction_date") <= day))
    if by:
        past = past.withColumn("_g", F.col(by))
        spans = past.groupBy(CUSTOMER_KEY, "_g").agg(F.min("transaction_date").alias("first_purchase_date"),
                                                     F.max("transaction_date").alias("last_purchase_date"))
    else:
        spans = customer_fact(past)
    stay = F.floor(F.datediff("last_purchase_date", "first_purchase_date") / step_days).cast("int")
    lapsed = (F.datediff(day, "last_purchase_date") >= lapse_days).cast("long")
    counts = spans.select(*([F.col("_g").alias(by)] if by else []), stay.alias("step"), lapsed.alias("lapsed")) \
        .groupBy(*group, "step").agg(F.sum("lapsed").alias("lapsed"), F.count("*").alias("n"))
    entry = F.sort_array(F.collect_list(F.struct("step", "lapsed", "n")))
    curve = counts.groupBy(*group).agg(entry.alias("c"), F.sum("n").alias("total"))
    kind = "array<struct<step:int,at_risk:bigint,lapsed:bigint,censored:bigint,survival:double>>"

    def fold(st: Column, e: Column) -> Column:
        left = st["survival"] * (F.lit(1.0) - e["lapsed"].cast("double") / st["at_risk"].cast("double"))
        row = F.struct(e["step"].alias("step"), st["at_risk"].alias("at_risk"), e["lapsed"].alias("lapsed"),
                       (e["n"] - e["lapsed"]).alias("censored"), left.alias("survival"))
        return F.struct((st["at_risk"] - e["n"]).alias("at_risk"), left.alias("survival"),
                        F.concat(st["rows"], F.array(row)).cast(kind).alias("rows"))
    start = F.struct(F.col("total").alias("at_risk"), F.lit(1.0).alias("survival"), F.array().cast(kind).alias("rows"))
    return curve.select(*group, F.inline(F.aggregate("c", start, fold)["rows"]))
