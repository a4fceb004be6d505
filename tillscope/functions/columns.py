"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_date(value) -> Column:
    """A reference date parameter as a DATE column; ``None`` means today."""
    if value is None:
        return F.current_date()
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, (_dt.date, _dt.datetime)):
        value = value.strftime("%Y-%m-%d")
    return F.to_date(F.lit(value))


def day_range(df, column: str, min_day=None, max_day=None) -> Column:
    """Predicate: the day of ``column`` lies in [min_day, max_day] (bounds optional).

    Written as a half-open range on the column's own type
    (``col >= min_day AND col < max_day + 1 day``) so that it is pushed down
    to the file scan; a timestamp on the last day is kept whatever its time.
    """
    from pyspark.sql.types import DateType, TimestampNTZType, TimestampType
    dtype = df.schema[column].dataType
    c = F.col(column)
    pred = F.lit(True)
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        tname = "timestamp_ntz" if isinstance(dtype, TimestampNTZType) else "timestamp"
        if min_day is not None:
            pred = pred & (c >= as_date(min_day).cast(tname))
        if max_day is not None:
            pred = pred & (c < F.date_add(as_date(max_day), 1).cast(tname))
        return pred
    d = c if isinstance(dtype, DateType) else F.to_date(c)
    if min_day is not None:
        pred = pred & (d >= as_date(min_day))
    if max_day is not None:
        pred = pred & (d <= as_date(max_day))
    return pred


def distinct_count(x, settings=None) -> Column:
    """Distinct count of ``x``: exact by default, a HyperLogLog++ sketch when
    ``settings.distinct_mode == "approx"``."""
    if settings is not None and settings.distinct_mode == "approx":
        return F.approx_count_distinct(_c(x), settings.approx_distinct_rsd)
    return F.countDistinct(_c(x))


def money(x) -> Column:
    """Money leaves the library as DOUBLE (exact DECIMAL sums are cast at the end)."""
    return _c(x).cast("double")


def money_sum(x) -> Column:
    """Sum of an amount. DECIMAL inputs sum exactly (order independent), then DOUBLE."""
    return F.sum(_c(x)).cast("double")


def money_avg(x) -> Column:
    """Average = exact sum / count of non-null values, as DOUBLE."""
    return F.try_divide(F.sum(_c(x)).cast("double"), F.count(_c(x)))


def safe_div(num, den) -> Column:
    """Division that yields NULL on a zero or NULL divisor (ANSI mode raises otherwise)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct(num, den) -> Column:
    return safe_div(num, den) * F.lit(100.0)


def year_month_label(ts) -> Column:
    """'YYYY-MM' label of a date/timestamp."""
    return F.date_format(_c(ts), "yyyy-MM")


def score_low_is_good(x, thresholds) -> Column:
    """Quintile score where small values are best (recency): <=t1 -> 5 ... else 1.

    ``thresholds`` is an array column (t1..t4); a NULL metric scores 1 because no
    comparison holds.
    """
    x = _c(x)
    t = thresholds
    return (F.when(x <= t[0], 5).when(x <= t[1], 4).when(x <= t[2], 3)
            .when(x <= t[3], 2).otherwise(1))


def score_high_is_good(x, thresholds) -> Column:
    """Quintile score where large values are best (frequency, monetary): >=t4 -> 5 ... else 1."""
    x = _c(x)
    t = thresholds
    return (F.when(x >= t[3], 5).when(x >= t[2], 4).when(x >= t[1], 3)
            .when(x >= t[0], 2).otherwise(1))


# fixed values: churn labels
CHURN_HIGH = "High"
CHURN_MEDIUM = "Medium"
CHURN_LOW = "Low"

# fixed values: segment names of the RFM rules, first match wins
SEGMENT_CHAMPIONS = "Champions"
SEGMENT_LOYAL = "Loyal Customers"
SEGMENT_NEW = "New Customers"
SEGMENT_AT_RISK = "At Risk"
SEGMENT_HIBERNATING = "Hibernating High Value"
SEGMENT_LOST = "Lost Customers"
SEGMENT_POTENTIAL = "Potential Loyalists"


def rfm_segment(r="recency_score", f="frequency_score", m="monetary_score") -> Column:
    """Segment label from R, F, M scores; rules are tried in order, NULL scores fall through."""
    r, f, m = _c(r), _c(f), _c(m)
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), SEGMENT_CHAMPIONS)
        .when((r >= 3) & (f >= 3) & (m >= 3), SEGMENT_LOYAL)
        .when((r >= 4) & (f <= 2), SEGMENT_NEW)
        .when((r <= 2) & (f >= 4), SEGMENT_AT_RISK)
        .when((r <= 2) & (f <= 2) & (m >= 4), SEGMENT_HIBERNATING)
        .when(r <= 2, SEGMENT_LOST)
        .otherwise(SEGMENT_POTENTIAL)
    )


def churn_label(days, threshold_days: int = 180, medium_ratio: float = 0.7) -> Column:
    """High when inactive >= threshold days, Medium when >= ratio * threshold, else Low.

    Apply it on the per-customer aggregate *before* the left join to the
    customer master, so customers without sales keep a NULL label.
    """
    d = _c(days)
    return (F.when(d >= F.lit(threshold_days), CHURN_HIGH)
            .when(d >= F.lit(threshold_days * medium_ratio), CHURN_MEDIUM)
            .otherwise(CHURN_LOW))
