"""Data quality checks and cleaning.

The checks return DataFrames (one row per check or per column), built with as
few passes as possible: record count and every null count come from one
aggregate, the whole-row duplicate count from one grouped aggregate. A
``validate_dataframe`` facade collects them into the dictionary report of the
original API (the only place that runs an action, on a few small rows).

Deduplication is deterministic: per key the row with the smallest tie-break
tuple is kept. It is an aggregate (``min`` of a struct), so a key holding a
third of all rows is reduced map-side before the shuffle instead of being
sorted in one task.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from tillscope.settings import DEFAULT, Settings

_log = logging.getLogger(__name__)


# ---------------------------------------------------------------- profiles

def null_profile(df: DataFrame, max_null_fraction: float | None = None,
                 settings: Settings = DEFAULT) -> DataFrame:
    """Per column: null_count, null_fraction (0 on an empty table) and whether it
    stays within the bound (violation when the fraction is strictly greater)."""
    bound = settings.max_null_percentage if max_null_fraction is None else max_null_fraction
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__total"),
                  *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"__n{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"__n{i}").cast("long").alias("null_count"),
                     F.when(F.col("__total") > 0, F.col(f"__n{i}") / F.col("__total")).otherwise(F.lit(0.0))
                     .alias("null_fraction")) for i, c in enumerate(cols)]
    return wide.select(F.inline(F.array(*rows))).withColumn("passed", F.col("null_fraction") <= F.lit(bound))


def _fingerprint(refs: Sequence[Column]) -> list[Column]:
    """96 bits of a row; a hash skips NULLs, so which columns are NULL is part of the key."""
    flags = [r.isNull() for r in refs]
    return [F.xxhash64(*refs, *flags).alias("__h1"), F.hash(*flags, *refs).alias("__h2")]


def _distinct_of_repeated(df: DataFrame, refs: Sequence[Column], groups: DataFrame) -> Column:
    """Distinct rows among those whose fingerprint (a row of ``groups`` with its count ``__c``) occurs more
    than once: the only rows that are compared in full."""
    again = groups.where("__c > 1").select("__h1", "__h2")
    full = df.select("*", *_fingerprint(refs)).join(again, ["__h1", "__h2"], "left_semi")
    return full.groupBy(*refs).agg(F.lit(1).alias("__one")).agg(F.count(F.lit(1))).scalar()


def duplicate_profile(df: DataFrame, subset: Sequence[str] | None = None,
                      threshold: float | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """total_records, distinct_records, duplicate_count, duplicate_fraction and
    passed (fraction <= threshold), over whole rows or a key subset, in one job
    (``settings.duplicate_mode == "hash"`` groups on a 96-bit fingerprint and
    compares in full only the rows whose fingerprint occurs again: the same
    exact answer, with few wide rows in a shuffle)."""
    bound = settings.duplicate_threshold if threshold is None else threshold
    keys = [F.col(f"`{k}`") for k in (list(subset) if subset else df.columns)]
    hashed = settings.duplicate_mode == "hash"
    groups = df.groupBy(*(_fingerprint(keys) if hashed else keys)).agg(F.count(F.lit(1)).alias("__c"))
    total = F.coalesce(F.sum("__c"), F.lit(0)).cast("long").alias("total_records")
    if hashed:
        g = groups.agg(total, F.count_if(F.col("__c") == 1).alias("__single")).select(
            "total_records", (F.col("__single") + _distinct_of_repeated(df, keys, groups)).alias("distinct_records"))
    else:
        g = groups.agg(total, F.count(F.lit(1)).alias("distinct_records"))
    g = g.withColumn("duplicate_count", F.col("total_records") - F.col("distinct_records"))
    frac = F.when(F.col("total_records") > 0, F.col("duplicate_count") / F.col("total_records")).otherwise(0.0)
    return g.withColumn("duplicate_fraction", frac).withColumn("passed", F.col("duplicate_fraction") <= F.lit(bound))


def duplicate_keys(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Total rows, distinct key values and their difference."""
    g = df.agg(F.count(F.lit(1)).alias("total_records"), F.countDistinct(key).alias("distinct_keys"))
    return g.withColumn("duplicate_count", F.col("total_records") - F.col("distinct_keys"))


def _date_like(name: str) -> bool:
    tokens = name.lower().replace("-", "_").split("_")
    return any(t in ("date", "timestamp", "ts", "time") for t in tokens) or name.lower().endswith("date")


def type_issues(df: DataFrame) -> list[dict]:
    """Columns whose name says date/timestamp but whose type is not temporal
    (schema only, no job). TIMESTAMP_NTZ counts as temporal."""
    out = []
    for f in df.schema.fields:
        if _date_like(f.name) and not isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            out.append({"column": f.name, "expected_type": "date/timestamp", "actual_type": f.dataType.simpleString()})
    return out


def quality_report(df: DataFrame, dataset_name: str, required_columns: Sequence[str] | None = None,
                   settings: Settings = DEFAULT) -> DataFrame:
    """Typed report: (dataset, check, column_name, observed, threshold, passed).

    Checks: record_count (>= min_record_count), required_columns (only when
    given), null_values per column (<= max_null_percentage), duplicates
    (whole rows, fraction <= duplicate_threshold), data_types; the row
    ``overall`` passes when every other row passes.

    One shuffle for everything: rows are grouped on all columns (partial
    aggregation first), and the record count, distinct count and every
    column's null count are sums over those groups weighted by group size.
    With ``settings.duplicate_mode == "hash"`` the grouping key is a 96-bit
    row fingerprint instead of the full row, and only rows whose fingerprint
    occurs again are compared in full (see ``Settings``).
    """
    cols = df.columns
    refs = [F.col(f"`{c}`") for c in cols]
    if settings.duplicate_mode == "hash":
        # group on a 96-bit row fingerprint; per-group null counts travel with
        # it, so the shuffle carries a few numbers per distinct row, not the row
        groups = df.groupBy(*_fingerprint(refs)).agg(
            F.count(F.lit(1)).alias("__c"),
            *[F.count_if(r.isNull()).alias(f"__g{i}") for i, r in enumerate(refs)])
        distinct = F.count_if(F.col("__c") == 1)
        nulls = [F.coalesce(F.sum(f"__g{i}"), F.lit(0)).alias(f"__n{i}") for i in range(len(cols))]
    else:
        groups = df.groupBy(*refs).agg(F.count(F.lit(1)).alias("__c"))
        distinct = F.count(F.lit(1))
        nulls = [F.coalesce(F.sum(F.when(r.isNull(), F.col("__c"))), F.lit(0)).alias(f"__n{i}")
                 for i, r in enumerate(refs)]
    wide = groups.agg(
        F.coalesce(F.sum("__c"), F.lit(0)).cast("long").alias("__total"),
        distinct.alias("__distinct"), *nulls)
    if settings.duplicate_mode == "hash":
        wide = wide.withColumn("__distinct", F.col("__distinct") + _distinct_of_repeated(df, refs, groups))
    total = F.col("__total").cast("double")

    def row(check, column, observed, threshold, passed):
        return F.struct(F.lit(check).alias("check"), F.lit(column).cast("string").alias("column_name"),
                        observed.cast("double").alias("observed"), F.lit(float(threshold)).alias("threshold"),
                        passed.alias("passed"))

    rows = [row("record_count", None, total, settings.min_record_count,
                total >= F.lit(float(settings.min_record_count)))]
    if required_columns:
        missing = sorted(set(required_columns) - set(cols))
        rows.append(row("required_columns", ",".join(missing) or None, F.lit(len(missing)), 0, F.lit(not missing)))
    for i, c in enumerate(cols):
        frac = F.when(total > 0, F.col(f"__n{i}") / total).otherwise(F.lit(0.0))
        rows.append(row("null_values", c, frac, settings.max_null_percentage,
                        frac <= F.lit(settings.max_null_percentage)))
    dup = F.when(total > 0, (F.col("__total") - F.col("__distinct")) / total).otherwise(F.lit(0.0))
    rows.append(row("duplicates", None, dup, settings.duplicate_threshold,
                    dup <= F.lit(settings.duplicate_threshold)))
    issues = type_issues(df)
    rows.append(row("data_types", ",".join(i["column"] for i in issues) or None, F.lit(len(issues)), 0,
                    F.lit(not issues)))
    ok = F.lit(True)
    for r in rows:
        ok = ok & r.getField("passed")
    rows.append(row("overall", None, ok.cast("int"), 1, ok))
    return wide.select(F.inline(F.array(*rows))).select(F.lit(dataset_name).alias("dataset"), "*")


def validate_dataframe(df: DataFrame, dataset_name: str, required_columns: Sequence[str] | None = None,
                       settings: Settings = DEFAULT) -> tuple[DataFrame, dict]:
    """Dictionary facade over ``quality_report``: returns (df unchanged, report).

    One job; collects only the report rows (one per column plus a few)."""
    rows = quality_report(df, dataset_name, required_columns, settings).collect()
    by = {}
    for r in rows:
        by.setdefault(r["check"], []).append(r)
    count = int(by["record_count"][0]["observed"])
    report = {"dataset_name": dataset_name, "checks": {}}
    report["checks"]["record_count"] = {"total_records": count, "passed": by["record_count"][0]["passed"],
                                        "threshold": settings.min_record_count}
    if required_columns:
        missing = sorted(set(required_columns) - set(df.columns))
        report["checks"]["required_columns"] = {"missing_columns": missing, "passed": not missing}
    nulls = {r["column_name"]: r["observed"] for r in by.get("null_values", [])}
    violations = {c: p for c, p in nulls.items() if p > settings.max_null_percentage}
    report["checks"]["null_values"] = {"null_percentages": nulls, "violations": violations,
                                       "passed": not violations, "threshold": settings.max_null_percentage}
    dup = by["duplicates"][0]
    dup_count = int(round(dup["observed"] * count))
    report["checks"]["duplicates"] = {
        "total_records": count, "distinct_records": count - dup_count, "duplicate_count": dup_count,
        "duplicate_percentage": dup["observed"], "passed": dup["passed"], "threshold": settings.duplicate_threshold}
    issues = type_issues(df)
    report["checks"]["data_types"] = {"type_issues": issues, "passed": not issues}
    report["overall_status"] = "PASSED" if by["overall"][0]["passed"] else "FAILED"
    return df, report


# ---------------------------------------------------------------- cleaning

def _keep_one(df: DataFrame, keys: list[str], order_by: Sequence[str] | None):
    """Per key, the row with the smallest (order_by..., rest...) tuple (NULLs first), as an aggregate."""
    order = [c for c in (order_by or []) if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order]
    fields = order + rest
    packed = F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(fields)])
    g = df.groupBy(*keys).agg(F.min(packed).alias("__best"))
    return g.select(*keys, *[F.col(f"__best.f{i}").alias(c) for i, c in enumerate(fields)]).select(*df.columns)


def remove_duplicates(df: DataFrame, subset: Sequence[str] | None = None,
                      order_by: Sequence[str] | None = None) -> DataFrame:
    """Drop duplicates. Whole rows: ``distinct``. By key: keep, per key, the row
    whose (order_by..., remaining columns...) tuple is smallest (NULLs first),
    a deterministic choice computed as an aggregate."""
    if not subset:
        return df.distinct()
    keys = list(subset)
    if not [c for c in df.columns if c not in keys]:
        return df.select(*keys).distinct().select(*df.columns)
    return _keep_one(df, keys, order_by)


def handle_null_values(df: DataFrame, strategy: str = "drop", fill_values: dict | None = None) -> DataFrame:
    """``drop``: rows with any NULL removed; ``fill``: NULLs replaced per column;
    anything else returns the input unchanged."""
    if strategy == "drop":
        return df.na.drop()
    if strategy == "fill" and fill_values:
        return df.na.fill(fill_values)
    _log.warning("no null handling applied (strategy=%r, fill values given: %s)", strategy, bool(fill_values))
    return df


def _day(col: str) -> Column:
    return F.to_date(F.col(col))


def date_range_filter(df: DataFrame, date_column: str, min_date: str | None = None,
                      max_date: str | None = None) -> DataFrame:
    """Rows whose day lies in [min_date, max_date] (each bound optional, inclusive).
    The whole last day is kept; the predicate is a sargable range (pushed to the scan)."""
    from tillscope.functions.columns import day_range
    if not min_date and not max_date:
        return df
    return df.where(day_range(df, date_column, min_date or None, max_date or None))


def configured_date_range(df: DataFrame, date_column: str, settings: Settings = DEFAULT) -> DataFrame:
    """Rows whose day lies in the configured range (``date_range_start`` to ``date_range_end``)."""
    return date_range_filter(df, date_column, settings.date_range_start, settings.date_range_end)


def date_range_report(df: DataFrame, date_column: str, min_date: str | None = None,
                      max_date: str | None = None) -> DataFrame:
    """One row: total, valid, invalid (out of range), null dates, range, passed."""
    d = _day(date_column)
    ok = F.lit(True)
    if min_date:
        ok = ok & (d >= F.to_date(F.lit(min_date)))
    if max_date:
        ok = ok & (d <= F.to_date(F.lit(max_date)))
    g = df.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(ok).alias("valid_records"),
               F.count_if(d.isNull()).alias("null_dates"))
    return g.select("total_records", "valid_records",
                    (F.col("total_records") - F.col("valid_records")).alias("invalid_records"), "null_dates",
                    F.lit(f"{min_date} to {max_date}").alias("date_range"),
                    (F.col("total_records") == F.col("valid_records")).alias("passed"))


def validate_date_range(df: DataFrame, date_column: str, min_date: str | None = None,
                        max_date: str | None = None) -> tuple[DataFrame, dict]:
    rep = date_range_report(df, date_column, min_date, max_date).collect()[0].asDict()
    return date_range_filter(df, date_column, min_date, max_date), rep


# ---------------------------------------------------------------- silver rules

SALES_KEYS = ("transaction_id", "customer_id", "product_id", "total_amount")


def sales_rules(settings: Settings = DEFAULT) -> dict[str, Column]:
    """Named predicates a clean sale must satisfy (NULL counts as a failure)."""
    amt, qty = F.col("total_amount"), F.col("quantity")
    rules = {f"{k}_not_null": F.col(k).isNotNull() for k in SALES_KEYS}
    rules["valid_amount"] = (amt > 0) & (amt < F.lit(settings.max_amount))
    rules["valid_quantity"] = (qty > 0) & (qty <= F.lit(settings.max_quantity))
    return rules


def valid_sale(settings: Settings = DEFAULT) -> Column:
    """A sale that meets every rule (an unknown outcome is a failure)."""
    ok = F.lit(True)
    for rule in sales_rules(settings).values():
        ok = ok & rule
    return F.coalesce(ok, F.lit(False))


def flag_sales(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    amt, qty = F.col("total_amount"), F.col("quantity")
    return df.withColumns({
        "is_valid_amount": (amt > 0) & (amt < F.lit(settings.max_amount)),
        "is_valid_quantity": (qty > 0) & (qty <= F.lit(settings.max_quantity)),
    })


def silver_sales(df: DataFrame, settings: Settings = DEFAULT, order_by: Sequence[str] | None = None) -> DataFrame:
    """Cleaned sales: the rows with non-null keys, a valid amount (0 < amount < max)
    and a valid quantity (0 < qty <= max), one per transaction id; the two flags
    are kept as columns.

    The rules come before the choice among the copies of an id, so an id with
    any valid copy stays (and invalid rows are not shuffled)."""
    return flag_sales(remove_duplicates(df.where(valid_sale(settings)), ["transaction_id"], order_by), settings)


def reject_reasons(settings: Settings = DEFAULT, rules: dict[str, Column] | None = None) -> Column:
    """Array of the names of the rules a row breaks (empty when clean).

    ``rules`` maps a rule name to a boolean Column (the extension point: any
    predicate over the row); default: the sales rules. A NULL outcome fails."""
    rules = sales_rules(settings) if rules is None else rules
    checks = [F.when(~F.coalesce(pred, F.lit(False)), F.lit(name)) for name, pred in rules.items()]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def split_quarantine(df: DataFrame, settings: Settings = DEFAULT,
                     rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean rows, rejected rows with ``reject_reasons``) from one rule list."""
    tagged = df.withColumn("reject_reasons", reject_reasons(settings, rules))
    clean = tagged.where(F.size("reject_reasons") == 0).drop("reject_reasons")
    bad = tagged.where(F.size("reject_reasons") > 0)
    return clean, bad


def reject_summary(rejected: DataFrame) -> DataFrame:
    """Rejected rows per broken rule."""
    return rejected.select(F.explode("reject_reasons").alias("reason")).groupBy("reason") \
        .agg(F.count(F.lit(1)).alias("rejected_records"))


def silver_reconciliation(bronze: DataFrame, silver: DataFrame | None = None, rejected: DataFrame | None = None,
                          settings: Settings = DEFAULT) -> DataFrame:
    """bronze_records = silver_records + duplicate_records + rejected_records, whether
    they balance, and records_filtered (bronze less silver).

    Without ``silver`` and ``rejected`` the counts come from one narrow pass over
    the bronze rows (ids and rules). With them, the written tables are counted
    and compared with what the bronze rows ask for."""
    ids = bronze.select("transaction_id", valid_sale(settings).alias("__ok")).groupBy("transaction_id") \
        .agg(F.count(F.lit(1)).alias("__rows"), F.count_if(F.col("__ok")).alias("__valid"))
    g = ids.agg(F.coalesce(F.sum("__rows"), F.lit(0)).cast("long").alias("bronze_records"),
                F.count_if(F.col("__valid") > 0).alias("__ids"),
                F.coalesce(F.sum("__valid"), F.lit(0)).cast("long").alias("__good"))
    count = lambda df, own: own if df is None else df.agg(F.count(F.lit(1))).scalar()
    g = g.select("bronze_records", count(silver, F.col("__ids")).alias("silver_records"),
                 (F.col("__good") - F.col("__ids")).alias("duplicate_records"),
                 count(rejected, F.col("bronze_records") - F.col("__good")).alias("rejected_records"))
    parts = F.col("silver_records") + F.col("duplicate_records") + F.col("rejected_records")
    return g.withColumn("balanced", F.col("bronze_records") == parts) \
        .withColumn("records_filtered", F.col("bronze_records") - F.col("silver_records"))


def orphan_sales(sales_df: DataFrame, master_df: DataFrame, key: str = "customer_id") -> DataFrame:
    """Sales whose key has no row in the master table (anti join)."""
    return sales_df.join(master_df.select(key).distinct(), key, "left_anti")


def quality_metrics(sales_df: DataFrame, customer_df: DataFrame, product_df: DataFrame,
                    settings: Settings = DEFAULT) -> DataFrame:
    """Completeness (% of non-null required fields), uniqueness (% distinct
    transaction ids), validity (% rows passing the value rules) and consistency
    (% rows whose customer and product exist), one row, in percent."""
    rules = sales_rules(settings)
    valid = F.coalesce(rules["valid_amount"] & rules["valid_quantity"], F.lit(False))
    # the rows are reduced to (customer, product) before the masters are joined; ids are counted apart
    pairs = sales_df.groupBy("customer_id", "product_id").agg(
        F.count(F.lit(1)).alias("__n"), sum((F.count(F.col(k)) for k in SALES_KEYS), F.lit(0)).alias("__nn"),
        F.count_if(valid).alias("__v"))
    cust = customer_df.select(F.col("customer_id").alias("__c")).distinct()
    prod = product_df.select(F.col("product_id").alias("__p")).distinct()
    j = pairs.join(cust, pairs["customer_id"] == cust["__c"], "left") \
        .join(prod, pairs["product_id"] == prod["__p"], "left")
    both = F.col("__c").isNotNull() & F.col("__p").isNotNull()
    zero = F.lit(0)
    g = j.agg(F.coalesce(F.sum("__n"), zero).alias("__n"), F.coalesce(F.sum("__nn"), zero).alias("__nn"),
              F.coalesce(F.sum("__v"), zero).alias("__v"),
              F.coalesce(F.sum(F.when(both, F.col("__n"))), zero).alias("__m"))
    g = g.withColumn("__d", sales_df.agg(F.countDistinct("transaction_id")).scalar())
    n = F.col("__n").cast("double")
    return g.select(
        (F.try_divide(F.col("__nn").cast("double"), n * len(SALES_KEYS)) * 100.0).alias("completeness_pct"),
        (F.try_divide(F.col("__d").cast("double"), n) * 100.0).alias("uniqueness_pct"),
        (F.try_divide(F.col("__v").cast("double"), n) * 100.0).alias("validity_pct"),
        (F.try_divide(F.col("__m").cast("double"), n) * 100.0).alias("consistency_pct"))


def discount_violations(sales_df: DataFrame, settings: Settings = DEFAULT, max_discount: float | None = None) -> DataFrame:
    bound = settings.max_discount if max_discount is None else max_discount
    return sales_df.where(F.col("discount_percentage") > F.lit(bound))


def daily_revenue_anomaly(sales_df: DataFrame, lookback_days: int = 28, z_threshold: float = 3.0) -> DataFrame:
    """Per day: revenue, trailing mean and sample stddev over the previous
    ``lookback_days`` days (range frame, current day excluded), z-score and
    the anomaly flag |z| >= threshold.

    One row per calendar day with sales, so the single ordered window is
    bounded by the number of days, not by the sales. Sums run on revenue in
    units of 1/10000 as exact integers, so mean and variance do not depend on
    the summation order.
    """
    from pyspark.sql import Window
    units = (F.sum("total_amount") * F.lit(10000)).cast("decimal(38,0)")
    daily = sales_df.groupBy(F.to_date("transaction_date").alias("sale_date")).agg(units.alias("_u"))
    w = Window.orderBy(F.unix_date("sale_date")).rangeBetween(-lookback_days, -1)
    n = F.count("_u").over(w).cast("decimal(38,0)")
    sx = F.sum("_u").over(w)
    sxx = F.sum(F.col("_u") * F.col("_u")).over(w)
    out = daily.select(
        "sale_date", (F.col("_u").cast("double") / F.lit(10000.0)).alias("daily_revenue"),
        (F.try_divide(sx.cast("double"), n.cast("double")) / F.lit(10000.0)).alias("trailing_mean"),
        F.when(n > 1, F.sqrt(F.try_divide((n * sxx - sx * sx).cast("double"), (n * (n - 1)).cast("double")))
               / F.lit(10000.0)).alias("trailing_stddev"))
    z = F.try_divide(F.col("daily_revenue") - F.col("trailing_mean"), F.col("trailing_stddev"))
    return out.withColumn("z_score", z).withColumn(
        "is_anomaly", F.coalesce(F.abs(F.col("z_score")) >= F.lit(z_threshold), F.lit(False)))
