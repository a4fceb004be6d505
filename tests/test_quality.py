import datetime as dt

from pyspark.sql import functions as F

from tillscope.operators import quality as Q
from tillscope.settings import Settings

CFG = Settings(min_record_count=3, max_null_percentage=0.1, duplicate_threshold=0.01)


def test_validate_dataframe_report(sample_sales):
    df, rep = Q.validate_dataframe(sample_sales, "sales", ["transaction_id", "customer_id"], CFG)
    assert df is sample_sales
    assert set(rep["checks"]) == {"record_count", "required_columns", "null_values", "duplicates", "data_types"}
    assert rep["checks"]["record_count"]["total_records"] == 6
    assert rep["overall_status"] == "PASSED"
    _, rep2 = Q.validate_dataframe(sample_sales, "sales", ["nope"], CFG)
    assert rep2["overall_status"] == "FAILED"


def test_quality_report_rows(sample_sales):
    r = Q.quality_report(sample_sales, "sales", ["transaction_id"], CFG)
    checks = {(x["check"], x["column_name"]): x["passed"] for x in r.collect()}
    assert checks[("overall", None)] is True
    assert checks[("null_values", "discount_percentage")] is True


def test_type_check_accepts_ntz_and_flags_strings(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' AS event_ts, '2024' AS order_date, 1 AS update_count")
    assert [i["column"] for i in Q.type_issues(df)] == ["order_date"]


def test_remove_duplicates(duplicate_rows):
    assert Q.remove_duplicates(duplicate_rows, ["transaction_id"]).count() == 2
    assert Q.remove_duplicates(duplicate_rows).count() == 2


def test_dedup_is_deterministic(spark):
    df = spark.createDataFrame([("A", 3.0, "x"), ("A", 1.0, "y"), ("B", 2.0, "z")], "k string, v double, w string")
    got = {r["k"]: (r["v"], r["w"]) for r in Q.remove_duplicates(df, ["k"], order_by=["v"]).collect()}
    assert got == {"A": (1.0, "y"), "B": (2.0, "z")}


def test_date_range(sample_sales):
    kept = Q.date_range_filter(sample_sales, "transaction_date", "2023-03-01", "2023-03-31")
    assert kept.count() == 3
    rep = Q.date_range_report(sample_sales, "transaction_date", "2023-03-01", "2023-03-31").first()
    assert (rep["valid_records"], rep["invalid_records"], rep["passed"]) == (3, 3, False)


def test_date_range_keeps_whole_last_day_and_reports_nulls(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 15, 30),), (None,)], "d timestamp")
    assert Q.date_range_filter(df, "d", "2024-01-01", "2024-01-31").count() == 1
    assert Q.date_range_report(df, "d", "2024-01-01", "2024-01-31").first()["null_dates"] == 1


def _dirty(spark):
    rows = [("T1", "C1", "P1", 1, 10.0), ("T1", "C1", "P1", 1, 10.0), ("T2", "C1", "P1", 0, 10.0),
            ("T3", "C1", "P1", 1001, 10.0), ("T4", "C1", "P1", 1, 0.0), ("T5", "C1", "P1", 1, -1.0),
            ("T6", "C1", "P1", 1, 100000.0), ("T7", None, "P1", 1, 5.0), ("T8", "C2", "P2", 2, 99999.0)]
    return spark.createDataFrame(rows, "transaction_id string, customer_id string, product_id string, "
                                       "quantity int, total_amount double")


def test_silver_rules(spark):
    got = sorted(r["transaction_id"] for r in Q.silver_sales(_dirty(spark)).collect())
    assert got == ["T1", "T8"]


def test_quarantine_reasons(spark):
    clean, bad = Q.split_quarantine(_dirty(spark))
    reasons = {r["transaction_id"]: r["reject_reasons"] for r in bad.collect()}
    assert reasons["T2"] == ["valid_quantity"] and reasons["T7"] == ["customer_id_not_null"]
    assert reasons["T6"] == ["valid_amount"]
    assert clean.count() == 3


def test_null_handling(spark):
    df = spark.createDataFrame([("a", None), ("b", 1)], "k string, v int")
    assert Q.handle_null_values(df, "drop").count() == 1
    assert sorted(r["v"] for r in Q.handle_null_values(df, "fill", {"v": 0}).collect()) == [0, 1]
    assert Q.handle_null_values(df, "other") is df


def test_null_and_duplicate_profile_empty_table(spark):
    empty = spark.createDataFrame([], "k string, v int")
    assert all(r["null_fraction"] == 0.0 for r in Q.null_profile(empty).collect())
    d = Q.duplicate_profile(empty).first()
    assert (d["total_records"], d["duplicate_fraction"], d["passed"]) == (0, 0.0, True)


def test_anomaly_flags_spike(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(f"T{i}", base + dt.timedelta(days=i), 100.0 + (i % 3)) for i in range(40)]
    rows.append(("TX", base + dt.timedelta(days=40), 1000.0))
    df = spark.createDataFrame(rows, "transaction_id string, transaction_date timestamp, total_amount double")
    flagged = [r["sale_date"] for r in Q.daily_revenue_anomaly(df).where(F.col("is_anomaly")).collect()]
    assert flagged == [(base + dt.timedelta(days=40)).date()]


def test_hashed_report_equals_exact(spark, duplicate_rows):
    df = duplicate_rows.unionByName(spark.createDataFrame([("d3", None, None)], duplicate_rows.schema))
    exact = {(r["check"], r["column_name"]): (r["observed"], r["passed"]) for r in Q.quality_report(df, "d").collect()}
    hashed = {(r["check"], r["column_name"]): (r["observed"], r["passed"])
              for r in Q.quality_report(df, "d", settings=Settings(duplicate_mode="hash")).collect()}
    assert exact == hashed
    assert exact[("duplicates", None)][0] == 0.25 and exact[("null_values", "amount")][0] == 0.25


def test_hashed_duplicate_profile(duplicate_rows):
    a = Q.duplicate_profile(duplicate_rows).first().asDict()
    b = Q.duplicate_profile(duplicate_rows, settings=Settings(duplicate_mode="hash")).first().asDict()
    assert a == b and a["duplicate_count"] == 1


def test_custom_rules(spark):
    rules = {**Q.sales_rules(Settings()), "known_region": F.col("region").isin("North", "South")}
    df = spark.createDataFrame([("T1", "C1", "P1", 1, 5.0, "North"), ("T2", "C1", "P1", 1, 5.0, "Mars")],
                               "transaction_id string, customer_id string, product_id string, quantity int, "
                               "total_amount double, region string")
    clean, bad = Q.split_quarantine(df, rules=rules)
    assert [r["transaction_id"] for r in clean.collect()] == ["T1"]
    assert bad.first()["reject_reasons"] == ["known_region"]


def test_single_pass_reconciliation(spark):
    bronze = _dirty(spark)
    a = Q.silver_reconciliation(bronze).first().asDict()
    silver, (_, bad) = Q.silver_sales(bronze), Q.split_quarantine(bronze)
    b = Q.silver_reconciliation(bronze, silver, bad).first().asDict()
    assert a == b == {"bronze_records": 9, "silver_records": 2, "duplicate_records": 1, "rejected_records": 6,
                      "balanced": True, "records_filtered": 7}
    assert not Q.silver_reconciliation(bronze, silver.limit(1), bad).first()["balanced"]


def test_an_id_with_a_valid_copy_stays(spark):
    rows = [("T1", None, "P1", 1, 10.0), ("T1", "C1", "P1", 1, 10.0), ("T2", "C1", "P1", 1, 0.0),
            ("T2", "C1", "P1", 1, 80.0), ("T3", "C1", "P1", 0, 5.0), (None, "C1", "P1", 1, 5.0)]
    df = spark.createDataFrame(rows, "transaction_id string, customer_id string, product_id string, "
                                     "quantity int, total_amount double")
    got = {r["transaction_id"]: (r["customer_id"], r["total_amount"]) for r in Q.silver_sales(df).collect()}
    assert got == {"T1": ("C1", 10.0), "T2": ("C1", 80.0)}
    r = Q.silver_reconciliation(df).first()
    assert (r["silver_records"], r["duplicate_records"], r["rejected_records"]) == (2, 0, 4)


def test_fingerprint_tells_swapped_nulls_apart(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None), ("x", None)], "a string, b string")
    for mode in ("exact", "hash"):
        d = Q.duplicate_profile(df, settings=Settings(duplicate_mode=mode)).first()
        assert (d["distinct_records"], d["duplicate_count"]) == (2, 1)
        rep = {r["check"]: r["observed"] for r in Q.quality_report(df, "d", settings=Settings(duplicate_mode=mode))
               .collect() if r["column_name"] is None}
        assert abs(rep["duplicates"] - 1 / 3) < 1e-12


def test_null_profile_takes_any_column_name(spark):
    df = spark.createDataFrame([(None, 1), ("b", None)], "`it's` string, `a.b` int")
    assert {r["column_name"]: r["null_count"] for r in Q.null_profile(df).collect()} == {"it's": 1, "a.b": 1}


def test_configured_date_range(spark):
    df = spark.createDataFrame([(dt.datetime(2022, 12, 31),), (dt.datetime(2023, 1, 1),)], "d timestamp")
    assert Q.configured_date_range(df, "d").count() == 1
    assert Q.configured_date_range(df, "d", Settings(date_range_start="2022-01-01")).count() == 2
