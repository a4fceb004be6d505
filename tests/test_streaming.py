"""Streaming semantics on small files: watermark, late data, dedup, sessions."""

import datetime as dt

from pyspark.sql import functions as F

from tillscope.session import fresh_path
from tillscope.streaming import jobs as ST

SCHEMA = "transaction_id string, transaction_date timestamp, customer_id long, total_amount decimal(12,2), " \
         "sales_channel string"


def _batch_files(spark, batches):
    path = fresh_path(spark, "stream-in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def _stream(spark, path):
    return ST.sales_stream(spark, path, SCHEMA, max_files_per_trigger=1)


def t(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_tumbling_windows_drop_late_rows(spark):
    from decimal import Decimal as D
    b1 = [("a", t(1, 1), 1, D("10.00"), "web"), ("b", t(3, 1), 1, D("5.00"), "web")]
    b2 = [("d", t(6, 1), 2, D("1.00"), "web")]
    # arrives after the 1 Jan window was emitted (watermark 2 Jan 01:00 at the end of batch 0): dropped
    b3 = [("c", t(1, 2), 2, D("99.00"), "web")]
    out = ST.run_available(ST.stream_revenue(_stream(spark, _batch_files(spark, [b1, b2, b3])), "1 day", None,
                                             "1 day"), "t-late")
    got = {r["window_start"].day: (r["revenue"], r["transaction_count"]) for r in out.collect()}
    # windows closed by the final watermark (5 Jan 01:00) are emitted once; 6 Jan stays open in state
    assert got == {1: (10.0, 1), 3: (5.0, 1)}


def test_dedup_within_watermark(spark):
    from decimal import Decimal as D
    b1 = [("a", t(1), 1, D("10.00"), "web"), ("a", t(1), 1, D("10.00"), "web")]
    b2 = [("a", t(1, 1), 1, D("10.00"), "web"), ("b", t(2), 1, D("-1.00"), "web"), ("c", t(2), 1, D("3.00"), "web")]
    out = ST.run_available(ST.stream_silver(_stream(spark, _batch_files(spark, [b1, b2])), "1 day"), "t-dedup")
    assert sorted(r["transaction_id"] for r in out.collect()) == ["a", "c"]


def test_sessions_close_after_gap(spark):
    from decimal import Decimal as D
    base = dt.datetime(2024, 1, 1, 10)
    rows = [("a", base, 1, D("1.00"), "web"), ("b", base + dt.timedelta(minutes=20), 1, D("2.00"), "web"),
            ("c", base + dt.timedelta(minutes=90), 1, D("4.00"), "web"),
            ("z", base + dt.timedelta(hours=5), 2, D("1.00"), "web")]
    out = ST.run_available(ST.stream_sessions(_stream(spark, _batch_files(spark, [rows])), "30 minutes", "1 hour"),
                           "t-sess")
    got = sorted((r["customer_id"], r["transaction_count"], r["revenue"]) for r in out.collect())
    assert got == [(1, 1, 4.0), (1, 2, 3.0)]


def test_stream_static_enrichment(spark, sample_customers):
    from decimal import Decimal as D
    cust = sample_customers.select(F.lit(1).cast("long").alias("customer_id"), "region",
                                   F.lit("Retail").alias("market_segment")).limit(1)
    out = ST.run_available(ST.stream_enriched(_stream(spark, _batch_files(spark, [[("a", t(1), 1, D("1.00"), "web"),
                                                                                 ("b", t(1), 9, D("1.00"), "web")]])),
                                              cust), "t-enrich")
    got = {r["transaction_id"]: r["market_segment"] for r in out.collect()}
    assert got == {"a": "Retail", "b": None}


def test_bounded_run_returns_open_windows_too(spark):
    from decimal import Decimal as D
    b1 = [("a", t(1, 1), 1, D("10.00"), "web"), ("b", t(3, 1), 1, D("5.00"), "web")]
    b2 = [("c", t(1, 2), 2, D("99.00"), "web"), ("d", t(6, 1), 2, D("1.00"), "web")]
    feed = _batch_files(spark, [b1, b2])
    out = ST.run_bounded(ST.stream_revenue(_stream(spark, feed), "1 day", None, "1 day"), "t-bounded")
    assert {r["window_start"].day: (r["revenue"], r["transaction_count"]) for r in out.collect()} == {
        1: (109.0, 2), 3: (5.0, 1), 6: (1.0, 1)}
    s = ST.run_bounded(ST.stream_sessions(_stream(spark, feed), "2 hours", "1 hour"), "t-bounded-s").collect()
    assert sorted((r["customer_id"], r["revenue"]) for r in s) == [(1, 5.0), (1, 10.0), (2, 1.0), (2, 99.0)]


def test_bounded_run_keeps_its_windows_over_restarts(spark):
    from decimal import Decimal as D
    feed = _batch_files(spark, [[("a", t(1, 1), 1, D("10.00"), "web"), ("b", t(3, 1), 1, D("5.00"), "web")]])
    path, checkpoint = fresh_path(spark, "t-restart"), fresh_path(spark, "t-restart-ckpt")
    run = lambda: {r["window_start"].day: r["revenue"] for r in ST.run_bounded(
        ST.stream_revenue(_stream(spark, feed), "1 day", None, "1 day"), "t-restart", path, checkpoint).collect()}
    assert run() == {1: 10.0, 3: 5.0}
    assert run() == {1: 10.0, 3: 5.0}  # nothing new
    spark.createDataFrame([("c", t(3, 2), 2, D("2.50"), "web"), ("d", t(9), 2, D("1.00"), "web")], SCHEMA) \
        .coalesce(1).write.mode("append").parquet(feed)
    assert run() == {1: 10.0, 3: 7.5, 9: 1.0}
    # a write that did not end is passed over
    spark.range(1).write.parquet(f"{path}/batch=99")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=99/_SUCCESS"), False)
    assert run() == {1: 10.0, 3: 7.5, 9: 1.0}


def test_a_restart_needs_path_and_checkpoint(spark):
    import pytest
    with pytest.raises(ValueError):
        ST.run_bounded(_stream(spark, _batch_files(spark, [[]])), "t", path="/nowhere")


def test_pairs_of_two_streams_late_rows_and_restarts(spark):
    from decimal import Decimal as D

    def at(day, hour, minute=0):
        return dt.datetime(2024, 1, day, hour, minute)
    row = lambda i, when, c=1: (i, when, c, D("1.00"), "web")
    views = _batch_files(spark, [[row("v1", at(1, 10)), row("v2", at(1, 10, 50)), row("v3", at(1, 10), 2), row("v0", at(1, 9), None)]])
    buys = _batch_files(spark, [[row("p1", at(1, 11)), row("p2", at(1, 12, 30)), row("p3", at(1, 10), 2)]])
    path, checkpoint = fresh_path(spark, "t-pairs"), fresh_path(spark, "t-pairs-ckpt")

    def run():
        out = ST.run_available(ST.stream_followed_by(_stream(spark, views), _stream(spark, buys), "1 hour", "2 hours"),
                               "t-pairs", path, checkpoint)
        return sorted((r["first_id"], r["second_id"], r["seconds_between"]) for r in out.collect())
    first = [("v1", "p1", 3600), ("v2", "p1", 600)]  # p3 is not later than v3
    assert run() == first and run() == first
    # one batch moves both watermarks to the third day
    for feed, rows in ((views, [row("v4", at(3, 10), 3)]), (buys, [row("p4", at(3, 10, 30), 3)])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    assert run() == sorted([*first, ("v4", "p4", 1800)])
    # late rows meet nothing, a row in time meets what the state kept over the restart
    for feed, rows in ((views, [row("late", at(1, 10, 30))]), (buys, [row("p5", at(1, 11, 10)), row("p6", at(3, 11), 3)])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    assert run() == sorted([*first, ("v4", "p4", 1800), ("v4", "p6", 3600)])
