"""Incremental layers: equal to a rebuild after every batch, replays and broken runs change nothing more."""

import datetime as dt
import os
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillscope.operators import quality as Q
from tillscope.plans.incremental import MONTH, IncrementalTables
from tillscope.session import fresh_path, local_path

SCHEMA = "transaction_id string, transaction_date timestamp, customer_id string, product_id string, quantity int, " \
         "total_amount decimal(12,2), region string"


def batches(seed=2, n=4):
    """Sales over months, ids that come again in later batches with earlier and later dates, invalid rows."""
    rng = random.Random(seed)
    out = []
    for b in range(n):
        rows = []
        for _ in range(60):
            i = rng.randrange(120)
            rows.append((f"t{i}", dt.datetime(2024, rng.randrange(1, 7), rng.randrange(1, 28)), f"c{i % 9}", f"p{i % 5}",
                         rng.choice([1, 2, 0]), D(rng.choice([10, 20, -5])), rng.choice(["N", "S"])))
        out.append(rows)
    out.append([("moved", dt.datetime(2024, 9, 9), "c1", "p1", 1, D(7), "N")])
    out.append([("moved", dt.datetime(2024, 1, 1), "c1", "p1", 1, D(7), "N"), (None, dt.datetime(2024, 3, 1), "c", "p", 1, D(1), "N")])
    return out


def silver_of(spark, rows):
    return sorted(map(str, Q.silver_sales(spark.createDataFrame(rows, SCHEMA)).collect()))


def now(tables):
    return sorted(map(str, tables.table("silver").drop(MONTH).collect()))


def files(tables, table):
    top = local_path(tables.path(table))
    return {os.path.relpath(os.path.join(d, f), top): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}


def test_every_batch_equals_a_rebuild(spark):
    tables = IncrementalTables(spark, fresh_path(spark, "t-incremental"))
    seen = []
    for n, rows in enumerate(batches()):
        before = files(tables, "silver")
        assert tables.load(spark.createDataFrame(rows, SCHEMA), f"b{n}")
        seen += rows
        assert now(tables) == silver_of(spark, seen)
        gold = {r["customer_id"]: (r["transaction_count"], r["revenue"], r["units"], r["last_purchase_date"])
                for r in tables.totals("customer_months", "customer_id").collect()}
        want = {r["customer_id"]: (r["n"], r["v"], r["u"], r["z"]) for r in Q.silver_sales(spark.createDataFrame(seen, SCHEMA))
                .groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("total_amount").cast("double").alias("v"),
                                            F.sum("quantity").alias("u"), F.max("transaction_date").alias("z")).collect()}
        assert gold == want
        if n == 4:  # one sale of a new month: the other months' files are the same files
            assert before.items() <= files(tables, "silver").items()
    # the month that lost its only sale is gone, in silver and in gold
    for table in ("silver", "customer_months", "region_months"):
        assert tables.table(table).where(F.col(MONTH) == "2024-09").count() == 0


def test_a_replay_changes_no_file(spark):
    tables = IncrementalTables(spark, fresh_path(spark, "t-replay"))
    for n, rows in enumerate(batches()[:2]):
        tables.load(spark.createDataFrame(rows, SCHEMA), f"b{n}")
    before = [files(tables, t) for t in ("silver", "customer_months", "region_months", "bronze")]
    assert not tables.load(spark.createDataFrame(batches()[0], SCHEMA), "b0")
    assert before == [files(tables, t) for t in ("silver", "customer_months", "region_months", "bronze")]


@pytest.mark.parametrize("step", ["_stage", "_put", "_gold"])
def test_a_broken_run_is_finished_by_the_next(spark, monkeypatch, step):
    tables = IncrementalTables(spark, fresh_path(spark, "t-broken"))
    first, second = batches()[:2]
    tables.load(spark.createDataFrame(first, SCHEMA), "b0")
    whole = getattr(IncrementalTables, step)

    def broken(self, *args):
        if step == "_put":  # some months are in place, of one the old files are gone and the new ones not there
            staged, table, touched, held = args
            whole(self, staged, table, touched[:2], held)
            self._remove(self.path("silver", f"{MONTH}={touched[2]}"))
        else:
            whole(self, *args)
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(IncrementalTables, step, broken)
        with pytest.raises(RuntimeError):
            tables.load(spark.createDataFrame(second, SCHEMA), "b1")
    assert tables.load(spark.createDataFrame(second, SCHEMA), "b1")
    assert now(tables) == silver_of(spark, first + second)


def test_batch_ids_and_empty_batches(spark):
    tables = IncrementalTables(spark, fresh_path(spark, "t-empty"))
    with pytest.raises(ValueError):
        tables.load(spark.createDataFrame([], SCHEMA), "a/b")
    tables.load(spark.createDataFrame(batches()[0], SCHEMA), "b0")
    before = now(tables)
    assert tables.load(spark.createDataFrame([], SCHEMA), "none") and now(tables) == before
    assert spark.read.parquet(tables.path("quarantine", "b0")).where("size(reject_reasons) > 0").count() > 0


def test_landed_batches_are_written_once_and_loaded_as_they_are(spark):
    tables = IncrementalTables(spark, fresh_path(spark, "t-landed"))
    rows = [r for b in batches() for r in b]
    reads = spark.sparkContext.accumulator(0)

    def counted(part):
        for r in part:
            reads.add(1)
            yield r
    sales = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).mapPartitions(counted), SCHEMA)
    part = F.pmod(F.coalesce(F.crc32("transaction_id"), F.lit(0)), F.lit(3))
    tables.land(sales, F.concat(F.lit("b"), part))
    assert reads.value == len(rows)
    landed = files(tables, "bronze")
    for n in range(3):
        assert tables.load(sales.where(part == n), f"b{n}")
    assert reads.value == len(rows) and files(tables, "bronze") == landed
    assert spark.read.parquet(tables.path("bronze", "*")).select("batch_id").distinct().count() == 3
    assert now(tables) == silver_of(spark, rows)


def test_months_in_several_parts_equal_a_rebuild(spark, monkeypatch):
    from tillscope.plans import incremental
    monkeypatch.setattr(incremental, "ROWS_A_PART", 6)
    tables = IncrementalTables(spark, fresh_path(spark, "t-parts"))
    rows = [r for b in batches() for r in b]
    tables.load(spark.createDataFrame(rows[:200], SCHEMA), "b0")
    tables.load(spark.createDataFrame(rows[200:], SCHEMA), "b1")
    assert now(tables) == silver_of(spark, rows)
    assert len(files(tables, "silver")) > len(tables._months(tables.path("silver")))
    gold = tables.totals("customer_months", "customer_id").agg(F.sum("transaction_count")).first()[0]
    assert gold == len(silver_of(spark, rows))
