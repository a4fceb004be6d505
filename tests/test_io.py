import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tillscope.operators import customers as C
from tillscope.operators import quality as Q
from tillscope.operators import sales as S
from tillscope.plans import medallion as M
from tillscope.session import fresh_path, local_path
from tillscope.sources import load_customers, load_sales, load_table
from tillscope.sources.loaders import split_corrupt
from tillscope.sources.schemas import SALES_SCHEMA, SCHEMAS
from tillscope.sources.sinks import read_table, write_table


def _write_text(spark, name, text):
    path = local_path(fresh_path(spark, name))
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.csv"), "w") as fh:
        fh.write(text)
    return path


def test_malformed_csv_lines_stay_and_can_be_parted(spark):
    header = ",".join(f.name for f in SALES_SCHEMA.fields)
    good = "T1,2024-01-01T10:00:00Z,C1,P1,2,10.0,0.0,20.0,Card,Online,North,S1"
    bad = "T2,not-a-date,C1,P1,two,10.0,0.0,20.0,Card,Online,North,S1"
    path = _write_text(spark, "malformed", "\n".join([header, good, bad]) + "\n")
    rows = {r["transaction_id"]: r for r in load_sales(spark, path, "csv").collect()}
    assert set(rows) == {"T1", "T2"} and rows["T2"]["quantity"] is None and rows["T2"]["total_amount"] == 20.0
    clean, corrupt = split_corrupt(load_sales(spark, path, "csv", keep_corrupt=True))
    # the malformed quantity is detected even when only the id is selected
    assert [r[0] for r in clean.select("transaction_id").collect()] == ["T1"] and clean.count() == 1
    r = corrupt.first()
    assert corrupt.count() == 1 and r["_corrupt_record"].startswith("T2,") and r["reject_reasons"] == ["corrupt_record"]


def test_csv_columns_go_by_the_header(spark):
    path = _write_text(spark, "swapped", "product_name,product_id,customer_segment\nLamp,P9,x\n")
    r = load_table(spark, path, SCHEMAS["products"], "csv").first()
    assert (r["product_id"], r["product_name"], r["category"]) == ("P9", "Lamp", None)
    c = _write_text(spark, "segment", "customer_segment,customer_id\nTrade,C1\n")
    assert load_customers(spark, c, "csv").first()["market_segment"] == "Trade"


def test_medallion_quarantines_and_balances(spark, sample_sales, sample_customers, sample_products):
    from tillscope.sources.schemas import conform
    header = ",".join(f.name for f in SALES_SCHEMA.fields)
    lines = [header, "T1,2024-01-01T10:00:00Z,C1,P1,2,10.0,0.0,20.0,Card,Online,North,S1",
             "T1,2024-01-01T10:00:00Z,,P1,2,10.0,0.0,20.0,Card,Online,North,S1",
             "T2,2024-01-01T10:00:00Z,C1,P1,many,10.0,0.0,20.0,Card,Online,North,S1",
             "T3,2024-01-01T10:00:00Z,C1,P1,0,10.0,0.0,20.0,Card,Online,North,S1"]
    sales = load_sales(spark, _write_text(spark, "mixed", "\n".join(lines) + "\n"), "csv", keep_corrupt=True)
    lay, _ = M.run(spark, sales, sample_customers, sample_products)
    r = M.reconciliation(spark, lay).first().asDict()
    assert r == {"bronze_records": 3, "silver_records": 1, "duplicate_records": 0, "rejected_records": 2,
                 "balanced": True, "records_filtered": 2}
    assert read_table(spark, lay.quarantine("corrupt_sales")).first()["transaction_id"] == "T2"
    reasons = {x["transaction_id"]: x["reject_reasons"]
               for x in read_table(spark, lay.quarantine("rejected_sales")).collect()}
    assert reasons == {"T1": ["customer_id_not_null"], "T3": ["valid_quantity"]}


def test_unset_shared_folder_on_a_cluster_is_an_error():
    from types import SimpleNamespace

    from tillscope.session import shared_dir
    conf = SimpleNamespace(get=lambda *_: None)
    none = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(
        getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=sc))


def test_unknown_format_raises(spark):
    with pytest.raises(ValueError):
        load_table(spark, "/nowhere", SALES_SCHEMA, "xml")


def test_json_round_trip_renames_master_segment(spark, sample_customers):
    df = sample_customers.withColumn("customer_segment", F.lit("SMB"))
    path = write_table(df, fresh_path(spark, "cust-json"), "json")
    back = load_customers(spark, path, "json")
    assert "market_segment" in back.columns and back.count() == 3


def test_parquet_conform_to_declared_schema(spark, sample_sales):
    path = write_table(sample_sales, fresh_path(spark, "sales-pq"))
    back = load_sales(spark, path)
    assert back.schema.fieldNames() == SALES_SCHEMA.fieldNames()
    assert back.where(F.col("payment_method").isNull()).count() == 6


def test_partitioned_write_and_prune(spark, sample_sales):
    df = sample_sales.withColumns({"year": F.year("transaction_date"), "month": F.month("transaction_date")})
    path = write_table(df, fresh_path(spark, "part"), partition_by=["year", "month"], max_records_per_file=1)
    feb = read_table(spark, path).where((F.col("year") == 2023) & (F.col("month") == 4))
    assert feb.count() == 2


def test_customer_buckets_grow_with_the_sales(spark, monkeypatch, sample_sales, sample_customers, sample_products):
    monkeypatch.setattr(M, "ROWS_A_BUCKET", 1)
    made = []
    write = M.observed_write

    def spy(df, path, *args, **kw):
        made.append(kw.get("bucket_by"))
        return write(df, path, *args, **kw)
    monkeypatch.setattr(M, "observed_write", spy)
    _, counts = M.run(spark, sample_sales, sample_customers, sample_products, customer_buckets=2)
    got = {(r["layer"], r["table_name"]): r["record_count"] for r in counts.collect()}
    assert got[("silver", "sales")] == 6 and got[("gold", "customer_analytics")] == 3
    assert [b for b in made if b] == [(6, ["customer_id"])] * 2  # six sales, one a bucket


def test_medallion_on_fixtures(spark, sample_sales, sample_customers, sample_products):
    lay, counts = M.run(spark, sample_sales, sample_customers, sample_products)
    got = {(r["layer"], r["table_name"]): r["record_count"] for r in counts.collect()}
    assert got[("bronze", "sales")] == 6 and got[("silver", "sales")] == 6
    assert got[("gold", "customer_analytics")] == 3 and got[("gold", "product_performance")] == 4
    assert got[("gold", "regional_performance")] == 3
    m = {r["stage"]: r["record_count"] for r in M.metrics_table(spark, lay).collect()}
    assert m["silver.sales"] == 6 and m["quarantine.rejected_sales"] == 0 and len(m) == 11


def test_operators_on_empty_tables(spark, sample_sales, sample_customers, sample_products):
    empty = sample_sales.limit(0)
    assert C.customer_360_from_sales(empty, sample_customers, "2024-02-15").count() == 3
    assert S.product_performance(empty, sample_products).where(F.col("total_revenue").isNull()).count() == 4
    assert S.daily_sales(empty).count() == 0
    rep = {r["check"]: r["passed"] for r in Q.quality_report(empty, "sales").collect()}
    assert rep["record_count"] is False and rep["duplicates"] is True


def test_validate_dataframe_single_job_dict(sample_sales):
    from tillscope.settings import Settings
    _, rep = Q.validate_dataframe(sample_sales.unionByName(sample_sales.limit(1)), "sales",
                                  settings=Settings(min_record_count=3))
    assert rep["checks"]["duplicates"]["duplicate_count"] == 1
    assert rep["checks"]["duplicates"]["passed"] is False
    assert rep["overall_status"] == "FAILED"


def test_reference_date_is_a_parameter(sample_sales):
    a = C.rfm_metrics(sample_sales, dt.date(2023, 5, 12)).where("customer_id = 'K-ada'").first()
    assert a["recency_days"] == 27


def test_size_for_input(spark):
    from tillscope.session import size_for_input
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        conf = size_for_input(spark, 100 * 10**12)
        assert conf["spark.sql.shuffle.partitions"] == "100000"
        assert size_for_input(spark, 10**6)["spark.sql.shuffle.partitions"] == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))


def test_bucketed_silver_tables_join_without_shuffle(spark, sample_sales, sample_customers):
    import uuid
    tag = uuid.uuid4().hex[:8]
    write_table(sample_sales, fresh_path(spark, "bk-s"), bucket_by=(4, ["customer_id"]), table_name=f"bk_s_{tag}")
    write_table(sample_customers, fresh_path(spark, "bk-c"), bucket_by=(4, ["customer_id"]), table_name=f"bk_c_{tag}")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clv = C.calculate_clv(spark.table(f"bk_s_{tag}"), spark.table(f"bk_c_{tag}"))
        rows = {r["customer_id"]: r["historical_clv"] for r in clv.collect()}
        plan = clv._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert rows["K-ada"] == 280.0
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_source_file_lineage(spark, sample_sales):
    from tillscope.sources.schemas import conform
    path = write_table(conform(sample_sales, SALES_SCHEMA), fresh_path(spark, "lineage"), "csv")
    df = load_sales(spark, path, "csv", with_source_file=True)
    files = {r["source_file"] for r in df.collect()}
    assert files and all(f.endswith(".csv") for f in files)
    pq = write_table(sample_sales, fresh_path(spark, "lineage-pq"))
    assert load_sales(spark, pq, with_source_file=True).where(F.col("source_file").endswith(".parquet")).count() == 6


def test_apply_settings(spark):
    from tillscope.session import apply_settings
    from tillscope.settings import Settings
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        conf = apply_settings(spark, Settings(shuffle_partitions=6))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "6"
        assert conf["spark.sql.autoBroadcastJoinThreshold"] == str(10 * 1024 * 1024)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_medallion_command_line(spark, sample_sales, sample_customers, sample_products):
    from tillscope.sources.schemas import CUSTOMER_SCHEMA, PRODUCT_SCHEMA, conform
    paths = {n: write_table(conform(df, sch), fresh_path(spark, f"cli-{n}"))
             for n, df, sch in (("s", sample_sales, SALES_SCHEMA), ("c", sample_customers, CUSTOMER_SCHEMA),
                                ("p", sample_products, PRODUCT_SCHEMA))}
    rows = M.main(["--sales", paths["s"], "--customers", paths["c"], "--products", paths["p"],
                   "--out", local_path(fresh_path(spark, "cli")) + "/out/dir", "--customer-buckets", "2"])
    got = {(r["layer"], r["table_name"]): r["record_count"] for r in rows}
    assert got[("silver", "sales")] == 6 and got[("gold", "customer_analytics")] == 3


def test_reader_options(spark):
    header = ";".join(f.name for f in SALES_SCHEMA.fields)
    line = "T1;2024-01-01T10:00:00Z;C1;P1;2;10.0;0.0;20.0;Card;Online;North;S1"
    path = _write_text(spark, "semicolon", header + "\n" + line + "\n")
    df = load_sales(spark, path, "csv", options={"sep": ";"})
    assert df.first()["total_amount"] == 20.0
