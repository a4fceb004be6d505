"""Writing and reading layer tables, append-only ingest, quarantine and metrics.

Paths are plain strings; on a cluster they must name shared storage (see
``tillscope.session.fresh_path``, which derives them from the session's
``spark.checkpoint.dir``). File commits go through Spark's committer, so a
lost executor retries its task without duplicating output.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType, DoubleType


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, max_records_per_file: int | None = None,
                options: dict | None = None, bucket_by: tuple[int, list[str]] | None = None,
                table_name: str | None = None) -> str:
    """Write ``df`` to ``path``. With ``bucket_by=(n, cols)`` the files are
    hash-bucketed and sorted on ``cols`` and registered as catalog table
    ``table_name`` (data stays at ``path``): later aggregations and joins on
    those columns between tables with the same bucket count need no shuffle."""
    w = df.write.format(fmt).mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    if fmt == "csv":
        w = w.option("header", "true")
    for k, v in (options or {}).items():
        w = w.option(k, v)
    if bucket_by:
        n, cols = bucket_by
        w.bucketBy(int(n), *cols).sortBy(*cols).option("path", path).saveAsTable(table_name)
        return path
    w.save(path)
    return path


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None) -> DataFrame:
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", "true")
    return r.load(path)


def with_ingest_metadata(df: DataFrame, source_system: str, batch_id: str | None = None) -> DataFrame:
    """Adds ingest_ts, source_system and batch_id columns (bronze lineage)."""
    out = df.withColumns({"ingest_ts": F.current_timestamp(), "source_system": F.lit(source_system)})
    if batch_id is not None:
        out = out.withColumn("batch_id", F.lit(batch_id))
    return out


def append_bronze(df: DataFrame, path: str, source_system: str, batch_id: str, fmt: str = "parquet",
                  partition_by: list[str] | None = None) -> str:
    """Append-only bronze: every load adds rows with its ingest metadata, nothing is overwritten."""
    return write_table(with_ingest_metadata(df, source_system, batch_id), path, fmt, "append", partition_by)


def write_quarantine(rejected: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Append rejected rows (with their ``reject_reasons``) and the time they were quarantined."""
    return write_table(rejected.withColumn("quarantined_at", F.current_timestamp()), path, fmt, "append")


METRICS_SCHEMA = StructType([
    StructField("metric_ts", TimestampType(), False),
    StructField("pipeline", StringType(), False),
    StructField("stage", StringType(), False),
    StructField("duration_sec", DoubleType(), True),
    StructField("record_count", LongType(), True),
])


def observed_write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                   partition_by: list[str] | None = None, **kw) -> tuple[int, float]:
    """Write ``df`` and count its rows in the same job (``observe``), return (rows, seconds)."""
    obs = Observation(f"rows_{uuid.uuid4().hex}")
    t0 = time.time()
    write_table(df.observe(obs, F.count(F.lit(1)).alias("rows")), path, fmt, mode, partition_by, **kw)
    return int(obs.get["rows"]), time.time() - t0


def append_metrics(spark: SparkSession, path: str, rows: list[tuple]) -> str:
    """Append (pipeline, stage, duration_sec, record_count) rows to the metrics table."""
    import datetime as dt
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    data = [(now, p, s, float(d), int(n)) for p, s, d, n in rows]
    return write_table(spark.createDataFrame(data, METRICS_SCHEMA), path, "parquet", "append")
