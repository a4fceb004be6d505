"""Structured Streaming tier: the batch rules and aggregates on an unbounded source.

* ``sales_stream``      file source (any format) with a declared schema;
  event time cast to TIMESTAMP (watermarks need it) and bounded state;
* ``stream_silver``     the cleaning rules plus ``dropDuplicatesWithinWatermark``
  (dedup state is dropped once the watermark passes);
* ``stream_revenue``    tumbling or sliding event-time windows per channel;
* ``stream_sessions``   session windows per customer;
* ``stream_enriched``   stream-static join with the customer master;
* ``stream_followed_by`` pairs of two streams within an interval (view, then purchase);
* ``run_available``     runs a streaming DataFrame to a Parquet sink with its
  checkpoint below the shared folder (exactly-once file commit; a restarted
  or failed run resumes from the checkpoint), ``availableNow`` trigger.

* ``run_bounded``       runs an aggregation over a feed that ends and returns
  all of its windows, also those still open when the feed ends.

An endless feed uses append mode: a window is emitted once, when the watermark
passes its end, so the state holds only the windows that can still change. The
windows after the last watermark are then not in the sink yet; for a feed that
ends, use ``run_bounded``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillscope.session import fresh_path


def sales_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet",
                 glob: str | None = None, max_files_per_trigger: int | None = None,
                 column_map: dict[str, Column] | None = None) -> DataFrame:
    """A streaming source of sales-shaped rows. ``column_map`` maps output names to
    expressions over the source columns (e.g. to rename or cast)."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    df = r.load(path)
    if column_map:
        df = df.select(*[c.alias(n) for n, c in column_map.items()])
    return df


def event_sales_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The driver ``events`` table as a stream of sales (time of day included)."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return sales_stream(spark, sf_dir, schema, glob="events.parquet", max_files_per_trigger=max_files_per_trigger,
                        column_map={
                            "transaction_id": F.col("event_id").cast("string"),
                            "transaction_date": F.col("ts").cast("timestamp"),
                            "customer_id": F.col("user_id"),
                            "total_amount": F.col("value").cast("decimal(12,2)"),
                            "sales_channel": F.col("event_type"),
                        })


def stream_silver(stream: DataFrame, watermark: str = "1 day", max_amount: float = 100_000.0) -> DataFrame:
    """Streaming cleaning: non-null keys, 0 < amount < max, one row per transaction id
    within the watermark (late copies beyond it are dropped with the state)."""
    keys = F.col("transaction_id").isNotNull() & F.col("customer_id").isNotNull() & F.col("total_amount").isNotNull()
    valid = (F.col("total_amount") > 0) & (F.col("total_amount") < F.lit(max_amount))
    return stream.where(keys & valid).withWatermark("transaction_date", watermark) \
        .dropDuplicatesWithinWatermark(["transaction_id"])


def stream_revenue(stream: DataFrame, window: str = "1 day", slide: str | None = None,
                   watermark: str = "1 day", by: str = "sales_channel") -> DataFrame:
    """Revenue and transactions per event-time window (tumbling, or sliding when
    ``slide`` is given) and ``by`` column."""
    w = F.window("transaction_date", window, slide) if slide else F.window("transaction_date", window)
    g = stream.withWatermark("transaction_date", watermark).groupBy(w.alias("w"), F.col(by)).agg(
        F.sum("total_amount").alias("_rev"), F.count(F.lit(1)).alias("transaction_count"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by,
                    F.col("_rev").cast("double").alias("revenue"), "transaction_count")


def stream_sessions(stream: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions per customer: activity separated by less than ``gap``."""
    g = stream.withWatermark("transaction_date", watermark).groupBy(
        F.session_window("transaction_date", gap).alias("s"), "customer_id").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.sum("total_amount").alias("_rev"))
    return g.select("customer_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "transaction_count", F.col("_rev").cast("double").alias("revenue"))


def stream_enriched(stream: DataFrame, customers: DataFrame, columns=("region", "market_segment")) -> DataFrame:
    """Stream-static left join: each sale gets the customer's master attributes.
    The static side is joined per micro-batch (broadcast when AQE measures it small)."""
    return stream.join(customers.select("customer_id", *columns), "customer_id", "left")


def run_available(df: DataFrame, name: str = "stream", path: str | None = None,
                  checkpoint: str | None = None, output_mode: str = "append") -> DataFrame:
    """Process everything available now into a Parquet sink, then return the sink as a batch DataFrame."""
    spark = df.sparkSession
    path = path or fresh_path(spark, f"{name}-out")
    checkpoint = checkpoint or fresh_path(spark, f"{name}-ckpt")
    q = (df.writeStream.format("parquet").outputMode(output_mode).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(df.schema).parquet(path)


def _last_complete(spark: SparkSession, path: str) -> str | None:
    """The folder of the highest batch below ``path`` whose write was finished."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(top) if f.isDirectory()]
    numbers = sorted((int(n[len("batch="):]) for n in names if n.startswith("batch=")), reverse=True)
    return next((f"{path}/batch={n}" for n in numbers if fs.exists(hadoop.Path(f"{path}/batch={n}/_SUCCESS"))), None)


def run_bounded(df: DataFrame, name: str = "stream", path: str | None = None,
                checkpoint: str | None = None) -> DataFrame:
    """All windows of an aggregation over a feed that ends, as a batch DataFrame.

    Complete mode: every micro-batch writes the whole result table as of its
    end to a folder of its own (written anew if the batch is retried), and the
    last complete one is returned. The state is the result, one row per window
    and key. A feed without any row gives an empty result.

    Called again with the same ``path`` and ``checkpoint`` it goes on where it
    was: the windows of rows that came meanwhile are added, and without such rows
    the result of the last run is returned."""
    if (path is None) != (checkpoint is None):
        raise ValueError("path and checkpoint belong together: a restart needs both")
    spark = df.sparkSession
    path = path or fresh_path(spark, f"{name}-out")
    checkpoint = checkpoint or fresh_path(spark, f"{name}-ckpt")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = (df.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    last = _last_complete(spark, path)
    if last is None:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(last)


def stream_followed_by(first: DataFrame, second: DataFrame, within: str = "1 hour", watermark: str = "1 hour",
                       key: str = "customer_id") -> DataFrame:
    """Pairs of a row of ``first`` and a later row of ``second`` of the same key, at most ``within`` apart.

    Both sides are streams with ``transaction_id``, ``transaction_date`` and the
    key. Each has a watermark, and with the interval they bound the state: a row is
    kept until no partner can come any more, and rows later than the watermark are
    dropped. Pairs are given out when their later row comes (inner join), so
    nothing is left open when a feed ends.

    Result: key, first_id, first_at, second_id, second_at, seconds_between.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias(f"{name}_key"), F.col("transaction_id").alias(f"{name}_id"),
                         F.col("transaction_date").alias(f"{name}_at")).where(f"{name}_key IS NOT NULL") \
            .withWatermark(f"{name}_at", watermark)
    pairs = side(first, "first").join(side(second, "second"), F.expr(
        f"first_key = second_key AND second_at > first_at AND second_at <= first_at + INTERVAL {within}"))
    return pairs.select(F.col("first_key").alias(key), "first_id", "first_at", "second_id", "second_at",
                        (F.unix_seconds("second_at") - F.unix_seconds("first_at")).alias("seconds_between"))
