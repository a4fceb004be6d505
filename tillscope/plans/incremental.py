"""Incremental bronze, silver and gold: a batch changes only the months that it touches.

Bronze keeps every batch in a folder of its own. Silver is partitioned by sale
month. A batch touches the months of its valid sales and, where it brings an
earlier copy of an id that silver has, the month of that copy. Only those months
are read, rebuilt and replaced; the others stay
as files. The row that silver keeps of an id is the least of all its copies, and
the least of (the kept one, the batch's copies) is the same row, so the result
equals a rebuild from all of bronze.

A month's rows are dealt to parts by their ids, as many as its rows ask for. The
copies of an id lie in one month mostly: those are reduced within their part, and
the parts are the files, so a row is moved once. Ids with copies in several months
are found on ids and months alone, and only their rows are put together by id.

Gold holds what can be added up by month: measures by customer and month, and by
region and month. A batch rebuilds the touched months of both; totals are sums
over the months.

Every step can be repeated. The new contents of the touched months are written
beside the table first, with the list of the months; then their folders are moved
into place. When a run dies meanwhile, the next one moves the rest and does not
compute them from a table in the making. A batch that is done has a mark, and to load it again does nothing.
One batch is loaded at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.operators import quality as Q
from tillscope.session import materialize
from tillscope.settings import DEFAULT, Settings
from tillscope.sources.sinks import with_ingest_metadata, write_quarantine

MONTH = "sale_month"
#: Rows of a month that one task takes.
ROWS_A_PART = 1_000_000


def _by_month(df: DataFrame) -> DataFrame:
    """A month's rows together, a few files a month; a large month is split into several."""
    return df.hint("rebalance", MONTH)


def _deal(df: DataFrame, key: str, sizes: dict[str, int]) -> DataFrame:
    """The rows of each month dealt by ``key`` to one or more parts (``_part``), a task each."""
    parts = {m: 1 + n // ROWS_A_PART for m, n in sizes.items()} or {"none": 1}
    of_month = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    part = F.pmod(F.xxhash64(key), F.coalesce(F.element_at(of_month, F.col(MONTH)), F.lit(1)))
    return df.withColumn("_part", part).repartition(sum(parts.values()), MONTH, "_part")


@dataclass(frozen=True)
class IncrementalTables:
    """The tables below one folder of the shared storage."""
    spark: SparkSession
    base: str
    settings: Settings = DEFAULT

    def path(self, *parts: str) -> str:
        return "/".join([self.base.rstrip("/"), *parts])

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _written(self, path: str) -> bool:
        return self._exists(f"{path}/_SUCCESS")

    def _remove(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def done(self, batch_id: str) -> bool:
        return self._written(self.path("_batches", batch_id))

    # ------------------------------------------------------------ loading

    def land(self, sales: DataFrame, batch_of: F.Column, source_system: str = "sales") -> None:
        """Write the bronze of several batches in one pass over their source; ``load`` takes them on from there.

        ``batch_of`` is the batch id of a row. Batches that have their bronze keep it.
        """
        landing = self.path("_landing")
        with_ingest_metadata(sales, source_system).withColumn("batch_id", batch_of).withColumn("_batch", batch_of) \
            .write.mode("overwrite").partitionBy("_batch").parquet(landing)
        fs, top = self._fs(landing)
        for at in [f.getPath() for f in fs.listStatus(top) if f.getPath().getName().startswith("_batch=")]:
            bronze = self.path("bronze", at.getName().split("=", 1)[1])
            if self._written(bronze):
                continue
            self._remove(bronze)
            fs.mkdirs(self._fs(self.path("bronze"))[1])
            if not fs.rename(at, self._fs(bronze)[1]):
                raise OSError(f"{at} could not be moved to {bronze}")
            fs.create(self._fs(f"{bronze}/_SUCCESS")[1]).close()
        self._remove(landing)

    def load(self, batch: DataFrame, batch_id: str, source_system: str = "sales") -> bool:
        """Take one batch of sales through the layers; False when it was loaded before."""
        if not batch_id or any(c in batch_id for c in "/\\ ="):
            raise ValueError(f"a batch id names a folder: {batch_id!r}")
        if self.done(batch_id):
            return False
        bronze = self.path("bronze", batch_id)
        if not self._written(bronze):
            with_ingest_metadata(batch, source_system, batch_id).write.mode("overwrite").parquet(bronze)
        columns = batch.columns
        rows = self.spark.read.schema(batch.schema).parquet(bronze).select(*columns)
        staged, plan = self.path("_staged", batch_id), self.path("_plan", batch_id)
        if not self._written(plan):
            touched = self._stage(rows, staged)
            held = set(self._months(staged))
            self.spark.createDataFrame([(m, m in held) for m in touched], f"{MONTH} string, held boolean") \
                .coalesce(1).write.mode("overwrite").parquet(plan)
        months = self.spark.read.parquet(plan).collect()
        touched, held = [r[0] for r in months], [r[0] for r in months if r[1]]
        self._put(staged, "silver", touched, held)
        self._gold(touched)
        _, rejects = Q.split_quarantine(rows, self.settings)
        rejected = self.path("quarantine", batch_id)
        if not self._written(rejected):
            self._remove(rejected)
            write_quarantine(rejects, rejected)
        self.spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(len(touched)).alias("months")) \
            .write.mode("overwrite").parquet(self.path("_batches", batch_id))
        self._remove(staged)
        return True

    def _month(self) -> F.Column:
        return F.date_format("transaction_date", "yyyy-MM")

    def _stage(self, rows: DataFrame, staged: str) -> list[str]:
        """Write the new contents of the touched months, and tell which those are."""
        month = F.coalesce(self._month(), F.lit("none"))
        both = rows.where(Q.valid_sale(self.settings))
        columns = both.columns
        # months as numbers: their least and greatest by id are found without sorting
        number = F.coalesce(F.year("transaction_date") * 12 + F.month("transaction_date"), F.lit(-1)).alias("m")
        places = both.select("transaction_id", number)
        sizes = {r[0]: r[1] for r in both.groupBy(month).count().collect()}
        silver = self.table("silver") if self._months(self.path("silver")) else None
        if silver is not None:
            places = places.unionByName(silver.select("transaction_id", number))
        moved = materialize(places.groupBy("transaction_id").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
                            .where("lo <> hi").select("transaction_id"), "incremental-moved")
        some = not moved.isEmpty()
        touched = set(sizes)
        if silver is not None:
            if some:
                touched |= {r[0] for r in silver.join(moved, "transaction_id", "left_semi").select(MONTH).distinct().collect()}
            held = silver.where(F.col(MONTH).isin(sorted(touched)))  # only these partitions are read
            for r in held.groupBy(MONTH).count().collect():
                sizes[r[0]] = sizes.get(r[0], 0) + r[1]
            both = held.select(*columns).unionByName(both)
        stays = both.join(moved, "transaction_id", "left_anti") if some else both
        dealt = _deal(stays.withColumn(MONTH, month), "transaction_id", sizes)
        new = Q.remove_duplicates(dealt, [MONTH, "_part", "transaction_id"]).select(*columns)
        if some:
            goes = both.join(moved, "transaction_id", "left_semi").select(*columns)
            new = new.unionByName(Q.remove_duplicates(goes, ["transaction_id"]))
        Q.flag_sales(new, self.settings).withColumn(MONTH, month).write.mode("overwrite").partitionBy(MONTH).parquet(staged)
        return sorted(touched)

    def _months(self, path: str) -> list[str]:
        """The months that have a folder below ``path``."""
        fs, at = self._fs(path)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{MONTH}="))

    def _put(self, staged: str, table: str, touched: list[str], held: list[str]) -> None:
        """The staged months in place of the table's; touched months that hold nothing any more go.

        A staged month that is not there was put in place by an earlier, broken run.
        """
        fs, top = self._fs(self.path(table))
        fs.mkdirs(top)
        there = set(self._months(staged))
        for month in touched:
            source, target = (self._fs(f"{p}/{MONTH}={month}")[1] for p in (staged, self.path(table)))
            if month in there or month not in held:
                fs.delete(target, True)
            if month in there and not fs.rename(source, target):
                raise OSError(f"{source} could not be moved to {target}")

    def _gold(self, touched: list[str]) -> None:
        if not touched:
            return
        silver = self.table("silver").where(F.col(MONTH).isin(touched))
        measures = [F.count("*").alias("transaction_count"), F.sum("total_amount").alias("revenue"),
                    F.sum(F.col("quantity").cast("long")).alias("units"),
                    F.min("transaction_date").alias("first_purchase_date"),
                    F.max("transaction_date").alias("last_purchase_date")]
        sizes = {r[0]: r[1] for r in silver.groupBy(MONTH).count().collect()}
        sold = silver.select(MONTH, "customer_id", "total_amount", "quantity", "transaction_date")
        customers = _deal(sold, "customer_id", sizes).groupBy(MONTH, "_part", "customer_id").agg(*measures).drop("_part")
        # a month's regions are few: they are reduced where they lie
        regions = _by_month(silver.groupBy(MONTH, "region").agg(*measures))
        for name, rows in (("customer_months", customers), ("region_months", regions)):
            staged = self.path("_staged_gold", name)
            rows.write.mode("overwrite").partitionBy(MONTH).parquet(staged)
            self._put(staged, name, touched, self._months(staged))

    # ------------------------------------------------------------ reading

    def table(self, name: str) -> DataFrame:
        """silver, customer_months or region_months."""
        return self.spark.read.option("inferSchema", "false").parquet(self.path(name)) \
            .withColumn(MONTH, F.col(MONTH).cast("string"))

    def totals(self, name: str, key: str) -> DataFrame:
        """The measures of all months by ``key``."""
        return self.table(name).groupBy(key).agg(
            F.sum("transaction_count").alias("transaction_count"), F.sum("revenue").cast("double").alias("revenue"),
            F.sum("units").alias("units"), F.min("first_purchase_date").alias("first_purchase_date"),
            F.max("last_purchase_date").alias("last_purchase_date"))
