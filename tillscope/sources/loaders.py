"""Loading the retail entities from CSV, JSON or Parquet with one policy.

* CSV and JSON are read with the declared types (no type inference) in
  PERMISSIVE mode. No record is dropped: one that does not parse stays as a
  row whose unreadable fields are NULL, so the quality rules see it. With
  ``keep_corrupt`` its raw text is in ``_corrupt_record``, and
  ``split_corrupt`` parts such records from the rest for the quarantine.
* Columns go by name in every format: a CSV's header says which column is
  which (files of one load must share it), and ``rename`` maps source names to
  schema names. Missing columns are NULL, further ones are left out.
* Parquet and ORC carry their own types and are cast to the declared ones.
* An unknown format raises instead of silently meaning Parquet.

No loader counts its rows: counting is an action and belongs to the caller.
(Reading a CSV header lists the files and reads one line.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillscope.sources.schemas import SCHEMAS, conform

FORMATS = ("csv", "json", "parquet", "orc")
CORRUPT = "_corrupt_record"


def _typed(names: list[str], schema: StructType, rename: dict) -> StructType:
    """A read schema for source columns: the declared type of a known name, a string otherwise."""
    kinds = {f.name: f.dataType for f in schema.fields}
    fields = [StructField(n, kinds.get(rename.get(n, n), StringType()), True) for n in names]
    return StructType(fields + [StructField(CORRUPT, StringType(), True)])


def load_table(spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet",
               keep_corrupt: bool = False, rename: dict | None = None, with_source_file: bool = False,
               options: dict | None = None) -> DataFrame:
    """Read ``path`` as ``schema``. ``keep_corrupt`` adds ``_corrupt_record`` (CSV, JSON);
    ``with_source_file`` adds a ``source_file`` column (the file each row came
    from, for bronze lineage); ``options`` are passed to the reader (e.g.
    ``{"sep": ";"}``, ``{"multiLine": "true"}``)."""
    fmt, rename, options = file_format.lower(), rename or {}, options or {}
    if fmt not in FORMATS:
        raise ValueError(f"unsupported file format {file_format!r}; expected one of {FORMATS}")
    extra = []
    if fmt in ("csv", "json"):
        reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        if fmt == "csv":
            names = spark.read.option("header", "true").options(**options).csv(path).columns
            # every file's header is compared with the first one's
            reader = reader.option("header", "true").option("enforceSchema", "false")
        else:
            names = [f.name for f in schema.fields]
            names += [n for n in rename if n not in names]
        df = reader.schema(_typed(names, schema, rename)).options(**options).format(fmt).load(path)
        if keep_corrupt:
            extra.append(F.col(CORRUPT))
    else:
        df = spark.read.options(**options).format(fmt).load(path)
    if with_source_file:
        extra.append(F.col("_metadata.file_path").alias("source_file"))
    return conform(df, schema, rename, extra)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records that parsed, records that did not) of a load with ``keep_corrupt``.

    The parsed side reads every field, so that a malformed value is noticed
    whatever columns are selected later; the other side carries the raw text
    and a ``reject_reasons`` column, as rule rejects do."""
    if CORRUPT not in df.columns:
        return df, df.where(F.lit(False)).withColumn("reject_reasons", F.array(F.lit("corrupt_record")))
    every = F.length(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in df.columns if c != CORRUPT]))
    good = df.where(F.col(CORRUPT).isNull() & (every >= 0)).drop(CORRUPT)
    bad = df.where(F.col(CORRUPT).isNotNull() & (every >= 0)) \
        .withColumn("reject_reasons", F.array(F.lit("corrupt_record")))
    return good, bad


def load_sales(spark, path, file_format="parquet", **kw) -> DataFrame:
    return load_table(spark, path, SCHEMAS["sales"], file_format, **kw)


def load_customers(spark, path, file_format="parquet", **kw) -> DataFrame:
    kw.setdefault("rename", {"customer_segment": "market_segment"})
    return load_table(spark, path, SCHEMAS["customers"], file_format, **kw)


def load_products(spark, path, file_format="parquet", **kw) -> DataFrame:
    return load_table(spark, path, SCHEMAS["products"], file_format, **kw)


def load_inventory(spark, path, file_format="parquet", **kw) -> DataFrame:
    return load_table(spark, path, SCHEMAS["inventory"], file_format, **kw)
