"""Sharding by sampled splitters (built-in functions only).

A size-weighted sample of the range key gives quantile splitters; records are
range-partitioned by them, and a range that turns out overfull (one key with
very many records, or an unlucky sample) is subdivided by further splitters on
(key, doc_id) drawn inside it. Every piece is then small enough for one task,
pieces are summed exactly, and a record's shard follows from the exact number
of bytes before it in (key, doc_id) order. So the sample decides only how the
work is spread, never the result: shards differ by less than one record's size.

The key is a hash of the text, so equal texts lie together.

Results for odd input: a null text has no bytes (size 1); rows with a null
``doc_id`` are placed like others, before the other rows of their text; equal
rows get different slots; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillscope.llm.common import id_text, utf8_size
from tillscope.session import materialize

LAW = "bytes"
#: Records of a range on average, and sampled keys for each range.
RANGE_ROWS = 1_000_000
SAMPLES_PER_RANGE = 64
#: A range is overfull beyond this multiple of the mean bytes or rows.
OVERFULL = 1.5
#: Ranges for each shard at least.
LEAST_RANGES = 4


def _literal(values: list, kind: str) -> Column:
    """A constant array of any length (one string in the plan, folded once)."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast(f"array<{kind}>")


def _below(splitters: list[int], key: Column) -> Column:
    """How many of the sorted splitters are <= key: a two-level search."""
    step = max(1, round(len(splitters) ** 0.5))
    rows = [splitters[i:i + step] for i in range(0, len(splitters), step)]
    heads = _literal([r[0] for r in rows], "bigint")
    table = F.transform(F.split(F.lit(";".join(",".join(map(str, r)) for r in rows)), ";"),
                        lambda r: F.split(r, ",").cast("array<bigint>"))
    if not splitters:
        return F.lit(0)
    row = F.size(F.filter(heads, lambda s: s <= key)) - 1
    inside = F.size(F.filter(F.element_at(table, F.greatest(row, F.lit(0)) + 1), lambda s: s <= key))
    return F.when(row < 0, F.lit(0)).otherwise(row * step + inside)


def _copies(weight: Column, per: float, seed: int) -> Column:
    """Copies of a record in a sample that expects ``weight * per`` of them; fixed for a record."""
    u = F.pmod(F.xxhash64(F.col("key"), F.col("doc_id"), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(weight * F.lit(per) + u).cast("long")


def base_records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the 53-bit range key of each document."""
    t = id_text(docs)
    return t.select("doc_id", (utf8_size(F.col("text")) + 1).alias("size"),
                    F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32"),
                    F.shiftrightunsigned(F.xxhash64("text"), 11).alias("key"))


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards of nearly equal bytes, gapless slots.

    Writes two narrow tables (a record's id, size, checksum and key) to the
    shared folder, so texts are read once and the window's result is shared.
    """
    base = materialize(base_records(docs), "shard-base")
    total = base.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()
    rows, size = total["n"] or 0, total["b"] or 1
    n_ranges = max(LEAST_RANGES * n_shards, -(-rows // range_rows))

    # size-weighted sample -> quantile splitters (one row, n_ranges - 1 numbers)
    sampled = base.withColumn("copies", _copies(F.col("size"), SAMPLES_PER_RANGE * n_ranges / size, 1)) \
        .where("copies > 0")
    cuts = sampled.agg(F.percentile("key", [i / n_ranges for i in range(1, n_ranges)], F.col("copies"))
                       .alias("cuts")).first()["cuts"]
    splitters = sorted({int(c) for c in cuts or []})
    ranged = base.withColumn("range", _below(splitters, F.col("key")).cast("int"))

    # exact totals of each range; overfull ones get splitters of their own
    full = OVERFULL * size / n_ranges, OVERFULL * max(1, rows) / n_ranges
    totals = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    over = totals.where((F.col("b") > full[0]) | (F.col("n") > full[1])) \
        .select("range", F.ceil(F.greatest(F.col("b") * (n_ranges / size), F.col("n") * (n_ranges / max(1, rows))))
                .cast("int").alias("parts"), F.col("n").alias("range_n"), F.col("b").alias("range_b"))
    inner = ranged.join(F.broadcast(over), "range")  # at most n_ranges rows
    share = F.col("size") / F.col("range_b") + F.lit(1.0) / F.col("range_n")
    picked = inner.withColumn("copies", _copies(share * F.col("parts"), SAMPLES_PER_RANGE / 2, 2)) \
        .where("copies > 0")
    order = F.struct("key", "doc_id")
    tile = F.floor((F.sum("copies").over(W.partitionBy("range").orderBy("key", "doc_id")) - F.col("copies"))
                   / (SAMPLES_PER_RANGE))
    fine = picked.select("range", order.alias("cut"), tile.alias("tile")).groupBy("range", "tile") \
        .agg(F.min("cut").alias("cut")).where("tile > 0") \
        .groupBy("range").agg(F.sort_array(F.collect_list("cut")).alias("fine"))
    placed = ranged.join(F.broadcast(fine), "range", "left").withColumn(
        "sub", F.when(F.col("fine").isNull(), F.lit(0))
        .otherwise(F.size(F.filter("fine", lambda s: s <= order)))).drop("fine")

    # exact sums: bytes and rows before a piece, then before each record in it
    pieces = placed.groupBy("range", "sub").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    before = W.orderBy("range", "sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.select("range", "sub", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = W.partitionBy("range", "sub").orderBy("key", "doc_id", "size", "text_crc32")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    numbered = placed.withColumn("b1", F.sum("size").over(upto)).withColumn("n1", F.row_number().over(inside)) \
        .join(F.broadcast(offsets), ["range", "sub"]) \
        .select("doc_id", "size", "text_crc32", (F.col("b0") + F.col("b1")).alias("end"),
                (F.col("n0") + F.col("n1") - 1).alias("place"))
    middle = F.col("end") * 2 - F.col("size")
    shard = F.least(F.floor(middle * n_shards / (2 * size)), F.lit(n_shards - 1)).cast("int")
    numbered = materialize(numbered.withColumn("shard", shard), "shard-placed")
    first = numbered.groupBy("shard").agg(F.min("place").alias("first"))
    return numbered.join(F.broadcast(first), "shard") \
        .select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> None:
    """Write the documents as one folder per shard, joined to their places by doc_id (ids must be unique)."""
    places = shard_by_bytes(docs, n_shards).select(F.col("doc_id").alias("_id"), "shard", "slot")
    docs.join(places, docs["doc_id"].eqNullSafe(places["_id"])).drop("_id") \
        .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_bytes(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
