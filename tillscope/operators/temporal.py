"""Joins in time: the value in force at a moment, and moments that lie within intervals.

``asof_join`` gives each row the last known value of its key: both sides are put
in one line by key and time, and the last value before a row is carried to it. A
key is cut into buckets of time, so a key with a third of all rows is spread
over many tasks; what enters a bucket from earlier ones is carried over by a
window on one small row a key and bucket.

``interval_join`` finds the intervals that hold each moment without comparing
every row with every interval: intervals are filed in bins as wide as they are
long at least (a power of two), so each lies in two bins at most; a moment looks
in one bin of each width that occurs, and the equal bins are compared in full.
``interval_totals`` joins days and moments already added up where only totals are asked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.session import materialize

BUCKET = "30 days"


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def asof_join(rows: DataFrame, history: DataFrame, key: str | Sequence[str], time: str, valid_from: str,
              values: Sequence[str], bucket: str = BUCKET, strict: bool = False) -> DataFrame:
    """``rows`` with the ``values`` of the last row of ``history`` of the same key with valid_from <= time.

    ``strict`` asks for valid_from < time. Rows without an earlier history row, and
    rows with a null key or time, get nulls and are kept. Of several history rows
    of one key and moment the one with the greatest values holds. History rows
    with a null key or moment count for nothing.
    """
    keys = [key] if isinstance(key, str) else list(key)
    width = F.expr(f"interval {bucket}")
    span = F.unix_micros(F.timestamp_seconds(F.lit(0)) + width)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    value = F.struct(*values)
    past = history.where(known & F.col(valid_from).isNotNull()).groupBy(*keys, _micros(F.col(valid_from)).alias("_t")) \
        .agg(F.max(value).alias("_v"))
    past = materialize(past.withColumn("_b", F.floor(F.col("_t") / span)), "asof-history")
    in_order = Window.partitionBy(*keys).orderBy("_b")
    # what is in force when a bucket begins: the last value of the last earlier bucket of the key with history
    last = past.groupBy(*keys, "_b").agg(F.max_by("_v", "_t").alias("_v"))
    asked = rows.where(known & F.col(time).isNotNull()) \
        .withColumn("_t", _micros(F.col(time))).withColumn("_b", F.floor(F.col("_t") / span))
    wanted = asked.select(*keys, "_b").distinct()
    entering = last.join(wanted, [*keys, "_b"], "full_outer") \
        .withColumn("_before", F.last("_v", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))) \
        .select(*keys, "_b", "_before")
    row = F.struct(*[F.col(c) for c in rows.columns])
    # at one moment history comes before the rows, or after them where it must be earlier
    kind = past.schema["_v"].dataType
    line = past.select(*keys, "_b", "_t", F.lit(1 if strict else 0).alias("_side"), "_v",
                       F.lit(None).cast(rows.select(row).schema[0].dataType).alias("_row")) \
        .unionByName(asked.select(*keys, "_b", "_t", F.lit(0 if strict else 1).alias("_side"),
                                  F.lit(None).cast(kind).alias("_v"), row.alias("_row")))
    at = Window.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("_last", F.last("_v", ignorenulls=True).over(at)).where("_row IS NOT NULL")
    out = found.join(entering, [*keys, "_b"], "left").withColumn("_held", F.coalesce("_last", "_before")) \
        .select("_row.*", *[F.col(f"_held.{v}").alias(v) for v in values])
    rest = rows.where(~known | F.col(time).isNull()).select(
        "*", *[F.lit(None).cast(kind[v].dataType).alias(v) for v in values])
    return out.unionByName(rest)


def interval_join(rows: DataFrame, intervals: DataFrame, time: str, start: str, end: str,
                  on: Sequence[str] = ()) -> DataFrame:
    """Every pair of a row and an interval with start <= time < end (and equal ``on``), by an equi-join on bins.

    Empty, reversed and null intervals hold nothing; rows with a null time meet
    nothing. The widths that occur (at most one for each power of two) are read
    from the intervals first. Bins that many rows share are split by adaptive
    execution: the join needs no order within a bin.
    """
    t, a, z = _micros(F.col(time)), _micros(F.col(start)), _micros(F.col(end))
    filed = intervals.where(z > a).withColumn("_level", F.ceil(F.log2((z - a).cast("double"))).cast("int"))
    filed = filed.withColumn("_level", F.greatest("_level", F.lit(20)))  # a second and less: one width
    levels = sorted(r[0] for r in filed.select("_level").distinct().collect())
    # a shift to the right is the floor of a division by a power of two
    bin_of = lambda x: F.call_function("shiftright", x, F.col("_level"))
    binned = filed.withColumn("_bin", F.explode(F.sequence(bin_of(a), bin_of(z - 1))))
    looks = F.array(*[F.struct(F.lit(n).alias("_level"), F.shiftright(t, n).alias("_bin")) for n in levels]) \
        if levels else F.array().cast("array<struct<_level:int,_bin:bigint>>")
    asked = rows.where(F.col(time).isNotNull()).select("*", F.inline(looks))
    return asked.join(binned, ["_level", "_bin", *on]).where((t >= a) & (t < z)).drop("_level", "_bin")


def interval_totals(rows: DataFrame, intervals: DataFrame, time: str, start: str, end: str, by: Sequence,
                    amount: str) -> DataFrame:
    """Per ``by`` of the intervals: transaction_count and the exact sum of ``amount`` of the rows they hold.

    The whole days within an interval are met by the totals of days; only what an
    interval has before its first and after its last midnight is met by the totals
    of moments. No row is paired with an interval.
    """
    def totals(at: Column) -> DataFrame:
        return rows.groupBy(at.alias("_at")).agg(F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_sum"))

    def pieces(*spans) -> DataFrame:
        cut = F.array(*[F.struct(a.alias("_a"), z.alias("_z")) for a, z in spans])
        return intervals.where(F.col(end) > F.col(start)).select("*", F.inline(cut)).where("_a < _z")
    a, z = F.col(start).cast("timestamp"), F.col(end).cast("timestamp")
    midnight, last = F.date_trunc("day", a), F.date_trunc("day", z)
    first = F.when(midnight == a, a).otherwise(F.date_add(midnight.cast("date"), 1).cast("timestamp"))
    met = interval_join(totals(F.date_trunc("day", time)), pieces((first, last)), "_at", "_a", "_z")
    edges = pieces((a, F.least(first, z)), (F.greatest(last, first), z))
    if not edges.isEmpty():
        met = met.unionByName(interval_join(totals(F.col(time).cast("timestamp")), edges, "_at", "_a", "_z"))
    return met.groupBy(*by).agg(F.sum("_n").alias("transaction_count"), F.sum("_sum").alias(amount))
