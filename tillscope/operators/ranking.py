"""Global ordering primitives that stay distributed.

A window with an empty PARTITION BY sends every row to one task. That is fine
for tables whose size is fixed by the business (regions, channels, months) but
not for products or customers at scale. The primitives here keep the work in
all tasks:

* ``global_row_number`` sorts with a range exchange (Spark samples the key
  and cuts it into contiguous ranges; a composite key with a unique tie-break
  lets even a hot value be split), stores the sorted partitions reliably, and
  adds each partition's prefix offset (one row per partition, a bounded
  broadcast) to the in-partition position.
* ``discrete_quantiles`` bounds each quantile with a sketch, counts the rows
  below the bound exactly, and collapses, sorts and prefix-sums only the values
  between the bounds (some ten-thousandths of the rows, and a value shared by a
  third of the rows is one row). It picks, for each probability p, the smallest
  value whose cumulative count reaches ceil(p * N): the definition of
  ``percentile_disc`` / ``approxQuantile(..., 0.0)``, exactly. Two rows of
  bounds and counts pass through the driver.

Both write the tagged, sorted intermediate as a table below the shared
``spark.checkpoint.dir`` folder and read it back: the sampled range
partitioning and the row ids are then fixed for everything downstream, and
the lineage is cut, so a lost executor does not trigger a recomputation from
the sources. Ranks are LONG: the whole point is inputs beyond 2^31 rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.session import materialize

_LOW33 = (1 << 33) - 1
#: Accuracy of the sketch that bounds an exact quantile.
_SKETCH = 10_000


def _sorted_checkpoint(df: DataFrame, order_cols: Sequence[Column]) -> DataFrame:
    """Range-partitioned sort, each row tagged with (partition index << 33) + its
    position in the partition, stored as a table in the shared folder.

    The tag alone carries the order, so the stored table can be read back in
    any split/partition layout."""
    tagged = df.orderBy(*order_cols).withColumn("_rk_id", F.monotonically_increasing_id())
    return materialize(tagged, "sorted")


def _partition_offsets(cp: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row per sorted partition: (pid, rows/weight before it). Bounded by the
    partition count, so the broadcast below never grows with the data."""
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = cp.groupBy(F.shiftright("_rk_id", 33).alias("_rk_pid")).agg(w.alias("_rk_n"))
    before = Window.orderBy("_rk_pid").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_rk_pid", "_rk_n", F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_off"))


def global_row_number(df: DataFrame, order_cols: Sequence[Column], name: str = "row_number") -> DataFrame:
    """``row_number() OVER (ORDER BY order_cols)`` without a single-task window.

    Give a unique last sort column for a deterministic numbering.
    """
    cp = _sorted_checkpoint(df, order_cols)
    offsets = F.broadcast(_partition_offsets(cp).select("_rk_pid", "_rk_off"))
    j = cp.join(offsets, F.shiftright(cp["_rk_id"], 33) == offsets["_rk_pid"])
    pos = F.col("_rk_off") + F.col("_rk_id").bitwiseAND(F.lit(_LOW33)) + F.lit(1)
    return j.withColumn(name, pos.cast("long")).drop("_rk_id", "_rk_pid", "_rk_off")


def discrete_quantiles(df: DataFrame, column: str, probabilities: Sequence[float],
                       mode: str = "exact", accuracy: int = 10_000) -> DataFrame:
    """One row, one ``thresholds`` array column: the p-quantiles of ``column``.

    ``mode="exact"``: smallest value v with #(x <= v) >= max(1, ceil(p * N)),
    NULLs ignored, computed distributed (see module doc).
    ``mode="approx"``: ``percentile_approx`` (bounded-memory sketch, one pass).
    """
    q = multi_quantiles(df, [column], probabilities, mode, accuracy)
    return q.select(F.col(column).alias("thresholds"))


def multi_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    mode: str = "exact", accuracy: int = 10_000) -> DataFrame:
    """One row with, per input column, the array of its p-quantiles.

    Exact mode handles all columns together: one pass for the bounds, one for
    the counts, one that groups the values between the bounds.
    """
    probs = [float(p) for p in probabilities]
    cols = list(columns)
    if mode == "approx":
        return df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(c) for c in cols])
    if mode != "exact":
        raise ValueError(f"unknown quantile mode {mode!r}")
    value = {c: F.col(c).cast("double") for c in cols}

    # 1. a sketch bounds each quantile: its rank error is at most 1 / _SKETCH of the rows
    slack = 2.0 / _SKETCH
    around = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    k = len(probs)
    found = df.agg(*[F.percentile_approx(value[c], around, _SKETCH).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    bounds = {(i, j): (found[f"b{i}"][j], found[f"b{i}"][k + j])
              for i in range(len(cols)) if found[f"b{i}"] for j in range(k)}
    # 2. exact counts: rows of the column, and rows below each bound
    counts = df.agg(*[F.count(value[c]).alias(f"n{i}") for i, c in enumerate(cols)],
                    *[F.count_if(value[cols[i]] < F.lit(lo)).alias(f"l{i}_{j}") for (i, j), (lo, _) in bounds.items()]
                    ).first()
    # 3. only values between the bounds are grouped, sorted and prefix-summed
    wanted = [(i * k + j, i, lo, hi, max(1, _ceil(probs[j], counts[f"n{i}"])) - counts[f"l{i}_{j}"])
              for (i, j), (lo, hi) in bounds.items()]
    empty = F.array(*[F.lit(None).cast("double") for _ in probs])
    if not wanted:
        return df.agg(F.count(F.lit(1)).alias("_n")).select(*[empty.alias(c) for c in cols])
    inside = F.array(*[F.when(value[cols[i]].between(lo, hi), F.struct(F.lit(m).alias("m"), value[cols[i]].alias("v")))
                       for m, i, lo, hi, _ in wanted])
    freq = df.select(F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("_q")) \
        .select(F.col("_q.m").alias("_q_m"), F.col("_q.v").alias("_q_v")) \
        .groupBy("_q_m", "_q_v").agg(F.count(F.lit(1)).alias("_q_c"))
    cp = _sorted_checkpoint(freq, [F.col("_q_m"), F.col("_q_v")])
    offsets = F.broadcast(_partition_offsets(cp, F.col("_q_c")).select("_rk_pid", "_rk_off"))
    # the rows of the quantiles before one (a handful of rows)
    per = cp.groupBy("_q_m").agg(F.sum("_q_c").alias("_q_n")).withColumn(
        "_q_start", F.coalesce(F.sum("_q_n").over(
            Window.orderBy("_q_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = cp.join(offsets, F.shiftright(cp["_rk_id"], 33) == offsets["_rk_pid"]).join(F.broadcast(per), "_q_m")
    running = Window.partitionBy("_rk_pid").orderBy("_rk_id").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.col("_rk_off") + F.sum("_q_c").over(running) - F.col("_q_start")
    cum = j.select("_q_m", "_q_v", rank.alias("_q_rank"))
    picks = [F.min(F.when((F.col("_q_m") == m) & (F.col("_q_rank") >= F.lit(target)), F.col("_q_v"))).alias(f"_p{m}")
             for m, _, _, _, target in wanted]
    have = {m for m, *_ in wanted}
    return cum.agg(*picks).select(*[
        (F.array(*[F.col(f"_p{i * k + q}") for q in range(k)]) if i * k in have else empty).alias(c)
        for i, c in enumerate(cols)])


def _ceil(p: float, n: int) -> int:
    return math.ceil(p * n)
