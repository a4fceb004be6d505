"""Cross-sell rules: pairs of products bought together, by frequent-item projection.

The first level of parallel FP-growth, which is all that rules from one product
to another need. Products below the minimum support go first; a basket is the
set of its frequent products, in the order of descending frequency, and equal
baskets count as one with a weight. Products are dealt to groups; a basket is
sent once to each group that it has a product of, as the prefix that ends with
its last product of that group. A group's task reads its baskets as a stream and
adds each weight to the conditional counts of the group's products: no pair of a
basket is a row anywhere, and a basket of any size is taken whole.

A task holds the counts of one group: products of the group times frequent
products. Their number is bounded by the support (a share s of the baskets leaves
mean basket size / s products at most), and the number of groups grows with them
so that ``COUNTERS`` are not passed. Baskets of a hot group are dealt to several
tasks (``salts``) and the counts added up.

A null basket or product counts for nothing; a product bought twice in a basket
counts once; an empty table gives no rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.columns import safe_div
from tillscope.operators.ranking import global_row_number
from tillscope.session import materialize

#: Counters that a task holds at most, about (8 bytes each).
COUNTERS = 4_000_000


def _conditional_counts(frequent: int, groups: int):
    """Streams (group, prefix, weight) and adds up the weights of (product, product before it)."""
    schema = pa.schema([("later", pa.int32()), ("earlier", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        now = None

        def counted() -> Iterator[pa.RecordBatch]:
            for later, row in rows.items():
                earlier = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(earlier), later, np.int32)), pa.array(earlier.astype(np.int32)),
                     pa.array(row[earlier])], schema=schema)
            rows.clear()

        for b in batches:
            lists = b.column(1)
            offsets = lists.offsets.to_numpy().tolist()
            ranks, weights = lists.values.to_numpy(), b.column(2).to_numpy()
            for k, g in enumerate(b.column(0).to_pylist()):
                if g != now:  # sorted by group: its counts are complete here
                    yield from counted()
                    now = g
                prefix = ranks[offsets[k]:offsets[k + 1]]
                for at in np.flatnonzero(prefix % groups == g).tolist():
                    row = rows.get(int(prefix[at]))
                    if row is None:
                        row = rows[int(prefix[at])] = np.zeros(frequent, np.int64)
                    row[prefix[:at]] += weights[k]  # a basket has a product once
        yield from counted()
    return run


def frequent_pairs(baskets: DataFrame, frequent: int, min_count: int, salts: int = 8) -> DataFrame:
    """earlier, later, n: pairs of ranks that at least ``min_count`` baskets (``ranks``, ``weight``) have."""
    groups = max(1, -(-frequent * frequent // COUNTERS))
    g = F.col("g")
    # a prefix for each group of the basket: up to its last product of the group
    owned = F.array_distinct(F.transform("ranks", lambda r: r % groups))
    last = F.array_max(F.filter(F.sequence(F.lit(1), F.size("ranks")), lambda i: F.col("ranks")[i - 1] % groups == g))
    sent = baskets.select("ranks", "weight", F.explode(owned).alias("g")) \
        .select("g", F.slice("ranks", F.lit(1), last).alias("prefix"), "weight")
    tasks = int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("prefix"), F.lit(max(1, min(salts, tasks // groups))))
    counts = sent.repartition(tasks, "g", salt).sortWithinPartitions("g") \
        .mapInArrow(_conditional_counts(frequent, groups), "later int, earlier int, n long")
    return counts.groupBy("earlier", "later").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def cross_sell_rules(sales_df: DataFrame, basket: str = "basket_id", min_support: float = 0.001,
                     min_confidence: float = 0.0, min_lift: float = 0.0) -> DataFrame:
    """antecedent, consequent, pair_count, support, confidence, lift of products bought together.

    Support is the share of all baskets that have both, confidence the share of
    the antecedent's baskets that have the consequent too, lift that relative to
    the consequent's own share. Exact at ``min_support``; both directions are given.
    """
    lines = sales_df.where(F.col(basket).isNotNull() & F.col("product_id").isNotNull()) \
        .select(F.col(basket).alias("_basket"), "product_id").distinct()
    lines = materialize(lines, "cross-sell-lines")
    total = lines.agg(F.count_distinct("_basket")).first()[0]
    min_count = max(1, math.ceil(round(min_support * total, 6)))
    items = lines.groupBy("product_id").agg(F.count("*").alias("item_count")).where(F.col("item_count") >= min_count)
    ranked = materialize(global_row_number(items, [F.desc("item_count"), F.asc("product_id")], "rank")
                         .select("product_id", "item_count", (F.col("rank") - 1).cast("int").alias("rank")),
                         "cross-sell-items")
    frequent = ranked.count()
    baskets = lines.join(ranked.select("product_id", "rank"), "product_id").groupBy("_basket") \
        .agg(F.sort_array(F.collect_set("rank")).alias("ranks")).where(F.size("ranks") > 1) \
        .groupBy("ranks").agg(F.count("*").alias("weight"))
    pairs = frequent_pairs(materialize(baskets, "cross-sell-baskets"), frequent, min_count)
    side = lambda name: ranked.select(
        F.col("rank").alias(name), F.col("product_id").alias(f"{name}_product"), F.col("item_count").alias(f"{name}_count"))
    both = pairs.join(side("earlier"), "earlier").join(side("later"), "later")
    n = F.lit(float(total or 1))

    def rule(a: str, b: str) -> F.Column:
        return F.struct(
            F.col(f"{a}_product").alias("antecedent"), F.col(f"{b}_product").alias("consequent"),
            F.col("n").alias("pair_count"), (F.col("n") / n).alias("support"),
            safe_div("n", f"{a}_count").alias("confidence"),
            safe_div(F.col("n") * n, F.col(f"{a}_count") * F.col(f"{b}_count").cast("double")).alias("lift"))
    rules = both.select(F.inline(F.array(rule("earlier", "later"), rule("later", "earlier"))))
    return rules.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
