"""Product recommendations from purchases: implicit-feedback matrix factorisation.

What a customer bought, and how often, is the confidence of a preference;
Spark's alternating least squares finds factors of customers and products in
blocks (each half-step solves one side with the other side's factors sent to the
blocks that need them). A customer's recommendations are the products with the
largest products of factors among those not bought yet.

Products are put in order of the length of their factors and cut into blocks.
Every customer is scored against the first block. The k-th best score found there
bounds the rest: a block whose longest product, in the customer's own direction,
would score less holds no recommendation, and the customer is not sent to it. So
the customers that go on to a block, not all pairs, are what is scored. Cells of
customers and products are of bounded size, scored some rows at a time; only a
customer's best ``k`` leave a task. Neither factor table is gathered anywhere.

``evaluate`` splits in time: factors and popularity come from the sales up to a
day, and the shares of what each customer first bought after it that are among
``k`` recommendations are given for both.

Rows with a null customer or product are left out; a customer without training
sales gets no row; ties go to the smaller product id; fewer than ``k`` products
left give all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.columns import day_range
from tillscope.operators.ranking import global_row_number
from tillscope.session import materialize

CUSTOMERS_AT_ONCE, PRODUCTS_AT_ONCE = 32768, 8192
#: Cells of customers that meet the later blocks together: a block is sent to fewer cells.
CELLS_TOGETHER = 8
#: Scores held at once in a task: they stay in a core's cache.
SCORES_AT_ONCE = 1 << 19
#: Purchases in a block of the factorisation, about: a task holds a block and the factors it asks for.
PURCHASES_AT_ONCE = 2_000_000


def purchases(sales_df: DataFrame) -> DataFrame:
    """customer_id, product_id, times: one row per pair."""
    return sales_df.where("customer_id IS NOT NULL AND product_id IS NOT NULL") \
        .groupBy("customer_id", "product_id").agg(F.count("*").cast("float").alias("times"))


def _numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """Dense integers for the values of a column (the factorisation takes no other ids)."""
    values = global_row_number(df.select(column).distinct(), [F.asc(column)], name)
    return materialize(values.select(column, F.col(name).cast("int").alias(name)), f"recommend-{name}")


def fit_factors(bought: DataFrame, rank: int = 16, iterations: int = 8, regularisation: float = 0.1,
                alpha: float = 10.0, blocks: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(customer_id, user, features) and (product_id, item, features) of ``purchases``.

    The blocks grow with the purchases, so a task's memory does not; factors start from random numbers of their block.
    A checkpoint in each iteration lets the shuffles of the one before go.
    """
    users, items = _numbered(bought, "customer_id", "user"), _numbered(bought, "product_id", "item")
    numbered = materialize(bought.join(users, "customer_id").join(items, "product_id").select("user", "item", "times"),
                           "recommend-purchases")
    n = blocks or max(2, numbered.sparkSession.sparkContext.defaultParallelism, -(-numbered.count() // PURCHASES_AT_ONCE))
    model = ALS(userCol="user", itemCol="item", ratingCol="times", implicitPrefs=True, rank=rank, maxIter=iterations,
                regParam=regularisation, alpha=alpha, numUserBlocks=n, numItemBlocks=n, seed=seed,
                checkpointInterval=1).fit(numbered)
    of = lambda ids, factors, key: materialize(
        factors.withColumnRenamed("id", key).join(ids, key), f"recommend-{key}-factors")
    return of(users, model.userFactors, "user"), of(items, model.itemFactors, "item")


def _best_of_cell(k: int):
    """Of a cell, the k best products of each customer that are not below ``least``, as (user, item, score)."""
    def run(customers: pa.Table, products: pa.Table) -> pa.Table:
        none = pa.table({"user": pa.array([], pa.int32()), "item": pa.array([], pa.int32()), "score": pa.array([], pa.float64())})
        if not customers.num_rows or not products.num_rows:
            return none
        products = products.sort_by("item")
        of = lambda t: np.asarray(pc.list_flatten(t["features"].combine_chunks()), np.float32).reshape(t.num_rows, -1)
        items, right, left = products["item"].to_numpy(), np.ascontiguousarray(of(products).T), of(customers)
        users, least = customers["user"].to_numpy(), customers["least"].to_numpy().astype(np.float32)
        seen = customers["seen"].combine_chunks()
        whose, which = np.asarray(pc.list_parent_indices(seen)), np.asarray(pc.list_flatten(seen))
        at = np.minimum(np.searchsorted(items, which), len(items) - 1)
        here = items[at] == which
        whose, at = whose[here], at[here]
        out, step = [], max(1, SCORES_AT_ONCE // len(items))
        for lo in range(0, len(users), step):
            scores = left[lo:lo + step] @ right
            a, z = np.searchsorted(whose, [lo, lo + step])
            scores[whose[a:z] - lo, at[a:z]] = -np.inf
            bound = least[lo:lo + step].copy()
            open_ = np.flatnonzero(bound == -np.inf)
            if len(open_) and len(items) > k:
                bound[open_] = np.partition(scores[open_], len(items) - k, axis=1)[:, len(items) - k]
            # what was bought scores -inf, below every bound
            row, col = np.divmod(np.flatnonzero(scores >= np.maximum(bound, np.finfo(np.float32).min)[:, None]), len(items))
            score = scores[row, col]
            order = np.lexsort((col, -score, row))  # ties: the smaller item
            row, col, score = row[order], col[order], score[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((users[lo + row[best]], items[col[best]], score[best]))
        found = [np.concatenate(c).astype(t) for c, t in zip(zip(*out), (np.int32, np.int32, np.float64))]
        return pa.table(dict(zip(none.column_names, found)))
    return run


def _in_cells(left: DataFrame, right: DataFrame, n_users: int, k: int) -> DataFrame:
    """user, item, score: each row of ``left`` (user, features, seen, least, i) against the products of its block i."""
    group = lambda x: F.pmod(F.xxhash64(x), F.lit(n_users)).cast("int").alias("u")
    left = left.select("user", "features", "seen", "least", "i", group("user"))
    right = right.select("item", "features", "i", F.explode(F.sequence(F.lit(0), F.lit(n_users - 1))).alias("u"))
    return left.groupBy("u", "i").cogroup(right.groupBy("u", "i")) \
        .applyInArrow(_best_of_cell(k), "user int, item int, score double")


def _kth(found: DataFrame, k: int) -> DataFrame:
    """user, rank, item, score: the k best of the found ones of every user."""
    by_customer = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    return found.withColumn("rank", F.row_number().over(by_customer)).where(F.col("rank") <= k)


def recommend(users: DataFrame, items: DataFrame, bought: DataFrame, k: int = 10) -> DataFrame:
    """customer_id, rank, product_id, score: the k best products that each customer has not bought."""
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    by_size = global_row_number(items.withColumn("size", size(F.col("features"))), [F.desc("size"), F.asc("item")], "place")
    block = F.floor((F.col("place") - 1) / PRODUCTS_AT_ONCE).cast("int")
    placed = materialize(by_size.select("product_id", "item", "features", "size", block.alias("i")), "recommend-placed")
    # one row a block: its longest product, and the smallest item among those of that length
    blocks = placed.groupBy("i").agg(F.max(F.struct("size", (-F.col("item")).alias("item"))).alias("top"))
    blocks = blocks.agg(F.sort_array(F.collect_list(F.struct(
        "i", F.col("top.size").alias("size"), (-F.col("top.item")).alias("item")))).alias("blocks"))
    n_users = max(1, -(-users.count() // CUSTOMERS_AT_ONCE))
    seen = bought.join(placed.select("product_id", "item", "i"), "product_id").groupBy("customer_id") \
        .agg(F.collect_set(F.struct("i", "item")).alias("seen"))
    asked = users.select("customer_id", "user", "features").join(seen, "customer_id", "left") \
        .select("user", "features", size(F.col("features")).alias("size"), "seen")
    asked = materialize(asked, "recommend-asked")
    # a cell is told what a customer bought of its block only
    of_block = lambda i: F.transform(F.filter("seen", lambda x: x["i"] == i), lambda x: x["item"]).alias("seen")
    first = _in_cells(asked.select("user", "features", of_block(F.lit(0)), F.lit(float("-inf")).alias("least"),
                                   F.lit(0).alias("i")), placed.where("i = 0"), n_users, k)
    first = materialize(_kth(first, k), "recommend-first")
    kth = first.where(F.col("rank") == k).select("user", F.col("score").alias("least"), F.col("item").alias("last"))
    # rounding: sums of several products may come out a little above the bound, a single one does not
    bound = lambda b: F.when(F.size("features") > 1, F.col("size") * b["size"] * (1 + 1e-5)) \
        .otherwise((F.col("size") * b["size"]).cast("float").cast("double"))
    ahead = F.filter("blocks", lambda b: (b["i"] > 0) & (F.col("least").isNull() | (bound(b) > F.col("least"))
                                                        | ((bound(b) == F.col("least")) & (b["item"] < F.col("last")))))
    more = asked.join(kth, "user", "left").withColumn("blocks", blocks.scalar()) \
        .select("user", "features", "seen", "least", F.explode(F.transform(ahead, lambda b: b["i"])).alias("i")) \
        .select("user", "features", of_block(F.col("i")), F.coalesce("least", F.lit(float("-inf"))).alias("floor"), "i") \
        .withColumnRenamed("floor", "least")
    rest = _in_cells(more, placed.where("i > 0"), -(-n_users // CELLS_TOGETHER), k)
    best = _kth(first.drop("rank").unionByName(rest), k)
    return best.join(users.select("user", "customer_id"), "user").join(items.select("item", "product_id"), "item") \
        .select("customer_id", "rank", "product_id", "score")


def product_recommendations(sales_df: DataFrame, k: int = 10, **fit) -> DataFrame:
    """The k recommendations of every customer with sales."""
    bought = materialize(purchases(sales_df), "recommend-bought")
    return recommend(*fit_factors(bought, **fit), bought, k)


def popular_factors(bought: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Factors of rank one that order products by their number of customers, for everybody: the baseline."""
    users, items = _numbered(bought, "customer_id", "user"), _numbered(bought, "product_id", "item")
    sold = bought.groupBy("product_id").agg(F.array(F.count("*").cast("float")).alias("features"))
    return (users.withColumn("features", F.array(F.lit(1.0).cast("float"))),
            materialize(items.join(sold, "product_id"), "recommend-popular"))


def popular_recommendations(sales_df: DataFrame, k: int = 10) -> DataFrame:
    """The k most widely bought products that each customer has not bought; score: their numbers of customers."""
    bought = materialize(purchases(sales_df), "recommend-bought")
    return recommend(*popular_factors(bought), bought, k)


def evaluate(sales_df: DataFrame, until, k: int = 10, **fit) -> DataFrame:
    """One row: customers, recall (of recommendations) and popular_recall on what was first bought after ``until``."""
    bought = materialize(purchases(sales_df.where(day_range(sales_df, "transaction_date", None, until))), "recommend-train")
    after = sales_df.where(F.to_date("transaction_date") > F.to_date(F.lit(str(until))))
    new = purchases(after).join(bought, ["customer_id", "product_id"], "left_anti") \
        .join(bought.select("customer_id").distinct(), "customer_id", "left_semi").select("customer_id", "product_id")
    new = materialize(new, "recommend-new")
    flag = lambda factors, name: recommend(*factors, bought, k).select(
        "customer_id", "product_id", F.lit(1).alias(name))
    both = ["customer_id", "product_id"]
    per = new.join(flag(fit_factors(bought, **fit), "hit"), both, "left") \
        .join(flag(popular_factors(bought), "popular"), both, "left").groupBy("customer_id") \
        .agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r"), F.avg(F.coalesce("popular", F.lit(0))).alias("p"))
    return per.agg(F.count("*").alias("customers"), F.avg("r").alias("recall"), F.avg("p").alias("popular_recall"))
