"""Recommendations: planted tastes are found, what was bought is left out, blocks agree with whole matrices."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np

from tillscope.operators import recommend as R


def tastes(spark, seed=3, customers=240, groups=6, per_group=15, days=60):
    """Customers buy from the products of their group mostly; some products sell everywhere."""
    rng = random.Random(seed)
    rows = []
    for c in range(customers):
        g = c % groups
        for d in range(days):
            if rng.random() < 0.35:
                p = f"hit{rng.randrange(4)}" if rng.random() < 0.25 else f"g{g}-{rng.randrange(per_group)}"
                rows.append((f"c{c}", p, dt.datetime(2024, 1, 1) + dt.timedelta(days=d)))
    return spark.createDataFrame(rows, "customer_id string, product_id string, transaction_date timestamp")


def test_recall_is_above_popularity(spark):
    r = R.evaluate(tastes(spark), "2024-02-05", k=8, rank=8).first()
    assert r["customers"] > 200
    assert r["recall"] > 0.5 and r["recall"] > 2 * r["popular_recall"] > 0


def test_bought_products_are_left_out_and_ranks_are_gapless(spark):
    sales = tastes(spark, customers=40)
    seen = defaultdict(set)
    for r in sales.collect():
        seen[r["customer_id"]].add(r["product_id"])
    got = defaultdict(list)
    for r in R.product_recommendations(sales, k=5, rank=4, iterations=3).collect():
        got[r["customer_id"]].append((r["rank"], r["score"], r["product_id"]))
    assert set(got) == set(seen)
    for c, rows in got.items():
        rows.sort()
        assert [r for r, *_ in rows] == list(range(1, len(rows) + 1)) and len(rows) == 5
        assert not {p for *_, p in rows} & seen[c]
        assert [s for _, s, _ in rows] == sorted((s for _, s, _ in rows), reverse=True)


def test_blocks_give_what_whole_matrices_give(spark, monkeypatch):
    bought = R.purchases(tastes(spark, customers=30)).cache()
    users, items = R.fit_factors(bought, rank=4, iterations=2)
    u = {r["customer_id"]: np.array(r["features"], np.float32) for r in users.collect()}
    v = {r["product_id"]: np.array(r["features"], np.float32) for r in items.collect()}
    seen = defaultdict(set)
    for r in bought.collect():
        seen[r["customer_id"]].add(r["product_id"])
    monkeypatch.setattr(R, "CUSTOMERS_AT_ONCE", 7)
    monkeypatch.setattr(R, "PRODUCTS_AT_ONCE", 13)
    got = defaultdict(set)
    for r in R.recommend(users, items, bought, 3).collect():
        got[r["customer_id"]].add(round(r["score"], 4))
    for c, f in u.items():
        want = sorted((round(float(f @ g), 4) for p, g in v.items() if p not in seen[c]), reverse=True)[:3]
        assert np.allclose(sorted(got[c]), sorted(set(want)), atol=2e-4)


def test_few_products_and_null_rows(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("a", None)]
    sales = spark.createDataFrame(rows, "customer_id string, product_id string")
    got = {(r["customer_id"], r["product_id"]) for r in R.product_recommendations(sales, k=5, rank=2, iterations=2).collect()}
    assert got == {("b", "y")}


def test_customers_go_only_to_blocks_that_can_hold_a_recommendation(spark, monkeypatch):
    monkeypatch.setattr(R, "CUSTOMERS_AT_ONCE", 16)
    monkeypatch.setattr(R, "PRODUCTS_AT_ONCE", 8)
    monkeypatch.setattr(R, "SCORES_AT_ONCE", 24)
    sent, cells = [], R._in_cells

    def spy(left, *args):
        sent.append(left.count())
        return cells(left, *args)
    monkeypatch.setattr(R, "_in_cells", spy)
    rng = random.Random(8)
    # 200 products in 25 blocks: the first is bought most, all others equally often; ties go to the smaller product
    rows = [(f"c{c:02}", f"p{p:03}") for c in range(40) for p in rng.sample(range(1, 200), 3)]
    rows += [(f"c{c:02}", f"p{p:03}") for c in range(36) for p in (0, 1, 2, 3)]
    sales = spark.createDataFrame(rows, "customer_id string, product_id string")
    n, seen = defaultdict(set), defaultdict(set)
    for c, p in rows:
        n[p].add(c)
        seen[c].add(p)
    want = {(c, i + 1, p, float(len(n[p]))) for c in seen for i, p in enumerate(
        sorted((p for p in n if p not in seen[c]), key=lambda p: (-len(n[p]), p))[:2])}
    assert set(map(tuple, R.popular_recommendations(sales, 2).collect())) == want
    assert sent[0] == 40 and sent[1] <= 40  # of 40 x 24


def test_blocks_of_the_factorisation_grow_with_the_purchases(spark, monkeypatch):
    asked, als = [], R.ALS

    def spy(**options):
        asked.append(options)
        return als(**options)
    monkeypatch.setattr(R, "ALS", spy)
    bought = R.purchases(tastes(spark, customers=30)).cache()
    least = max(2, spark.sparkContext.defaultParallelism)
    R.fit_factors(bought, rank=2, iterations=1)
    monkeypatch.setattr(R, "PURCHASES_AT_ONCE", -(-bought.count() // (least + 3)))
    users, items = R.fit_factors(bought, rank=2, iterations=1)
    assert [o["numUserBlocks"] for o in asked] == [o["numItemBlocks"] for o in asked] == [least, least + 3]
    assert all(o["checkpointInterval"] == 1 for o in asked)  # else the shuffles of every iteration stay
    assert users.count() == 30 and items.count() == bought.select("product_id").distinct().count()


def test_a_cell_takes_no_product_that_was_bought(spark):
    import pyarrow as pa
    customers = pa.table({"user": pa.array([1, 2], pa.int32()), "features": pa.array([[1.0], [1.0]], pa.list_(pa.float32())),
                          "seen": pa.array([[0, 1, 2], []], pa.list_(pa.int32())), "least": [float("-inf"), 2.0]})
    products = pa.table({"item": pa.array([0, 1, 2, 3], pa.int32()),
                         "features": pa.array([[3.0], [2.0], [2.0], [1.0]], pa.list_(pa.float32()))})
    got = R._best_of_cell(4)(customers, products).to_pylist()
    assert [(r["user"], r["item"], r["score"]) for r in got] == [(1, 3, 1.0), (2, 0, 3.0), (2, 1, 2.0), (2, 2, 2.0)]


def test_later_blocks_are_sent_to_fewer_cells_of_customers(spark, monkeypatch):
    monkeypatch.setattr(R, "CUSTOMERS_AT_ONCE", 8)
    monkeypatch.setattr(R, "PRODUCTS_AT_ONCE", 13)
    cells, real = [], R._in_cells

    def spy(left, right, n_users, k):
        cells.append(n_users)
        return real(left, right, n_users, k)
    monkeypatch.setattr(R, "_in_cells", spy)
    R.product_recommendations(tastes(spark, customers=72), k=3, rank=2, iterations=1)
    assert cells == [9, 2]
