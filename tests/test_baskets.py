"""Cross-sell rules against brute force, large and hot baskets, groups and salts."""

import random
from collections import Counter
from itertools import combinations

import pytest

from tillscope.operators import baskets as B


def brute(rows, min_support):
    baskets = {}
    for b, p in rows:
        if b is not None and p is not None:
            baskets.setdefault(b, set()).add(p)
    n, items, pairs = len(baskets), Counter(), Counter()
    for s in baskets.values():
        items.update(s)
        pairs.update(combinations(sorted(s), 2))
    out = {}
    for (a, b), c in pairs.items():
        if c >= max(1, -(-round(min_support * n, 6) // 1)):
            for x, y in ((a, b), (b, a)):
                out[x, y] = (c, pytest.approx(c / n), pytest.approx(c / items[x]), pytest.approx(c * n / items[x] / items[y]))
    return out


def got(df):
    return {(r["antecedent"], r["consequent"]): (r["pair_count"], r["support"], r["confidence"], r["lift"])
            for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "basket_id string, product_id string").repartition(3)


def market(seed=1, baskets=400):
    rng = random.Random(seed)
    rows = [(f"b{k}", f"p{int(rng.paretovariate(0.6)) % 60}") for k in range(baskets) for _ in range(rng.randint(1, 8))]
    return rows + rows[:50] + [(None, "p1"), ("b1", None), (None, None)]


@pytest.mark.parametrize("counters", [B.COUNTERS, 90])
def test_rules_match_brute_force(spark, monkeypatch, counters):
    """With few counters every product group is small and a basket goes to many."""
    monkeypatch.setattr(B, "COUNTERS", counters)
    rows = market()
    assert got(B.cross_sell_rules(frame(spark, rows), min_support=0.01)) == brute(rows, 0.01)


def test_bounds_on_confidence_and_lift(spark):
    rows = market(2)
    rules = got(B.cross_sell_rules(frame(spark, rows), min_support=0.005, min_confidence=0.3, min_lift=1.2))
    want = {k: v for k, v in brute(rows, 0.005).items() if v[2].expected >= 0.3 and v[3].expected >= 1.2}
    assert rules == want and want


def test_a_basket_of_ten_thousand_products(spark):
    big = [("big", f"q{k}") for k in range(10_000)]
    rows = big + [(f"b{k}", f"q{j}") for k in range(20) for j in (k, k + 1, 9_999)]
    rules = got(B.cross_sell_rules(frame(spark, rows), min_support=0.1))
    assert rules == brute([r for r in rows if r[0] != "big" or int(r[1][1:]) < 25 or r[1] == "q9999"], 0.1)


def test_copies_of_one_basket_are_one_row_with_a_weight(spark):
    rows = [(f"c{k}", f"x{j}") for k in range(2_000) for j in range(12)] + [(f"d{k}", "x1") for k in range(1_000)]
    rules = got(B.cross_sell_rules(frame(spark, rows), min_support=0.5))
    assert len(rules) == 12 * 11 and set(v[0] for v in rules.values()) == {2_000}
    assert rules["x1", "x2"][2] == pytest.approx(2 / 3) and rules["x2", "x1"][2] == 1.0


def test_empty_and_single(spark):
    assert B.cross_sell_rules(frame(spark, [("a", "p")]).where("false")).count() == 0
    assert B.cross_sell_rules(frame(spark, [("a", "p"), ("b", "q")])).count() == 0


def test_no_pair_is_a_row_before_it_is_counted(spark):
    from pyspark.sql import functions as F
    df = B.cross_sell_rules(frame(spark, market()), min_support=0.01)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert df.where(F.col("antecedent") == F.col("consequent")).count() == 0
