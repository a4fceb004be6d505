"""As-of and interval joins against brute force."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest

from tillscope.operators import temporal as TP

T0 = dt.datetime(2024, 1, 1)


def moments(rng, n, days=200):
    return [T0 + dt.timedelta(minutes=rng.randrange(days * 24 * 60) if rng.random() < .7 else rng.randrange(5) * 1440 * 30)
            for _ in range(n)]


@pytest.mark.parametrize("strict", [False, True])
def test_asof_matches_brute_force(spark, strict):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot", "hot", "a", "b", "c", None])
    rows = [(i, key(), t) for i, t in enumerate(moments(rng, 400))] + [(900, "a", None), (901, "none", T0), (902, "hot", T0)]
    rows += rows[:5]
    history = [(key(), t, rng.randrange(100)) for t in moments(rng, 120)] + [("a", None, 1), ("hot", T0, 5), ("hot", T0, 9)]
    left = spark.createDataFrame(rows, "id int, k string, at timestamp").repartition(3)
    right = spark.createDataFrame(history, "k string, since timestamp, price int").repartition(2)
    out = TP.asof_join(left, right, "k", "at", "since", ["price"], bucket="7 days", strict=strict)
    assert out.columns == ["id", "k", "at", "price"]

    def held(k, t):
        fit = [(s, p) for x, s, p in history if k is not None and x == k and s is not None and t is not None
               and (s < t if strict else s <= t)]
        return max(fit)[1] if fit else None
    want = sorted((i, held(k, t) if held(k, t) is not None else -1) for i, k, t in rows)
    assert sorted((r["id"], r["price"] if r["price"] is not None else -1) for r in out.collect()) == want


def test_asof_without_history(spark):
    left = spark.createDataFrame([(1, "a", T0)], "id int, k string, at timestamp")
    right = spark.createDataFrame([], "k string, since timestamp, price int")
    assert [tuple(r) for r in TP.asof_join(left, right, "k", "at", "since", ["price"]).collect()] == [(1, "a", T0, None)]
    assert TP.asof_join(left.where("false"), right, "k", "at", "since", ["price"]).count() == 0


@pytest.mark.parametrize("on", [(), ("k",)])
def test_intervals_match_brute_force(spark, on):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), t) for i, t in enumerate(moments(rng, 300))] + [(999, "a", None)]
    spans = []
    for n, t in enumerate(moments(rng, 80)):
        length = rng.choice([0, 1e-6, 1, 3600, 86400, 86400 * 5, 86400 * 90, -60])
        spans.append((n, rng.choice("ab"), t, t + dt.timedelta(seconds=length)))
    spans += [(500, "a", None, T0), (501, "a", T0, None)]
    left = spark.createDataFrame(rows, "id int, k string, at timestamp").repartition(3)
    right = spark.createDataFrame(spans, "promo int, k string, a timestamp, z timestamp")
    if not on:
        right = right.drop("k")
    out = TP.interval_join(left, right, "at", "a", "z", on)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sorted((i, p) for i, k, t in rows for p, q, a, z in spans
                  if None not in (t, a, z) and a <= t < z and (not on or k == q))
    assert sorted((r["id"], r["promo"]) for r in out.collect()) == want and want


def test_no_intervals(spark):
    left = spark.createDataFrame([(1, T0)], "id int, at timestamp")
    right = spark.createDataFrame([(1, T0, T0)], "promo int, a timestamp, z timestamp")
    assert TP.interval_join(left, right, "at", "a", "z").count() == 0


@pytest.mark.parametrize("whole_days", [True, False])
def test_totals_of_intervals_do_not_pair_rows(spark, monkeypatch, whole_days):
    rng = random.Random(9)
    rows = [(t, D(rng.randrange(1, 900)) / 100) for t in moments(rng, 400, days=40)] * 3 + [(None, D(1)), (T0, None)]
    spans = []
    for n in range(60):
        a = T0 + (dt.timedelta(days=rng.randrange(40)) if whole_days else dt.timedelta(minutes=rng.randrange(40 * 1440)))
        spans.append((n, a, a + (dt.timedelta(days=rng.choice([0, 1, 5, 14, -1])) if whole_days
                                 else dt.timedelta(minutes=rng.choice([0, 7, 600, 1440, 9000, -60])))))
    spans += [spans[0], (500, None, T0), (501, T0, None)]
    left = spark.createDataFrame(rows, "at timestamp, v decimal(12,2)").repartition(4)
    right = spark.createDataFrame(spans, "promo int, a timestamp, z timestamp")
    met, join = [], TP.interval_join

    def spy(side, *args):
        met.append(side.count())
        return join(side, *args)
    monkeypatch.setattr(TP, "interval_join", spy)
    got = {r["promo"]: (r["transaction_count"], r["v"])
           for r in TP.interval_totals(left, right, "at", "a", "z", ["promo"], "v").collect()}
    want = {}
    for p, a, z in spans:
        held = [v for t, v in rows if None not in (t, a, z) and a <= t < z]
        n, v = want.get(p, (0, None))
        if held:
            some = [x for x in held if x is not None]
            want[p] = (n + len(held), sum(some, v or D(0)) if some else v)
    assert got == want and want
    # days, and moments only where an interval does not end at midnight
    assert met[0] <= 160 and (len(met) == 1) == whole_days
