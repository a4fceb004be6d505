"""Property tests of the distributed primitives against brute force in Python."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillscope.operators.ranking import global_row_number, multi_quantiles

values = st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6, allow_nan=False)),
                  min_size=1, max_size=60)
probs = st.lists(st.floats(0.0, 1.0), min_size=1, max_size=4)
common = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def brute_quantile(xs, p):
    xs = sorted(x for x in xs if x is not None)
    if not xs:
        return None
    return xs[max(1, math.ceil(p * len(xs))) - 1]


@common
@given(a=values, b=values, ps=probs)
def test_multi_quantiles_match_definition(spark, a, b, ps):
    n = max(len(a), len(b))
    a, b = a + [None] * (n - len(a)), b + [None] * (n - len(b))
    df = spark.createDataFrame([(None if x is None else float(x), None if y is None else float(y))
                                for x, y in zip(a, b)], "a double, b double").repartition(3)
    row = multi_quantiles(df, ["a", "b"], ps).first()
    for col, xs in (("a", a), ("b", b)):
        want = [brute_quantile([None if x is None else float(x) for x in xs], p) for p in ps]
        got = row[col]
        if all(w is None for w in want):
            assert got is None or all(g is None for g in got)
        else:
            assert got == want


@common
@given(keys=st.lists(st.integers(0, 6), min_size=1, max_size=80))
def test_global_row_number_is_a_stable_sort(spark, keys):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k long").repartition(4)
    got = {r["id"]: r["rn"] for r in global_row_number(df, [F.col("k").desc(), F.col("id")], "rn").collect()}
    order = sorted(range(len(keys)), key=lambda i: (-keys[i], i))
    assert got == {i: pos + 1 for pos, i in enumerate(order)}
