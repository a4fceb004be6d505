import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillscope.llm import grid as G
from tillscope.llm import hard_negatives as H
from tillscope.llm import hash_search as A
from tillscope.llm.common import visible_to_workers

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, vid string, twin string, key string, code string, " \
         "ids string, rank string, score string, _qb string, _n string"


def table(spark, rows):
    """Rows (vec_id, embedding, label) with further columns of clashing names."""
    visible_to_workers(spark)
    return spark.createDataFrame([(*r, *["x"] * 11) for r in rows], SCHEMA).repartition(3)


def vectors(seed, n, dim=12, clusters=8, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    which = rng.integers(0, clusters, n)
    v = (centres[which] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    return [(i, [float(x) for x in row], int(c) % 10) for i, row, c in zip(range(n), v, which)]


ODD = [(None, [1.0] * 12, 1), (5000, None, 1), (5100, [1.0] * 12, None), (5200, [float("nan")] + [1.0] * 11, 1),
       (5300, [float("inf")] * 12, 2), (5400, [None] + [1.0] * 11, 2), (5500, [], 3), (5600, [0.0] * 12, 3),
       (5700, [0.5, 0.25], 4), (-100, [0.3] * 12, 1), (-101, [0.3] * 12, 2)]


def taking(rows, zero=False):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = {(i, None if v is None else tuple(v), c) for i, v, c in rows}
    return [r for r in rows if r[0] is not None and ok(r[1]) and (any(r[1]) or not zero)]


def brute_negatives(rows):
    rows = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v], (c + 1) % 10 if i % 7 == 0 else c)
            for i, v, c in taking([r for r in rows if r[2] is not None])]
    dot = lambda a, b: max(-2**63, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b))))
    out = []
    for i, v, c in rows:
        if i % 100:
            continue
        ranked = sorted((-dot(v, w), j, d) for j, w, d in rows if j != i)
        for p, j, _ in [x for x in ranked if x[2] == c][:5]:
            fit = [(q, k) for q, k, d in ranked if d != c and 30 * -p <= 100 * -q <= 90 * -p][:10]
            out += [(i, j, r, k, -p, -q) for r, (q, k) in enumerate(fit, 1)]
    return sorted(out)


def got_negatives(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in names) for r in df.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(H, "ROW_BLOCK", 100)
    monkeypatch.setattr(A, "QUERY_BLOCK", 30)
    monkeypatch.setattr(A, "ROW_BLOCK", 200)


def test_hard_negatives_match_brute_force(spark, small_blocks):
    base = vectors(1, 700)
    hot = [(10_000 + k, base[3][1], 1) for k in range(150)]  # a common vector, with an anchor and every seventh id
    rows = base + hot + ODD + base[:20] + [(100, base[9][1], 7), (200, base[9][1], base[200][2])]
    want = brute_negatives(rows)
    got = got_negatives(H.hard_negatives(H.quantised(table(spark, rows)), F.col("id") % 100 == 0))
    assert got == want and len(want) > 300


def test_hard_negatives_of_huge_and_negative_components(spark, small_blocks):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([0, 3, 20, 30]) for _ in range(4)], i % 2)
            for i in range(0, 400, 5)] + [(1, [0.0] * 4, 0), (2, [0.0] * 4, 1), (300, [0.0] * 4, 0)]
    long = lambda x: max(-2**63, min(2**63 - 1, math.floor(x)))
    kept = [(i, [long(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows]
    want = []
    dot = lambda a, b: long(sum(x * y for x, y in zip(a, b)))
    kept = sorted({(i, tuple(v), (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in kept})
    for i, v, c in kept:
        if i % 100 == 0:
            ranked = sorted((-dot(v, w), j, d) for j, w, d in kept if j != i)
            for p, j, _ in [x for x in ranked if x[2] == c][:5]:
                fit = [(q, k) for q, k, d in ranked if d != c and 30 * -p <= 100 * -q <= 90 * -p][:10]
                want += [(i, j, r, k, -p, -q) for r, (q, k) in enumerate(fit, 1)]
    assert got_negatives(H.hard_negatives(H.quantised(table(spark, rows)), F.col("id") % 100 == 0)) == sorted(want)


def test_keys_sort_as_their_parts():
    rng = np.random.default_rng(3)
    cols = [rng.integers(-5, 5, 200), rng.integers(-2**62, 2**62, 200), rng.integers(-9, 9, 200), rng.integers(-9, 9, 200)]
    rows = []
    for kind in (0, 1):
        keys = H.pack(cols[0], cols[1], cols[2], kind, cols[3])
        back = list(H.unpack(keys))
        assert back == [(a, t, s, kind, i) for a, t, s, i in zip(*(c.tolist() for c in cols))]
        rows += list(zip(keys.to_pylist(), back))
    assert [r for _, r in sorted(rows)] == [r for r in sorted((x for _, x in rows),
                                                              key=lambda r: (r[0], r[1], -r[2], r[3], r[4]))]


def test_the_iterator_gets_the_same_windows_in_any_batches():
    keys = pa.concat_arrays([H.pack(*(np.array([x]) for x in (1, 0, 1000)), 0, np.array([7])),
                             H.pack(*(np.array([x]) for x in (1, 0, 1000)), 1, np.array([3])),
                             H.pack(np.full(30, 1), np.zeros(30), np.arange(920, 890, -1), 1, np.arange(30)),
                             H.pack(*(np.array([x]) for x in (1, 0, 300)), 1, np.array([5]))])
    whole = pa.RecordBatch.from_arrays([keys], names=["key"])
    single = [whole.slice(i, 1) for i in range(len(keys))]
    a, b = (pa.Table.from_batches(H._windows(10)(iter(x))).to_pylist() for x in ([whole], single))
    assert a == b and [r["negative_score"] for r in a] == list(range(900, 890, -1))


def brute_nearest(rows, k=20):
    rows = taking([(i, v, 0) for i, v, _ in rows], zero=True)
    width = max(len(v) for _, v, _ in rows)
    m = np.array([[np.float64(np.float32(x)) for x in v] + [0.0] * (width - len(v)) for _, v, _ in rows])
    out = defaultdict(list)
    for n, (i, v, _) in enumerate(rows):
        if i % 20 == 0:
            score = np.zeros(len(rows))
            for d in range(width):
                score += m[n, d] * m[:, d]
            out[i].append(sorted((-score[j], rows[j][0]) for j in range(len(rows)) if j != n)[:k])
    return out


def test_search_finds_nine_tenths(spark, small_blocks):
    base = vectors(4, 1500, dim=16, spread=0.7)
    rows = base + [(20_000 + k, base[5][1], 0) for k in range(500)] + [r for r in ODD if r[0] != 5500] + base[:30]
    want = brute_nearest(rows)
    found = defaultdict(list)
    for r in A.neighbours(A.searchable(table(spark, rows)), F.col("id") % 20 == 0).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    hits = total = 0
    for q, lists in want.items():
        mine = sorted(found[q])
        assert [r for r, *_ in mine] == list(range(1, 21))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in lists[0]})
        total += 20
    assert hits / total >= 0.9
    # a common vector: its smallest ids, the query itself left out
    assert [i for _, i, _ in sorted(found[20_000])] == [i for _, i in want[20_000][0]]


def test_the_widest_radius_is_exact(spark, small_blocks):
    rows = vectors(6, 300, dim=6)
    want = brute_nearest(rows, 7)
    for radius in (0, A.BITS):  # with none, every query is searched again
        got = defaultdict(list)
        for r in A.neighbours(A.searchable(table(spark, rows)), F.col("id") % 20 == 0, 7, radius).orderBy("rank").collect():
            got[r["query_id"]].append((-r["score"], r["vec_id"]))
        assert got == {q: lists[0] for q, lists in want.items()}


def test_few_rows_and_empty_tables(spark):
    few = table(spark, vectors(7, 5, dim=3))
    assert sorted(r["rank"] for r in A.neighbours(A.searchable(few), F.col("id") % 20 == 0).collect()) == [1, 2, 3, 4]
    none = few.where("vec_id > 100")
    assert A.neighbours(A.searchable(none), F.col("id") % 20 == 0).count() == 0
    assert A.neighbours(A.searchable(few), F.lit(False)).count() == 0
    assert H.hard_negatives(H.quantised(none), F.col("id") % 100 == 0).count() == 0


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 2**63, (400, A.BITS // 64), dtype=np.uint64)
    asked = codes[:40].copy()
    for i, row in enumerate(asked):  # i bits away
        for bit in rng.choice(A.BITS, i, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    index = A.SubstringIndex(codes)
    for radius in (0, 1, 3, 15, 16, 17, 40, 110, 256):
        assert A.shares(radius).sum() >= radius - A.SHARED + 1 or radius == 0
        d = np.bitwise_count(asked[:, None] ^ codes[None]).sum(-1)
        q, c = index.within(asked, radius)
        assert set(zip(q.tolist(), c.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(d <= radius))))


def test_codes_order_products_of_any_norms():
    rng = np.random.default_rng(9)
    v = rng.normal(size=(500, 8)) * rng.uniform(0.1, 3, (500, 1))
    norm = float(np.sqrt((v ** 2).sum(1)).max())
    a, b = A.extended(v[:5], norm, True), A.extended(v, norm, False)
    assert np.allclose((b ** 2).sum(1), 1)
    for x, angle in zip(v[:5], a):
        assert (np.argsort(v @ x, kind="stable") == np.argsort(b @ angle, kind="stable")).all()


def test_every_pair_of_blocks_is_one_cell(spark):
    visible_to_workers(spark)
    a, b = spark.range(23).toDF("x").repartition(2), spark.range(100, 157).toDF("x").repartition(2)

    def pairs(left, right):
        x, y = left["x"].to_numpy(), right["x"].to_numpy()
        return pa.table({"x": np.repeat(x, len(y)), "y": np.tile(y, len(x))})
    out = G.cells(a, b, "x", 5, 10, pairs, "x long, y long")
    assert out.count() == out.distinct().count() == 23 * 57


def test_short_lists_are_filled_up():
    m = G.matrix(pa.chunked_array([pa.array([[1.0], [], [2.0, 3.0]])]), np.float64, 3)
    assert m.tolist() == [[1, 0, 0], [0, 0, 0], [2, 3, 0]]
