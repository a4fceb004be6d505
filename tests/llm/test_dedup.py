import re
from collections import Counter, defaultdict
from hashlib import sha256

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.llm import exact_dedup as D
from tillscope.llm import fuse
from tillscope.llm import ngram_join as N
from tillscope.llm.components import components
from tillscope.llm.shingles import shingle_sets


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 50_000])
def test_fuse_filter_never_misses(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    f = fuse.build(keys)
    assert fuse.contains(keys, *f).all()
    others = rng.integers(2**63, 2**64 - 1, 100_000, dtype=np.uint64)
    assert fuse.contains(others, *f).mean() < 0.01


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[normal(t)].append(i)
    return by


@pytest.mark.parametrize("condition", ["doc_id % 2 = 0", "false", "true", "doc_id < 100"])
def test_exact_dedup_against_any_snapshot(odd, rows, condition):
    by = groups(rows)
    got = D.exact_dedup(odd, F.expr(condition)).collect()
    assert len(got) == len(rows)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    want = Counter((i, least(by[normal(t)]), len(by[normal(t)]), sha256(normal(t).encode()).hexdigest())
                   for i, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(by)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_drop_duplicates_keeps_one_row_and_the_columns(odd, rows):
    out = D.drop_duplicates(odd)
    assert out.columns == odd.columns
    assert Counter(normal(r["text"]) for r in out.collect()) == Counter(groups(rows).keys())


def test_texts_that_share_a_digest_are_not_merged(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    digest = docs.where("doc_id = 1").select(D.text_digest(F.col("text"))).first()[0]
    first = "struct<z: boolean, doc_id: long, rid: long>"
    pairs = spark.createDataFrame([(digest, (False, 1, 0), (False, 2, 1))],
                                  f"digest binary, first {first}, other {first}")
    assert D.same_bytes(pairs, docs).count() == 0


def test_empty_tables(empty):
    assert D.exact_dedup(empty, F.lit(True)).count() == 0 and D.drop_duplicates(empty).count() == 0
    assert N.near_classes(empty).count() == 0 and N.drop_near_duplicates(empty).count() == 0


def test_shingle_sets_match_brute_force(rows):
    texts = [(t or "").encode() for _, t in rows]
    sets = list(shingle_sets(texts, 500))
    want = [brute.shingles(t) for _, t in rows]
    assert [len(s) for s in sets] == [len(w) for w in want]
    named = {}
    for s, w in zip(sets, want):
        assert named.setdefault(w, s.tobytes()) == s.tobytes()
    assert len({s.tobytes() for s in sets}) == len(set(want))


def test_near_classes_match_brute_force(unique, unique_rows):
    want = brute.components(unique_rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_classes(unique).collect()}
    assert got == want
    kept = {r["doc_id"] for r in N.drop_near_duplicates(unique).select("doc_id").collect()}
    assert kept == {c for _, c in want.values()}


def test_repeated_rows_and_null_ids(odd, rows):
    got = N.near_classes(odd).collect()
    want = brute.components([r for r in rows if r[0] is not None])
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter(
        (i, None if i is None else want[i][1]) for i, _ in rows)


def test_links_across_hubs(spark):
    """Chains and groups of near copies whose members are not all linked to the hub."""
    import random
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        w = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        for _ in range(14):
            rows.append((n, " ".join(w)))
            n += 1
            w = list(w)
            k = rng.randrange(110)
            w[k:k + rng.randint(1, 8)] = [f"v{rng.randrange(10**9)}"]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in
           N.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: c for i, (_, c) in brute.components(rows).items()}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5000, 4999), (4999, 5000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + k] == 1000 for k in range(50))
    assert got[5000] == got[4999] == 4999 and len(got) == 201 + 50 + 2


def test_texts_of_one_id_are_dropped_each_by_its_own(spark):
    a = " ".join(f"w{k}" for k in range(60))
    rows = [(1, a), (2, a + " more"), (2, "a text unlike any other one here"), (3, a + " more words"), (4, None),
            (5, "five different words are here"), (5, None), (None, a)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, _gone string, tag string")
    out = N.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(
        [rows[0], rows[2], rows[4], rows[5], rows[6], rows[7]])


def test_fragments_larger_than_a_task_takes(spark, unique, unique_rows, monkeypatch):
    """Every fragment is dealt out by shingle, and some."""
    want = brute.components(unique_rows)
    for largest in (0, 1500):
        monkeypatch.setattr(N, "LARGEST", largest)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_classes(unique).collect()}
        assert got == want


@pytest.mark.parametrize("fragments", [32, 1000, 65536, 65537, 1_000_003, 2**31 - 1])
def test_shingles_come_back_from_their_fragments(fragments):
    h = np.random.default_rng(4).integers(0, 2**64 - 1, 3000, dtype=np.uint64, endpoint=True)
    h[:3] = 0, 2**64 - 1, 2**63
    f = N._fragment(h, fragments)
    low = N._unpack(np.frombuffer(N._pack(h), np.uint8))
    back = np.array([N._whole(low[i:i + 1], int(f[i]), fragments)[0] for i in range(len(h))])
    assert len(set(back.tolist())) == len(set(h.tolist()))
    if fragments > 65536:
        assert (back == h).all()
