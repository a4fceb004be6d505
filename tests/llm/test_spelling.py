import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillscope.llm import spelling as S
from tillscope.session import materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(rows):
    total = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if n >= 5 and len(w) >= 6}


def edits(w):
    """Every word with one code point less, keyed for comparing: near words share such a key or are one."""
    return {w[:i] + w[i + 1:] for i in range(len(w))}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and a in edits(b)


def brute(rows):
    return brute_groups(brute_counts(rows))


def brute_groups(words):
    by = defaultdict(set)
    for w in words:
        by[w].add(w)
        for e in edits(w):
            by[e].add(w)
    near = defaultdict(set)
    for group in by.values():
        for a in group:
            near[a].update(b for b in group if a != b and one_edit(a, b))
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def corpus(seed, docs=300):
    """Words with edits of all kinds at all places, shared halves, Latin-1 letters and capitals."""
    rng = random.Random(seed)
    letters = "abcdeé×ß"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(25)]
    base += ["prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(60)]
    base += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abcabcabc", "abcabcab"]
    pool = list(base)
    for w in base:
        for _ in range(4):
            k = rng.randrange(len(w))
            pool.append(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:],
                                    w[:k] + rng.choice(letters) + w[k + 1:]]))
    weights = [rng.choice([1, 1, 2, 20, 100]) for _ in pool]
    return [(i, " ".join(x.upper() if rng.random() < .1 else x for x in rng.choices(pool, weights, k=60)) + "!")
            for i in range(docs)]


def got(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("group", [1, 2048])
def test_variants_match_brute_force(spark, odd, group):
    """With a bound of one pair a group every shared chunk is cut down to single characters."""
    rows = corpus(group)
    out = S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), group)
    want = brute(rows)
    assert got(out) == want and any(f for _, f, *_ in want)


def test_odd_documents(odd, rows):
    assert got(S.spelling_variants(odd)) == brute(rows)


def test_empty_table(empty):
    out = S.spelling_variants(empty)
    assert out.count() == 0 and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_long_texts_and_runs(spark, odd):
    rows = [(1, "x" * 3_000_000 + " " + "variant " * 7), (2, None), (3, "Variant varient"),
            (None, "variant " * 100 + "varient " * 6)]
    assert got(S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_a_hot_chunk_makes_no_pairs_of_all_its_words(spark, odd):
    """Thousands of words with one half in common: the groups that are paired stay small, and no pair is lost."""
    rng = random.Random(5)
    words = {"common" + "".join(rng.choice("abcdefghij") for _ in range(6)): rng.randint(5, 900) for _ in range(4000)}
    df = materialize(spark.createDataFrame(list(words.items()), "word string, n long"), "t-words")
    near = {(r["word"], r["near"]) for r in S.near_words(df).collect()}
    by = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by[k, w[:k] + w[k + 1:]].add(w)
    assert near == {(a, b) for g in by.values() for a in g for b in g if a != b}


def test_counts_are_of_whole_texts_and_in_code_point_order(spark, odd):
    rows = [(k, "zebraa zebrab zebrac ") for k in range(6)] + [(9, "zebrad " * 40)]
    out = {r["word"]: r for r in S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out["zebraa"]["form"] == "zebrad" and out["zebraa"]["n_near"] == 3 and out["zebrad"]["form"] is None
    assert S.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n")).first()[0] == 58


def test_roots_follow_chains_to_their_end(spark, odd):
    rows = [(k, "rooted " * 40 + "rootez " * 6 + "rooxez " + "loxxez" * (k < 1)) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = got(S.spelling_variants(df))
    assert out == brute(rows)
    assert {(w, f, r) for w, f, r, *_ in out} >= {("rooxez", "rootez", "rooted"), ("rootez", "rooted", "rooted")}
