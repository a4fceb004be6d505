"""Sharding and line quality: built-in functions only."""

import re
import zlib
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from tillscope.llm import line_quality as L
from tillscope.llm import shards as S

PYTHON = re.compile("Python|Pandas|Arrow")


def check_shards(got, rows, n):
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(0 <= s < n for s in by)
    assert all(abs(sum(r["size"] for r in by[s]) - total / n) <= largest for s in by)


@pytest.mark.parametrize("n,range_rows", [(8, 1_000_000), (3, 5)])
def test_shards_are_even_and_gapless(odd, rows, n, range_rows):
    check_shards(S.shard_by_bytes(odd, n, range_rows).collect(), rows, n)


def test_one_hot_text_is_subdivided(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = S.shard_by_bytes(df, 8, 50)
    check_shards(got.collect(), rows, 8)
    again = S.shard_by_bytes(df.repartition(2), 8, 700)  # the sample and the layout don't decide the result
    key = ["doc_id", "shard", "slot"]
    assert sorted(got.select(key).collect()) == sorted(again.select(key).collect())


def test_empty_table(empty):
    assert S.shard_by_bytes(empty, 8).count() == 0
    assert L.line_quality(empty).count() == 0 and L.clean_documents(empty).columns == empty.columns


def test_line_quality_counts(odd, rows):
    got = L.line_quality(odd)
    want = Counter((i, *brute.quality(t)) for i, t in rows)
    assert Counter(tuple(r)[:7] for r in got.collect()) == want
    assert got.where("base_failed AND kept").count() == 0
    assert not PYTHON.search(got._jdf.queryExecution().executedPlan().toString())


def test_lines_go_first_then_documents(spark):
    good = "This line is plain prose and ends as such.\nSo does this second one, with a few more words.\n"
    menu = "Home | News | Sport | About us | Contact\n"
    rows = [(1, good + menu), (2, good + menu * 8), (3, good + "We use cookies on this site."), (4, good * 1)]
    out = {r["doc_id"]: r for r in L.clean_documents(spark.createDataFrame(rows, "doc_id long, text string")
                                                     .withColumn("n_chars", F.length("text"))).collect()}
    assert set(out) == {1, 3, 4} and out[1]["text"] == good.strip() == out[3]["text"]
    assert out[1]["n_chars"] == len(good.strip())


def test_long_lines_stay_whatever_they_name(spark):
    prose = ("The paper wrote at length about what the town had seen that year, and people read it with care. "
             "A second part told how the mill by the river was sold, who bought it and why nobody spoke of the price. ")
    french = "Le maire a dit « oui » au projet, puis « non » à la suite, et chacun est parti chez soi le soir venu."
    stay = [prose + "Its privacy policy and its terms of use were new, so readers had to click here.",
            prose + "In the shell one writes a | b | c for it, with • and » and › as marks.",
            french, "Er sagte »ja« und sie »nein«, dann ›ja‹ und ›nein‹, und alle gingen am Abend nach Hause."]
    go = ["Home | News | Sport | About us | Contact.", "Home » News » Sport.", "Start › Office › Chairs and tables.",
          "• one • two • three words here.", "« Previous | 1 | 2 | 3 | Next ».", "All rights reserved.",
          "We use cookies on this site.", "Privacy policy. Terms of use."]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(stay + go)], "doc_id long, text string")
    fails = lines.select("doc_id", L.line_fails(F.col("text")).alias("fails")).collect()
    assert {r["doc_id"] for r in fails if r["fails"]} == set(range(len(stay), len(stay + go)))
    docs = L.clean_documents(lines).collect()
    assert sorted(r["text"] for r in docs) == sorted(stay)  # single-line documents, kept as they are


def test_clean_documents_keep_the_columns(odd):
    out = L.clean_documents(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes and out.where("kept != 'x'").count() == 0


def test_line_quality_searches_its_texts_by_patterns_only(spark):
    """No look-up of single characters, no copy for each window; results at the edges of the faster searches."""
    lines = [("Done.", False), ("Done" + "." + "”" * 40, False), ("Done." + "\t \r" * 30, False), ("Done.\u2028", False),
             ("Done" + ")" * 40, True), ("a | b • c.", True), ("#_[^]\\ one $ two *", True), ("well = fine, #1 of _two_, and that is all.", False),
             ("Back to Top.", True), ("All rights  reserved.", False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["f"] for r in df.select("doc_id", L.line_fails(F.col("text")).alias("f")).collect()}
    assert got == {i: fails for i, (_, fails) in enumerate(lines)}
    plan = L.line_quality(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "slice(" not in plan
    phrases = "five words come here again " * 4
    texts = spark.createDataFrame([(1, phrases), (2, "a # b\t\nc"), (3, "x y z " * 3 + "*|*")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_repeat_words"], r["n_symbols"], r["word_chars"]) for r in L.line_quality(texts).collect()}
    assert found == {1: (20, 0, 88), 2: (0, 1, 4), 3: (9, 3, 12)}
