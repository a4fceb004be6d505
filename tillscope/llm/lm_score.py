"""Language-model scores by subword lattice likelihood.

The pieces of a public vocabulary, weighted at first by its stored scores, form
a unigram model whose weights are fitted to the training documents by expected
counts over the lattices (``ROUNDS`` rounds). A word's probability is the sum
over all its segmentations (forward recursion in log space), a text's the
product over its words and its end. Beside it stands the base: an add-half
unigram model of whole words.

Spark counts the words of all documents; lattices are worked out once for each
distinct word. Scoring then needs every token's count and marginal: the
commonest words (``HEAD`` at most, found by a histogram of counts) are broadcast
and summed where the documents are read, which also takes the hot keys out of
the join; the other words are joined by key and summed per document.

Results for odd input: a null or empty text is its end token alone; null ids
belong to the training part; repeated rows each get a row; with no training
documents the base counts are 0 and the vocabulary's stored weights stand; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import blocks, id_text, text_bytes
from tillscope.llm.lattice import lattices, vocabulary
from tillscope.session import materialize

ROUNDS = 2
#: Added to every piece's expected count.
SMOOTHING = 0.1
#: Commonest words broadcast at most.
HEAD = 200_000
#: Distinct words counted in a task before they are passed on.
HELD_WORDS = 300_000
FOLDS, HELD_OUT = 5, 1
LN10 = math.log(10)


def piece_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def with_fold(docs: DataFrame) -> DataFrame:
    """rid (a row's number), doc_id, held_out, text."""
    t = id_text(docs)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return t.select(F.monotonically_increasing_id().alias("rid"), "doc_id",
                    (fold == HELD_OUT).alias("held_out"), "text")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    train, every, docs = Counter(), Counter(), 0

    def rows() -> pa.RecordBatch:
        words = list(every)
        return pa.RecordBatch.from_pydict({
            "word": pa.array([w.decode("utf-8", "replace") for w in words], pa.string()),
            "c": pa.array([train[w] for w in words], pa.int64()),
            "c_all": pa.array([every[w] for w in words], pa.int64())})

    for b in batches:
        texts, held = text_bytes(b.column(1)), b.column(0).to_pylist()
        for t, out in zip(texts, held):
            words = t.lower().split()
            every.update(words)
            if not out:
                train.update(words)
                docs += 1
            if len(every) > HELD_WORDS:
                yield rows()
                train.clear()
                every.clear()
    if every:
        yield rows()
    if docs:  # the end token, which no word can equal
        yield pa.RecordBatch.from_pydict({"word": pa.array([" "], pa.string()), "c": pa.array([docs], pa.int64()),
                                          "c_all": pa.array([docs], pa.int64())})


def count_words(folded: DataFrame) -> DataFrame:
    """word, c (in training documents), c_all; the word of one space stands for the end token."""
    return folded.select("held_out", "text").mapInArrow(_count, "word string, c long, c_all long") \
        .groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def _expect(path: str, logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(logp))
        for b in batches:
            counts = b.column(1).to_numpy(zero_copy_only=False)
            for at, lattice in lattices(vocabulary(path), b.column(0).to_pylist()):
                total += lattice.expected(logp, counts[at])
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(ids, pa.int64()), "n": pa.array(total[ids])})
    return run


def fit(words: DataFrame, path: str, n_docs: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """log probabilities of the pieces, and of the end, after some rounds of expected counts.

    A round sends one number per piece of the fixed vocabulary to the driver.
    """
    v = vocabulary(path)
    logp = v.prior()
    if not n_docs:
        return logp, math.log(0.5)
    for _ in range(rounds):
        counts = np.full(v.size, SMOOTHING)
        got = words.select("word", "c").where("c > 0").mapInArrow(_expect(path, logp), "piece long, n double") \
            .groupBy("piece").agg(F.sum("n").alias("n")).collect()
        for r in got:
            counts[r["piece"]] += r["n"]
        total = counts.sum() + n_docs
        logp = np.log(counts / total)
    return logp, math.log(n_docs / total)


def _marginals(path: str, logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lm = np.zeros(b.num_rows)
            for at, lattice in lattices(vocabulary(path), b.column(0).to_pylist()):
                lm[at] = lattice.forward(lattice.weights(logp))[:, -1] / LN10
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lm)], names=["word", "c", "c_all", "lm"])
    return run


def head_words(scored: DataFrame, most: int = HEAD) -> pa.Table:
    """word, c, lm of the commonest words: whole classes of equal (rounded) counts, ``most`` words at most."""
    grade = F.floor(F.log2("c_all") * 8).cast("int")
    held, least = 0, None
    for r in scored.groupBy(grade.alias("g")).count().orderBy(F.desc("g")).collect():  # some hundred classes
        if held + r["count"] > most:
            break
        held, least = held + r["count"], r["g"]
    return scored.where(grade >= F.lit(least)).select("word", "c", "lm").toArrow()


_HEADS: dict[str, tuple] = {}  # of the last run, in each worker


def _tokens(head, end_c: int, end_lm: float):
    """Sums over the head words of each document (one row, keyed by no word), and a row per other word."""
    key = uuid.uuid4().hex
    schema = pa.schema([("rid", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("sums", pa.struct([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("base", pa.float64()), ("lm", pa.float64())]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _HEADS:
            _HEADS.clear()
            words, c, lm = head.value
            _HEADS[key] = ({w.encode(): i for i, w in enumerate(words)}, (c > 0).astype(np.int64),
                               np.log10(c + 0.5), lm)
        place, known, base, lm = _HEADS[key]
        for b in batches:
            texts = text_bytes(b.column(3))
            rids, ids, held = (b.column(k).to_pylist() for k in range(3))
            for i, j in blocks(texts):
                out_rid, out_word, out_n, sums = [], [], [], []
                for k in range(i, j):
                    tally = Counter(texts[k].lower().split())
                    tokens = sum(tally.values()) + 1
                    rest = [w for w in tally if w not in place]
                    times = [tally.pop(w) for w in rest]
                    at = np.fromiter(map(place.__getitem__, tally), np.int64, len(tally))
                    n = np.fromiter(tally.values(), np.int64, len(tally))
                    out_rid += [rids[k]] * (len(rest) + 1)
                    out_word += [w.decode("utf-8", "replace") for w in rest]
                    out_word.append(f" {rids[k]}")  # equals no word, and spreads over the partitions
                    out_n += times
                    out_n.append(0)
                    sums += [None] * len(rest)
                    sums.append({"doc_id": ids[k], "held_out": held[k], "n_tokens": tokens,
                                 "n_known": int((n * known[at]).sum()) + (end_c > 0),
                                 "base": float((n * base[at]).sum()) + math.log10(end_c + 0.5),
                                 "lm": float((n * lm[at]).sum()) + end_lm})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip((out_rid, out_word, out_n, sums), schema)], schema=schema)
    return run


def score_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, folded = docs.sparkSession, with_fold(docs)
    counted = materialize(count_words(folded), "lm-words")
    words = counted.where("word != ' '")
    totals = counted.where("c > 0").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    end = counted.where("word = ' '").first()
    end_c = end["c"] if end else 0
    logp, end_logp = fit(words, path, end_c)
    scored = materialize(words.mapInArrow(_marginals(path, logp), "word string, c long, c_all long, lm double"),
                         "lm-marginals")
    top = head_words(scored)
    head = spark.sparkContext.broadcast((top["word"].to_pylist(), top["c"].to_numpy(), top["lm"].to_numpy()))
    tokens = folded.mapInArrow(
        _tokens(head, end_c, end_logp / LN10),
        "rid long, word string, n long, sums struct<doc_id: long, held_out: boolean, n_tokens: long, "
        "n_known: long, base: double, lm: double>")
    joined = tokens.join(scored.select("word", "c", F.col("lm").alias("word_lm")), "word", "left")
    per = joined.groupBy("rid").agg(
        F.max("sums.doc_id").alias("doc_id"), F.max("sums.held_out").alias("held_out"),
        F.max("sums.n_tokens").alias("n_tokens"),
        (F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.lit(0)) + F.max("sums.n_known")).alias("n_known"),
        (F.coalesce(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)), F.lit(0.0)) + F.max("sums.base")).alias("base"),
        (F.coalesce(F.sum(F.col("n") * F.col("word_lm")), F.lit(0.0)) + F.max("sums.lm")).alias("score"))
    return per.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(n + 0.5 * (v + 1)))).alias("base_score"), "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), piece_model())
