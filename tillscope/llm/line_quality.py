"""Line-first quality rules (built-in functions only).

Each line is judged first: navigation (several separators, one for every few
words), boilerplate (fixed phrases of web pages that make up half of the line or
more) and punctuation (no sentence end, or mostly symbols and
shouting marks). Failing lines are removed; a document that loses more than
``MAX_LOSS`` of its words to removed lines, or fails the base rules (too few
words, too many repeated 5-word windows), is rejected. All of it is one
projection over a row: no shuffle, no Python.

Results for odd input: a null text has no words and is rejected, as is an empty
one; lines without a word are dropped; repeated rows are judged alike; other
columns are ignored by ``line_quality`` and kept by ``clean_documents``.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import SPACE_CHARS, SPACE_CLASS, free_name

#: A document may lose this share of its words to removed lines.
MAX_LOSS = 0.5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
#: A line is noise with so many marks, if they are a tenth of it; and short below so many words.
LEAST_MARKS = 3
SHORT_LINE = 8
SYMBOLS = "#*$%&|<>"
#: Characters at the end of a line that are searched for a sentence end first.
TAIL = 16
#: A line is navigation with so many separators, if no more than so many words come to each.
LEAST_SEPARATORS = 2
WORDS_PER_SEPARATOR = 6
#: Sentence ends, and closing marks that may follow them.
SENTENCE_END = r"[.!?:;…。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
#: Fixed phrases of web page furniture, in lower case.
BOILERPLATE = ["javascript is disabled", "enable javascript", "accept all cookies", "we use cookies",
               "cookie policy", "privacy policy", "terms of service", "terms of use", "all rights reserved",
               "click here", "sign up for our newsletter", "subscribe to our newsletter", "log in or register",
               "skip to content", "skip to main content", "back to top", "share on facebook", "lorem ipsum"]


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def _words(text: Column) -> Column:
    t = _trim(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_CLASS + "+"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with value worked out once for the row (a one-element transform binds it)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _n_words(line: Column) -> Column:
    """Words of a line: its runs of white space once trimmed, plus one."""
    return F.when(_trim(line) == "", 0).otherwise(F.size(F.split(_trim(line), SPACE_CLASS + "+")))


def _count_of(line: Column, chars: str) -> Column:
    # not by ``translate``, which looks every character up as a string of its own
    return F.length(line) - F.length(F.regexp_replace(line, "[" + re.sub(r"(\W)", r"\\\1", chars) + "]+", ""))


def line_fails(line: Column) -> Column:
    """True for a line that is navigation, boilerplate or not punctuated as prose.

    A long line without a sentence end stays (a cut-off paragraph); a short one
    is a heading, a button or a list entry. Separators and phrases are held
    against the length of the line, so a paragraph that quotes or names them stays.
    """
    # a closing quotation mark is no separator: « » and » « (and the single ones) are counted off in pairs
    separators = (_count_of(line, "|•") + F.greatest(F.lit(0), _count_of(line, "»") - _count_of(line, "«"))
                  + F.greatest(F.lit(0), _count_of(line, "›") - _count_of(line, "‹")))
    navigation = (_count_of(line, "|»›•") >= LEAST_SEPARATORS) & (separators >= LEAST_SEPARATORS) \
        & (_n_words(line) <= separators * WORDS_PER_SEPARATOR)
    marks = _count_of(line, SYMBOLS + "!^~=_")
    noisy = (marks >= LEAST_MARKS) & (marks * 10 > F.length(line))
    # the end of a line mostly shows it; if not, the whole line is searched
    unfinished = ~F.right(line, F.lit(TAIL)).rlike(SENTENCE_END) & (_n_words(line) < SHORT_LINE) & ~line.rlike(SENTENCE_END)

    def boilerplate(low: Column) -> Column:
        named = reduce(or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE])
        return named & (F.length(F.regexp_replace(low, "|".join(BOILERPLATE), "")) * 2 <= F.length(low))
    return navigation | noisy | unfinished | _bound(F.lower(_trim(line)), boilerplate)


def _repeat_words(words: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more in the text."""
    n = F.size(words)
    # the hash of an array is that of its elements in turn, and a slice would copy them
    hashes = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            again = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                             | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def cover(p: Column) -> Column:
            # windows start at the places p; each covers 5 words, less what the next one covers
            return F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, 5).otherwise(
                F.least(F.lit(5), x - F.get(p, i - 1)))), F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)) \
            .otherwise(_bound(_bound(pairs, places), cover))

    return F.when(n < 5, F.lit(0)).otherwise(_bound(hashes, covered))


def _judgement() -> Column:
    """One struct for a row: counts, verdicts and the cleaned text.

    Every part that is used more than once is bound by a one-element transform,
    so a row's words, lines and windows are worked out once.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.transform(F.filter(F.split(t, "\n"), lambda x: _trim(x) != ""),
                        lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails")))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"),
                        F.length(F.array_join(w, "")).cast("long").alias("word_chars"))

    def of_lines(x: Column) -> Column:
        lost = F.aggregate(F.filter(x, lambda y: y["fails"]), F.lit(0), lambda a, y: a + _n_words(y["line"]))
        distinct = F.size(F.array_distinct(F.transform(x, lambda y: y["line"])))
        return F.struct((F.size(x) - distinct).cast("long").alias("n_dup_lines"), lost.cast("long").alias("lost_words"),
                        F.array_join(F.transform(F.filter(x, lambda y: ~y["fails"]), lambda y: y["line"]), "\n")
                        .alias("clean"))

    def verdict(q: Column) -> Column:
        n, repeated = q["w"]["n_words"], q["w"]["n_repeat_words"]
        base_failed = (n < MIN_WORDS) | (repeated * 100 > n * MAX_REPEAT_PCT)
        return F.struct(
            n.alias("n_words"), q["w"]["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"),
            q["l"]["n_dup_lines"].alias("n_dup_lines"), repeated.alias("n_repeat_words"),
            base_failed.alias("base_failed"),
            (~base_failed & (q["l"]["lost_words"] <= n * MAX_LOSS)).alias("kept"),
            (n - q["l"]["lost_words"]).alias("clean_words"), q["l"]["clean"].alias("clean"))

    return _bound(F.struct(
        _bound(_words(t), of_words).alias("w"), _bound(lines, of_lines).alias("l"),
        _count_of(t, SYMBOLS).cast("long").alias("n_symbols")), verdict)


def line_quality(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts, base_failed, kept and clean_words."""
    # a generator is evaluated once for a row, whatever columns and filters stand above it
    return docs.select("doc_id", F.inline(F.array(_judgement()))).drop("clean")


def clean_documents(docs: DataFrame) -> DataFrame:
    """The kept documents with failing lines removed from ``text``; every column of the input stays.

    ``n_chars``, where the input has it, is set to the length of the cleaned text.
    """
    q = free_name(docs, "_quality")
    kept = docs.select("*", F.explode(F.filter(F.array(_judgement()), lambda x: x["kept"])).alias(q))
    clean = F.col(f"{q}.clean")
    out = {"text": clean}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(clean).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])


def op8(spark, sf_dir: str) -> DataFrame:
    return line_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
