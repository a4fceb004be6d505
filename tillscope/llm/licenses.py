"""Licence scans by a positional index of rare words.

Templates are short licence notices. Document frequencies of their words over
the whole corpus give each word's IDF, and the rarest words of each template and
of each of its mandatory key phrases are its entries in the index: (template,
position in it). A notice without a key phrase cannot count, so none that can is
missed for altered words elsewhere. A file is looked up
by those words only; each hit proposes a start for its template, and the other
template words are intersected by their positions relative to that start.
Proposals of one template whose starts lie close together (a few inserted or
missing words) are added up. A template counts when enough of its IDF weight
stands in place and each of its mandatory key phrases stands word for word in
the proposed stretch. A base phrase is a template that is all key phrase.

Words: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII characters.

Results for odd input: a null or empty text has no words and no labels (empty
strings, null places, score 0); repeated rows and null ids give a row each; an
empty table gives no rows; a text of any length is scanned whole; other columns
are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import id_text, text_bytes

#: The base: every place of these phrases is counted. Fixed values.
BASE = [("mit", "under the mit license"),
        ("apache-2", "apache license version 2"),
        ("cc-by-nc", "cc by nc")]
#: Notices as their licences publish them: label, notice, mandatory key phrases. Fixed values.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction",
     ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
                 "compliance with the license", ["apache license version 2"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
              "general public license as published by the free software foundation either version 2 of the license "
              "or at your option any later version", ["gnu general public license", "version 2"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
              "general public license as published by the free software foundation either version 3 of the license "
              "or at your option any later version", ["gnu general public license", "version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl", "gnu lesser general public license as published by the free software foundation",
     ["gnu lesser general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", ["permission to use copy modify and", "with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["unencumbered software released into the public domain"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights "
            "to this work", ["waived all copyright and related"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution 4 0"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license",
     ["creative commons attribution sharealike"]),
]
#: Index entries of a notice: so many of its rarest distinct words, besides the rarest of each key phrase.
ENTRIES = 3
#: Least share of a notice's IDF weight in place, and words by which starts of one copy may differ.
LEAST_SCORE = 0.6
SLACK = 6
#: What a change of place within a notice costs, in words.
SHIFT = 3

#: Upper case to lower, and what is neither digit, letter nor non-ASCII to a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    base: bool


def templates() -> list[Template]:
    split = lambda s: tuple(s.encode().split())
    return [Template(label, split(p), (split(p),), True) for label, p in BASE] + [
        Template(label, split(t), tuple(map(split, keys)), False) for label, t, keys in NOTICES]


class Index:
    """Template postings under their rarest words, with the weights that the corpus gives them."""

    def __init__(self, df: dict[str, int], n_docs: int):
        self.templates = templates()
        self.idf = {w: math.log((n_docs + 1) / (df.get(w.decode(), 0) + 1)) + 1e-9
                    for t in self.templates for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.weights = []
        for k, t in enumerate(self.templates):
            order = sorted(set(t.words), key=lambda w: (-self.idf[w], w))
            rare = set(order[:1 if t.base else ENTRIES])
            if not t.base:
                rare.update(next(w for w in order if w in key) for key in t.keys)
            for p, w in enumerate(t.words):
                if w in rare and not (t.base and t.words.index(w) != p):
                    self.postings.setdefault(w, []).append((k, p))
            self.weights.append(sum(self.idf[w] for w in t.words))

    def _in_place(self, t: Template, words: list[bytes], start: int) -> set[int]:
        lo, hi = max(0, -start), min(len(t.words), len(words) - start)
        return {p for p in range(lo, hi) if words[start + p] == t.words[p]}

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, base labels, all labels, best score."""
        postings = self.postings
        starts: dict[int, set[int]] = {}
        for i, w in enumerate(words):
            if w in postings:
                for k, p in postings[w]:
                    starts.setdefault(k, set()).add(i - p)
        places, base, labels, best = [], set(), set(), 0.0
        for k, found in starts.items():
            t = self.templates[k]
            if t.base:
                n = len(t.words)
                got = [s for s in found if s >= 0 and tuple(words[s:s + n]) == t.words]
                if got:
                    places += got
                    base.add(t.label)
                    labels.add(t.label)
                    best = 1.0
                continue
            at, last = sorted(found), 0
            for first, s in enumerate(at):  # every stretch of starts that lie within SLACK, but no part of another
                end = bisect_right(at, s + SLACK)
                if end > last:
                    last = end
                    score = self._score(k, t, words, at[first:end])
                    if score >= LEAST_SCORE:
                        labels.add(t.label)
                        best = max(best, score)
        return places, base, labels, best

    def _score(self, k: int, t: Template, words: list[bytes], starts: list[int]) -> float:
        """Share of the template's weight that stands in the file in the template's order; 0 without a key phrase.

        The matches of all starts of a run, as (place in the file, place in the
        template), form the heaviest chain that ascends in both. A chain may pass
        from one start to another, where words were put in or left out, at the
        price of ``SHIFT`` mean words: words in no order share few places.
        """
        matches = sorted((s + p, p) for s in starts for p in self._in_place(t, words, s))
        price = SHIFT * self.weights[k] / len(t.words)
        best: dict[int, tuple[float, int]] = {}  # by start: the heaviest chain's weight and its last template place
        total = 0.0
        for f, p in matches:
            held = best.get(f - p, (0.0, 0))[0]
            for other, (weight, last) in best.items():
                if last < p and other + last < f:
                    held = max(held, weight - price if other != f - p else weight)
            best[f - p] = held + self.idf[t.words[p]], p
            total = max(total, best[f - p][0])
        score = total / self.weights[k]
        lo, hi = max(0, starts[0] - SLACK), starts[-1] + len(t.words) + SLACK
        if score < LEAST_SCORE:
            return 0.0
        stretch = b" " + b" ".join(words[lo:hi]) + b" "
        if not all(b" " + b" ".join(key) + b" " in stretch for key in t.keys):
            return 0.0
        return min(1.0, score)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = frozenset(w for t in templates() for w in t.words)
    df: Counter = Counter()
    for b in batches:
        for t in text_bytes(b.column(0)):
            df.update(vocabulary.intersection(words_of(t)))
            df[b""] += 1
    yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in df], "df": list(df.values())})


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each template word stands, over the whole corpus, and the number of documents.

    At most one row per template word reaches the driver.
    """
    rows = id_text(docs).select("text").mapInArrow(_count_words, "word string, df long") \
        .groupBy("word").agg(F.sum("df").alias("df")).collect()
    df = {r["word"]: r["df"] for r in rows}
    return df, df.pop("", 0)


def _scan(df: dict[str, int], n_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(df, n_docs)
        for b in batches:
            rows = []
            for t in text_bytes(b.column(1)):
                words = words_of(t)
                places, base, labels, score = index.scan(words)
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None),
                             ",".join(sorted(base)), ",".join(sorted(labels)), score))
            if rows:
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (
                    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[
                    "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    return run


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: base places, base labels, all labels and the best template's score."""
    df, n_docs = document_frequencies(docs)
    return id_text(docs).mapInArrow(
        _scan(df, n_docs), "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                           "base_labels string, labels string, score double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
