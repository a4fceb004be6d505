"""Exact deduplication against immutable snapshots screened by binary-fuse filters.

A snapshot is a set of texts taken in earlier. Its distinct digests are cut
into buckets, and each bucket gets one static filter (``fuse``). An incoming
batch is reduced to its distinct digests (new-batch duplicates are grouped
there), which meet their bucket's filter; a negative is certainly new and goes
no further. Positives join the exact buckets by the whole digest, and the texts
of a pair that meets are compared byte for byte before the groups are merged.

Texts are equal when identical after each run of white space is made one space
(SHA-256 of the UTF-8). The row with the smallest ``doc_id`` stays; of repeated
rows of one id exactly one stays.

Results for odd input: a null text counts as empty, and empty texts are equal;
rows with a null ``doc_id`` stay only if their text has no row with an id;
an empty table gives no rows; other columns are ignored by ``exact_dedup`` and
kept by ``drop_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import fuse
from tillscope.llm.common import SPACE_CLASS, free_name, id_text
from tillscope.session import materialize

#: Keys of one filter, about; and buckets at least, so that the work spreads on small input too.
BUCKET_KEYS = 50_000
LEAST_BUCKETS = 64

FILTER_SCHEMA = "bucket int, seed int, segment int, starts int, cells binary"


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_CLASS + "+", " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normal_text(text).cast("binary"), 256))


def _key(digest: Column) -> Column:
    """The first 8 bytes of a digest as a long."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


def _groups(rows: DataFrame) -> DataFrame:
    """Distinct digests with the row that stays and the number of rows."""
    first = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")
    return rows.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One filter row per bucket of a snapshot's distinct digests."""
    def build(key, group: pd.DataFrame) -> pd.DataFrame:
        seed, segment, starts, cells = fuse.build(group["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"bucket": [key[0]], "seed": [seed], "segment": [segment], "starts": [starts],
                             "cells": [cells]})

    keyed = snapshot.select(_bucket(F.col("digest"), buckets).alias("bucket"), _key(F.col("digest")).alias("key"))
    return keyed.groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests of ``batch`` that a snapshot's filters let through."""
    def probe(group: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(group):
            return group.iloc[:0][["digest"]]
        f = found.iloc[0]
        hit = fuse.contains(group["key"].to_numpy().view(np.uint64), int(f.seed), int(f.segment), int(f.starts),
                            f.cells)
        return group.loc[hit, ["digest"]]

    keyed = batch.select("digest", _bucket(F.col("digest"), buckets).alias("bucket"),
                         _key(F.col("digest")).alias("key"))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "digest binary")


def same_bytes(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` (digest, first, other) whose two rows' normalised texts are identical byte for byte."""
    ids = pairs.select("digest", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("first.doc_id").alias("doc_id")),
        F.struct(F.lit(1).alias("side"), F.col("other.doc_id").alias("doc_id")))).alias("x")) \
        .select("digest", "x.side", F.col("x.doc_id").alias("wanted"))
    # a merge join at every size: the wanted ids grow with the corpus
    texts = id_text(docs).join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("wanted"))) \
        .where(text_digest(F.col("text")) == F.col("digest")) \
        .select("digest", "side", normal_text(F.col("text")).cast("binary").alias("bytes"))
    equal = texts.groupBy("digest").agg(
        F.min("bytes").alias("low"), F.max("bytes").alias("high"), F.countDistinct("side").alias("sides"))
    return pairs.join(equal.where("low = high AND sides = 2").select("digest"), "digest", "left_semi")


def exact_dedup(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """One row per document: keep_id, group_size, kept, text_sha256 and from_snapshot.

    ``in_snapshot`` says which rows are the immutable snapshot (null: batch).
    """
    rows = materialize(id_text(docs).select(
        "doc_id", text_digest(F.col("text")).alias("digest"),
        F.coalesce(in_snapshot, F.lit(False)).alias("old"), F.monotonically_increasing_id().alias("rid")),
        "dedup-digests")
    old = materialize(_groups(rows.where("old")), "dedup-snapshot")
    new = materialize(_groups(rows.where("NOT old")), "dedup-batch")
    buckets = max(LEAST_BUCKETS, -(-old.count() // BUCKET_KEYS))
    filters = materialize(build_filters(old, buckets), "dedup-filters")

    positive = screen(new, filters, buckets)
    pairs = materialize(positive.join(old, "digest").select("digest", "first", "n")
                        .join(new.select("digest", F.col("first").alias("other"), F.col("n").alias("other_n")),
                              "digest"), "dedup-positives")
    merged = same_bytes(pairs, docs).select(
        "digest", F.least("first", "other").alias("all_first"), (F.col("n") + F.col("other_n")).alias("all_n"))
    groups = materialize(old.withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))
                         .join(materialize(merged, "dedup-merged"), "digest", "left")
                         .select("digest", "old", F.coalesce("all_first", "first").alias("first"),
                                 F.coalesce("all_n", "n").alias("n")), "dedup-groups")
    # a plain join of two written tables: a group with very many rows is split by adaptive execution
    return rows.join(groups, ["digest", "old"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("rid") == F.col("first.rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("old").alias("from_snapshot"))


def older_half(docs: DataFrame) -> Column:
    """The condition that a row's id lies in the lower half of the ids' range: what was taken in first."""
    ends = docs.agg(F.min(F.col("doc_id").cast("long")).alias("a"), F.max(F.col("doc_id").cast("long")).alias("z")).first()
    return F.col("doc_id") <= F.lit(None if ends["a"] is None else (ends["a"] + ends["z"]) // 2)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with every column of the input.

    Rows go by their id. An id that has both rows that stay and rows that go (a
    repeated row) is settled apart, by id and text.
    """
    decided = exact_dedup(docs, older_half(docs))
    ids = materialize(decided.groupBy("doc_id").agg(
        F.max("kept").alias("some"), F.min("kept").alias("every")).where("NOT every"), "dedup-gone")
    wanted, digest, name = (free_name(docs, c) for c in ("_wanted", "_digest", "_name"))
    same_id = docs["doc_id"].eqNullSafe(F.col(wanted))
    rest = docs.join(ids.select(F.col("doc_id").alias(wanted)), same_id, "left_anti")
    mixed = ids.where("some").select(F.col("doc_id").alias(wanted))
    if mixed.isEmpty():
        return rest
    stay = decided.where("kept").join(mixed, F.col("doc_id").eqNullSafe(F.col(wanted)), "left_semi") \
        .select(F.col("doc_id").alias(wanted), F.col("text_sha256").alias(name))
    again = docs.withColumn(digest, F.lower(F.hex(text_digest(F.col("text"))))) \
        .join(stay, same_id & (F.col(digest) == F.col(name)), "left_semi")
    once = again.dropDuplicates(["doc_id", digest])
    return rest.unionByName(once.drop(digest))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, older_half(docs))
