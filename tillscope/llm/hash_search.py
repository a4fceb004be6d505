"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: projections learned on a bounded sample (iterative
quantisation: each turns the sample so that its signs lose least), ``BITS`` signs
in all. Rows and queries are first extended by one component that makes the
largest inner product the smallest angle. A code is split into substrings of 16
bits, each indexed in every block of rows. A query within Hamming radius r of a
code is, in at least one substring, within that substring's share of r (the
shares sum to r - substrings + 1: the pigeonhole principle). Probing each index
within its share so retrieves every code within r; the codes are compared, and
those within r are ranked by the float vectors' inner product in double
precision, summed component by component.

The radius is measured, not assumed: ``CALIBRATION`` queries are compared with
all rows exactly, and r is the Hamming distance that ``RECALL`` of their true
neighbours keep. A query with fewer than k codes within r is searched again with
the widest radius, which is exact. On vectors without any structure (equal
spread in all directions) no code tells near from far well: then the shares are
wide, the probing retrieves most codes and the comparison of codes does the
work; clustered vectors have small radii and few probes.

Equal vectors are indexed once, with the k + 1 smallest ids (a result never
needs more), so a vector that a third of the rows share is one entry.

Results for odd input: rows with a null id, or a vector that is null, empty,
zero, or holds null or non-finite components, take no part; rows equal in id and
vector count once, and rows of one id with other vectors are candidates; missing
components of shorter vectors are zero; ties go to the smaller id; fewer than k
candidates give all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm.grid import cells, matrix, usable
from tillscope.session import materialize

#: Bits of a code and of a substring; distinct vectors that the projections are fitted on, at most.
BITS, SUBSTRING, SAMPLE = 256, 16, 4096
#: Distinct query vectors that the radius is measured with, at most, and the share of true neighbours within it.
CALIBRATION, RECALL = 128, 0.98
#: Distinct vectors of a block of queries and of a block of rows; queries compared at once.
QUERY_BLOCK, ROW_BLOCK, AT_ONCE = 1024, 8192, 128
SHARED = BITS // SUBSTRING


@dataclass(frozen=True)
class Codes:
    """Projections (dimension + 1 rows, ``BITS`` columns) and the greatest norm of all rows."""
    projections: np.ndarray
    norm: float

    @property
    def dimension(self) -> int:
        return self.projections.shape[0] - 1

    def of(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """The codes as rows of 64-bit words."""
        signs = extended(vectors, self.norm, query) @ self.projections > 0
        return np.packbits(signs, axis=1).view(np.uint64)


def extended(vectors: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Unit vectors whose angles order as the inner products do: rows are filled up to ``norm``, queries by 0."""
    lengths = np.sqrt((vectors ** 2).sum(1))
    if query:
        return np.column_stack([vectors / lengths[:, None], np.zeros(len(vectors))])
    rest = np.sqrt(np.maximum(0, 1 - (lengths / norm) ** 2))
    return np.column_stack([vectors / norm, rest])


def fit(sample: np.ndarray, norm: float, bits: int = BITS, rounds: int = 12) -> Codes:
    """Orthonormal projections, each turned towards the signs of the sample (iterative quantisation)."""
    rows = extended(sample, norm, False)
    d, rng, parts = rows.shape[1], np.random.default_rng(0), []
    while sum(p.shape[1] for p in parts) < bits:
        turned = np.linalg.qr(rng.normal(size=(d, d)))[0][:, :bits - sum(p.shape[1] for p in parts)]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(rows.T @ np.sign(rows @ turned), full_matrices=False)
            turned = u @ v
        parts.append(turned)
    return Codes(np.hstack(parts), norm)


def shares(radius: int, substrings: int = SHARED) -> np.ndarray:
    """Each substring's radius; their sum is radius - substrings + 1, and -1 probes nothing."""
    total = max(radius - substrings + 1, -substrings)
    return total // substrings + (np.arange(substrings) < total % substrings)


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


class SubstringIndex:
    """The substring tables of a block's codes: distinct values, and the codes that have each."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = [np.unique(column, return_inverse=True) for column in codes.view(np.uint16).T]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) positions of every code within the radius."""
        hit = np.zeros((len(queries), len(self.codes)), bool)
        for (values, place), asked, share in zip(self.tables, queries.view(np.uint16).T, shares(radius).tolist()):
            if share < 0:
                continue
            distinct, which = np.unique(asked, return_inverse=True)
            probed = np.bitwise_count(distinct[:, None] ^ values) <= share
            hit |= probed[:, place][which]
        q, c = np.divmod(np.flatnonzero(hit), len(self.codes))
        near = _hamming(queries[q], self.codes[c]) <= radius
        return q[near], c[near]


def products(a: np.ndarray, b: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the pairs, summed in the order of the components (the same wherever it is done)."""
    total = np.zeros(len(q))
    for x, y in zip(a.T.copy(), b.T.copy()):
        total += x[q] * y[c]
    return total


FOUND = "qid long, vid long, score double, ids array<long>"


def _search(codes: Codes, radius: int, k: int):
    """The k + 1 best distinct vectors that each query of a cell finds."""
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        a, b = (matrix(t["v"], np.float64, codes.dimension) for t in (queries, rows))
        index = SubstringIndex(np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint64).reshape(len(b), -1))
        asked = codes.of(a, True)
        at, to, scores = [], [], []
        for i in range(0, len(a), AT_ONCE):
            q, c = index.within(asked[i:i + AT_ONCE], radius)
            score = products(a[i:i + AT_ONCE], b, q, c)
            order = np.lexsort((-score, q))
            q, c, score = q[order], c[order], score[order]
            # equal scores of the last place all stay: their ids decide later
            first = np.searchsorted(q, np.arange(min(AT_ONCE, len(a) - i) + 1))
            last = np.minimum(first[:-1] + k, first[1:] - 1)
            bar = np.where(first[:-1] < first[1:], score[np.maximum(last, 0)] if len(score) else 0, 0)
            keep = score >= bar[q]
            at.append(q[keep] + i)
            to.append(c[keep])
            scores.append(score[keep])
        at, to = np.concatenate(at), np.concatenate(to)
        return pa.table({"qid": queries["vid"].to_numpy()[at], "vid": rows["vid"].to_numpy()[to],
                         "score": np.concatenate(scores),
                         "ids": rows["ids"].combine_chunks().take(pa.array(to)).cast(pa.list_(pa.int64()))})
    return run


def _calibrate(codes: Codes, asked: np.ndarray, k: int):
    """Each batch's k + 1 best rows for the calibration queries, with their Hamming distances."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = codes.of(asked, True)
        for b in batches:
            rows = matrix(b.column(0), np.float64, codes.dimension)
            own = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(len(rows), -1)
            score = asked @ rows.T
            best = np.argsort(-score, axis=1)[:, :k + 1]
            q = np.repeat(np.arange(len(asked)), best.shape[1])
            c = best.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), pa.array(score[q, c]), pa.array(_hamming(words[q], own[c]))],
                names=["q", "score", "distance"])
    return run


def _encoded(codes: Codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = codes.of(matrix(b.column(1), np.float64, codes.dimension), False)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([w.tobytes() for w in words], pa.binary())], names=["vid", "v", "ids", "code"])
    return run


def _k_best(df: DataFrame, by: str, k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each group; the limit is applied before the shuffle too."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, radius: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query.

    ``vectors`` has ``id`` (long) and ``v`` (list of doubles, not zero); ``is_query`` picks the queries.
    ``radius`` overrides the measured one.
    """
    spark = vectors.sparkSession
    rows = materialize(vectors.select("id", "v").distinct(), "search-rows")
    asked = rows.where(is_query)
    norm, width, total = rows.agg(
        F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), F.max(F.size("v")), F.count("*")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], empty)

    # distinct vectors with their first ids; the sample is the distinct vectors with the least hashes
    distinct = materialize(_k_best(rows, "v", k + 1, "id").groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
                           .select(F.monotonically_increasing_id().alias("vid"), "v", "ids"), "search-vectors")

    def drawn(df: DataFrame, n: int) -> np.ndarray:
        table = df.select("v").orderBy(F.xxhash64("v"), "v").limit(n).toArrow()
        return matrix(table["v"], np.float64, width)

    codes = fit(drawn(distinct, SAMPLE), norm)
    index = materialize(distinct.mapInArrow(_encoded(codes), "vid long, v array<double>, ids array<long>, code binary"),
                        "search-index")
    query_ids = materialize(asked.join(index.select("vid", "v"), "v").select(F.col("id").alias("query_id"), "vid"),
                            "search-queries")
    queries = materialize(index.join(query_ids.select("vid").distinct(), "vid", "left_semi").select("vid", "v"),
                          "search-query-vectors")
    if radius is None:
        some = drawn(queries, CALIBRATION)
        if not len(some):
            return spark.createDataFrame([], empty)
        near = index.select("v", "code").mapInArrow(_calibrate(codes, some, k), "q long, score double, distance int")
        # one number of the bounded set of true neighbours
        radius = _k_best(near, "q", k + 1, F.desc("score")).agg(
            F.percentile("distance", F.lit(RECALL))).first()[0]
        radius = int(np.ceil(radius))

    def search(queries: DataFrame, radius: int) -> DataFrame:
        found = cells(queries, index, F.xxhash64("vid"), QUERY_BLOCK, ROW_BLOCK, _search(codes, radius, k), FOUND)
        return materialize(_k_best(found.withColumn("first", F.element_at("ids", 1)), "qid", k + 1, F.desc("score"), "first", "vid")
                           .select("qid", "vid", "score", "ids"), "search-found")

    found = search(queries, radius)
    want = min(k + 1, total)
    enough = found.groupBy("qid").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") >= want)
    short = materialize(queries.join(enough.select(F.col("qid").alias("vid")), "vid", "left_anti"), "search-short")
    if not short.isEmpty():
        # searched again as far as codes reach, in place of what they found
        found = found.join(short.select(F.col("vid").alias("qid")), "qid", "left_anti").unionByName(search(short, BITS))
    listed = found.select("qid", "vid", "score", F.explode("ids").alias("vec_id"))
    best = materialize(_k_best(listed, "qid", k + 1, F.desc("score"), "vec_id", "vid"), "search-best")

    # a query vector's list, without the row itself, for each of its ids
    lists = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("away"), "vec_id", "vid", "score"))).alias("list"))
    mine = query_ids.join(lists, query_ids["vid"] == lists["qid"])
    others = F.slice(F.filter("list", lambda x: ~((x["vid"] == F.col("qid")) & (x["vec_id"] == F.col("query_id")))), 1, k)
    return mine.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def searchable(emb: DataFrame) -> DataFrame:
    """id, v of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return emb.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.exists("v", lambda x: x != 0))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(searchable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("id") % 20 == 0)
