"""Hard-negative mining by a secondary-sort shuffle.

Pairs (anchor, row) are scored in blocks. What may matter of a block is packed
into keys (anchor, descending score, positive before negative, id); the keys are
repartitioned by anchor and sorted within partitions, and a streaming iterator
walks them: a positive opens a score window, the negatives that follow are given
to the open windows until each is full or left behind. The iterator holds a few
windows and no anchor's rows, so an anchor with any number of pairs streams.

Blocks reduce before the shuffle, without losing a result: a first pass keeps the
``POSITIVES`` best rows of the anchor's label in each block, and the sorted keys
settle the anchor's positives; a second pass, which knows the windows, keeps the
``NEGATIVES`` best rows of each window in each block. Scores are integer inner
products (missing components of a shorter list count as zero), exact at any
size; floors and scores beyond the range of a long count as its ends.

Results for odd input: rows with a null id, label or vector, or any null or
non-finite component take no part; rows equal in id, label and vector count once;
rows of one id that differ are rows of their own, and an anchor's own id is never
its partner; ties go by the smaller id; an empty vector scores 0 with all; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.grid import cells, matrix, usable
from tillscope.session import materialize

#: Rows of a block of anchors and of a block of rows.
ANCHOR_BLOCK, ROW_BLOCK = 1024, 2048
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 30, 90
LONG = np.iinfo(np.int64)
#: Bytes of a key: anchor, twin, score, kind, id.
KEY = np.dtype([("anchor", ">u8"), ("twin", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
FLIP = np.uint64(1 << 63)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two integer matrices, cut to the range of a long."""
    most = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < 2**53:  # every partial sum is exact in doubles
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    out = a.astype(object) @ b.astype(object).T
    return np.minimum(np.maximum(out, LONG.min), LONG.max).astype(np.int64)


def _scored(anchors: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """Scores of a cell, which rows have the anchor's label, which its id; the rows by ascending id."""
    rows = rows.sort_by("id")
    a, b = matrix(anchors["v"], np.int64), matrix(rows["v"], np.int64)
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    same = anchors["label"].to_numpy()[:, None] == rows["label"].to_numpy()[None]
    own = anchors["id"].to_numpy()[:, None] == rows["id"].to_numpy()[None]
    return exact_products(a, b), same, own, rows


def pack(anchor: np.ndarray, twin: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys that sort as bytes by anchor, descending score, kind and id."""
    key = np.empty(len(anchor), KEY)
    for name, x in (("anchor", anchor), ("twin", twin), ("id", ids)):
        key[name] = x.astype(np.int64).view(np.uint64) ^ FLIP
    key["score"] = ~(score.astype(np.int64).view(np.uint64) ^ FLIP)
    key["kind"] = kind
    offsets = pa.array(np.arange(len(key) + 1, dtype=np.int32) * KEY.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(key), [None, offsets.buffers()[1], pa.py_buffer(key.tobytes())])


def unpack(keys: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor, twin, score, kind, id) of each key."""
    key = np.frombuffer(b"".join(keys.to_pylist()), KEY)
    long = lambda name, x: (x.astype(np.uint64) ^ FLIP).view(np.int64).tolist()
    return zip(long("anchor", key["anchor"]), long("twin", key["twin"]), long("score", ~key["score"].astype(np.uint64)),
               key["kind"].tolist(), long("id", key["id"]))


KEYED = "anchor long, twin long, key binary"


def _keys(anchors: pa.Table, rows: pa.Table, at: np.ndarray, to: np.ndarray, score: np.ndarray, kind: int) -> pa.Table:
    anchor, twin = (anchors[c].to_numpy()[at] for c in ("id", "twin"))
    return pa.table({"anchor": anchor, "twin": twin,
                     "key": pack(anchor, twin, score, kind, rows["id"].to_numpy()[to])})


def _best_positives(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        score, same, own, rows = _scored(anchors, rows)
        valid = same & ~own
        at, to = [], []
        line = np.arange(len(score))
        left = np.where(valid, score, LONG.min)
        for _ in range(min(k, score.shape[1])):
            best = left.argmax(1)  # of equal scores the smallest id
            ok = valid[line, best]
            # the least long is a score too: it is looked for among the valid ones
            for i in np.flatnonzero(~ok & valid.any(1)).tolist():
                best[i] = int(valid[i].argmax())
            ok = valid[line, best]
            at.append(line[ok])
            to.append(best[ok])
            valid[line[ok], best[ok]] = False
            left[line, best] = LONG.min
        at, to = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (at, to))
        return _keys(anchors, rows, at, to, score[at, to], 0)
    return run


def window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score of a positive's negatives, without leaving the range of a long."""
    tens, rest = positive // 100, positive % 100
    return LOW * tens + -(-LOW * rest // 100), HIGH * tens + HIGH * rest // 100


def _window_negatives(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        score, same, own, rows = _scored(anchors, rows)
        valid = ~same & ~own
        order = np.argsort(np.where(valid, ~score, LONG.max), axis=1, kind="stable")  # descending scores, ascending ids
        ranked, ok = np.take_along_axis(score, order, 1), np.take_along_axis(valid, order, 1)
        keep = np.zeros(score.shape, bool)
        scores = anchors["positives"].to_pylist()
        for j in range(max(map(len, scores), default=0)):
            line = np.array([i for i, s in enumerate(scores) if j < len(s)], np.int64)
            low, high = window(np.array([scores[i][j] for i in line], np.int64))
            first = (ok[line] & (ranked[line] > high[:, None])).sum(1)
            to = first[:, None] + np.arange(k)
            inside = to < score.shape[1]
            to = np.minimum(to, score.shape[1] - 1)
            inside &= ok[line[:, None], to] & (ranked[line[:, None], to] >= low[:, None])
            keep[np.broadcast_to(line[:, None], to.shape)[inside], to[inside]] = True
        at, to = np.nonzero(keep)
        return _keys(anchors, rows, at, order[at, to], ranked[at, to], 1)
    return run


def secondary_sort(keyed: DataFrame) -> DataFrame:
    """The keys of an anchor in one partition, in the order of their bytes."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "anchor", "twin").sortWithinPartitions("key").select("key")


def _first_positives(k: int):
    """The first k keys of each anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = None, 0
        for b in batches:
            out = []
            for anchor, twin, score, _, to in unpack(b.column(0)):
                if (anchor, twin) != now:
                    now, taken = (anchor, twin), 0
                if taken < k:
                    out.append((anchor, twin, score, to))
                    taken += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 4,
                                             names=["anchor", "twin", "score", "positive"])
    return run


def _windows(k: int):
    """Walks sorted keys: positives open windows, negatives go to the open ones."""
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()),
                        ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened = None, []
        for b in batches:
            out = []
            for anchor, twin, score, kind, to in unpack(b.column(0)):
                if (anchor, twin) != now:
                    now, opened = (anchor, twin), []
                if kind == 0:
                    low, high = window(np.array([score], np.int64))
                    opened.append([int(low[0]), int(high[0]), to, score, 0])
                    continue
                shut = False
                for w in opened:
                    if score < w[0] or w[4] == k:
                        shut = True
                    elif score <= w[1]:
                        w[4] += 1
                        out.append((anchor, w[2], w[4], to, w[3], score))
                if shut:
                    opened = [w for w in opened if score >= w[0] and w[4] < k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, schema)], schema=schema)
    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES,
                   negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has ``id``, ``label`` (longs) and ``v`` (list of longs); ``is_anchor`` picks the anchors.
    """
    rows = materialize(rows.select("id", "label", "v").distinct(), "negatives-rows")
    anchors = materialize(rows.where(is_anchor).withColumn("twin", F.xxhash64("label", "v")), "negatives-anchors")
    spread = F.xxhash64("id", "label", "v")

    near = cells(anchors, rows, spread, ANCHOR_BLOCK, ROW_BLOCK, _best_positives(positives), KEYED)
    found = materialize(secondary_sort(near).mapInArrow(
        _first_positives(positives), "anchor long, twin long, score long, positive long"), "negatives-positives")

    # at most ``positives`` scores an anchor
    scores = found.groupBy(F.col("anchor").alias("id"), "twin").agg(F.collect_set("score").alias("positives"))
    with_windows = materialize(anchors.join(scores, ["id", "twin"]), "negatives-windows")
    far = cells(with_windows, rows, spread, ANCHOR_BLOCK, ROW_BLOCK, _window_negatives(negatives), KEYED)
    opening = found.mapInArrow(_opening, KEYED)
    return secondary_sort(far.unionByName(opening)).mapInArrow(
        _windows(negatives), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
                             "negative_score long")


def _opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        anchor, twin, score, positive = (c.to_numpy() for c in b.columns)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pack(anchor, twin, score, 0, positive)],
                                         names=["anchor", "twin", "key"])


def quantised(emb: DataFrame) -> DataFrame:
    """id, label, v of the rows that take part: shifted labels of every seventh id, components floor(256 x)."""
    id_, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    taking = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    # floor of a double is a long, at the ends of its range beyond them
    return emb.where(taking).select(
        id_.alias("id"), F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("id") % 100 == 0)
