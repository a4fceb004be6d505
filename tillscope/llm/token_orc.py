"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on doc_id.

Documents are range-partitioned and sorted by ``doc_id``, encoded in place and
written as one ORC file per range (part numbers ascend with the ids). An ORC
reader splits the files by stripe, and prunes stripes and row groups by the
min/max indexes and Bloom filters of ``doc_id`` (``lookup``). Each row carries
its place within its file, so a document's global start needs only the token
totals of the files.

Results for odd input: a null text counts as empty (the end id alone); rows
with a null ``doc_id`` come first; equal ids follow one another in any order;
an empty table gives no rows; other columns are not written. ids are positive
32-bit integers. A text of any length is one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillscope.llm.common import blocks, give_back, id_text, text_bytes
from tillscope.llm.encode import ENCODED, encoder, word_bpe
from tillscope.session import fresh_path

END_ID = 1
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
#: ORC layout: stripes are the unit of parallel reads, row groups that of pruning.
LAYOUT = {"compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000",
          "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def _encode_rows(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, start, enc = TaskContext.get().partitionId(), 0, encoder(path, end_id)
        for b in batches:
            texts = text_bytes(b.column(1))
            for i, j in blocks(texts, ENCODED):
                ids, offsets = enc.encode(texts[i:j])
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)),
                     pa.array(start + offsets[:-1]), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))],
                    schema=schema)
                start += int(offsets[-1])
        give_back()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every whole text and write the ids to ``path`` in ascending ``doc_id`` order."""
    ordered = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_encode_rows(tokenizer, end_id), SCHEMA).write.options(**LAYOUT).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    rows = spark.read.schema(SCHEMA).orc(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(offsets), "part") \
        .select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents: the predicate prunes stripes and row groups by index and Bloom filter."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(list(doc_ids))).select("doc_id", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        offsets = lists.offsets.to_numpy()
        ids = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(ids[4 * i:4 * j]) for i, j in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows as read back."""
    return tokens.select("doc_id", "start", "n_tokens", "ids") \
        .mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-orc")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, word_bpe())
    return digests(read_tokens(spark, path))
