"""Helpers shared by the operators: columns of the input, Arrow batches, texts as bytes."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, as a Java / RE2 class and as the characters themselves.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = "\t\n\x0b\x0c\r "


def visible_to_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (where it is not installed)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


#: Bytes of a batch of rows sent to a Python worker, about: rows are counted too, but a row may be long.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch; a batch is held several times on its way."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(str(spark.conf.get(name)).rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Return what this worker has freed to the system: workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` with null as the empty string; nothing else."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about ``size`` bytes; a longer text is a run of its own."""
    i, held = 0, 0
    for j, t in enumerate(texts):
        if held and held + len(t) > size:
            yield i, j
            i, held = j, 0
        held += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of each value (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0]+1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)
