"""Skew helpers for plans that adaptive execution cannot split by itself.

With AQE on, Spark splits skewed sort-merge-join partitions at run time and
partial aggregation collapses hot grouping keys before the shuffle, so most
operators need nothing. ``salted_join`` is the explicit form for the cases
AQE does not cover (AQE off, a skewed key on a non-splittable side, a
stream-static join): the large side gets a deterministic salt derived from
the row, the small side is replicated once per salt value, and the join key
becomes (key, salt), so one hot key is spread over ``buckets`` tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(large: DataFrame, small: DataFrame, keys: str | Sequence[str], buckets: int = 16,
                how: str = "inner", salt_columns: Sequence[str] | None = None) -> DataFrame:
    """Equi-join ``large`` with ``small`` on ``keys`` with the hot keys of ``large``
    spread over ``buckets`` partitions. ``how`` is ``inner`` or ``left`` (the
    large side is the preserved one). The salt is a hash of ``salt_columns``
    (default: all columns of ``large``), so a retried task gets the same salt."""
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins (large side preserved)")
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = list(salt_columns or large.columns)
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cols]), F.lit(buckets)))
    replicated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return salted.join(replicated, keys + ["_salt"], how).drop("_salt")
