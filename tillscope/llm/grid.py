"""A stated set of queries against all rows, in blocks: every block of queries meets every block of rows once.

Both tables are cut into blocks of a bounded size by a hash of their content.
A cell (one block of each) is one call of a function on two Arrow tables, so a
task holds two blocks at a time whatever the tables' sizes. A row is sent once
for each block of queries and a query once for each block of rows. Pairs are
never rows of a join: a cell returns what it keeps of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blocks(df: DataFrame, size: int) -> int:
    return max(1, -(-df.count() // size))


def cells(queries: DataFrame, rows: DataFrame, by: str | Column, query_block: int, row_block: int,
          run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run(block of queries, block of rows)`` for every pair of blocks.

    ``by`` spreads the rows of both tables over the blocks: a column (or an
    expression over columns that both have) in which no value holds many rows.
    Both tables should be written ones, as they are counted first.
    """
    by = F.col(by) if isinstance(by, str) else by
    nq, nr = _blocks(queries, query_block), _blocks(rows, row_block)
    spark = queries.sparkSession
    tasks = min(nq * nr, max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                             2 * spark.sparkContext.defaultParallelism))

    def dealt(df: DataFrame, own: str, n: int, other: str, others: int) -> DataFrame:
        at = F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
        return df.withColumn(own, at).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))) \
            .repartition(tasks, "_qb", "_rb").groupBy("_qb", "_rb")

    return dealt(queries, "_qb", nq, "_rb", nr).cogroup(dealt(rows, "_rb", nr, "_qb", nq)).applyInArrow(run, schema)


def matrix(column: pa.ChunkedArray | pa.Array, dtype, width: int = 0) -> np.ndarray:
    """The lists of a column as the rows of a matrix; shorter lists are filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    lengths = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    width = max([width, *np.unique(lengths).tolist()])
    if len(flat) == len(lists) * width:
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def usable(vector: Column) -> Column:
    """True for a list without null and non-finite components; false for a null one."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~odd, F.lit(False))
