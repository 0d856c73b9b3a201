"""Shared steps of the vector operators: validity, exact duplicates, packed blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(v: Column) -> Column:
    """Whether a vector is not null, has only finite components and is not zero."""
    x = v.cast("array<double>")
    # Double.MaxValue bounds the finite numbers; NaN is larger than any number in Spark's order.
    return x.isNotNull() & F.coalesce(F.forall(x, lambda c: F.abs(c) <= F.lit(1.7976931348623157e308)), F.lit(False)) & F.exists(x, lambda c: c != 0)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long double arrays as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distinct_vectors(df: DataFrame, members: int) -> DataFrame:
    """vector, dim and the members smallest vec_ids of each different vector (as an array, rising)."""
    from pyspark.sql import Window as W

    order = W.partitionBy("vector").orderBy("vec_id")
    return (
        df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= members)
        .groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
