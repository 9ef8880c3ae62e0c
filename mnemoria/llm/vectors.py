"""What the operators on embeddings share: usable rows, one row for an id, numbers of blocks, matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and no component is null, NaN or infinite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def usual_length(rows: DataFrame, vector: str) -> int | None:
    """The length of most vectors that are not empty, the smaller of two as frequent; None without any."""
    found = rows.groupBy(F.size(vector).alias("n")).count().filter("n > 0").orderBy(F.desc("count"), "n").first()
    return found["n"] if found else None


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The rows of an Arrow column of lists, all of that width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def block(id_col: str, n: int) -> Column:
    """One of n blocks, by the id."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)).cast("int")
