"""Integer forms of vector columns and the number types in which their sums and products are exact."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = (1 << 63) - 1


def whole(column: str, scale: int, offset: int = 0) -> Column:
    """floor(scale * x) + offset of every component as long; null where the vector is null or holds null or non-finite components.

    Components outside of 62 bits are held at plus or minus 2**62.
    """
    edge = F.lit(1 << 62)
    x = F.transform(column, lambda v: v.cast("double"))
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.col(column).isNotNull() & F.coalesce(usable, F.lit(False)),
                  F.transform(x, lambda v: F.greatest(F.least(F.floor(v * scale), edge), -edge) + F.lit(offset).cast("long")))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """Lists of `width` longs each as the rows of a matrix."""
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


def exact_type(limit: int) -> type:
    """The fastest type that holds all whole numbers up to `limit`: double, long, or Python's own."""
    return np.float64 if limit < 1 << 52 else np.int64 if limit < 1 << 62 else object
