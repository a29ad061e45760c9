"""Integer vectors: what the exact operators on embeddings compute with."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components are scaled by it and rounded down.
SCALE = 256


def whole_numbers(vector: str, limit: int) -> Column:
    """floor(256 * x) of each component; null where the vector is, where a component is null or not finite, or
    where an integer would reach ``limit``, beyond which sums of products leave 64 bits."""
    v = F.col(vector)
    # NaN counts as larger than any number, so it fails the bound too.
    fits = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < limit / SCALE))
    return F.when(fits, F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("int")))


def matrix(column: pa.Array, dims: int, kind=np.int64) -> np.ndarray:
    """The rows of a list column, which are all of that length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), dims)
