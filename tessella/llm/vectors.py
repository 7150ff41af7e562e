"""What the operators on embeddings share: which vectors take part, and their matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete(df: DataFrame, vec_col: str) -> DataFrame:
    """The rows of `df` whose vector isn't null, holds neither nulls nor non-finite numbers, and has the commonest length among those.

    Of two lengths that are equally common the smaller counts.
    """
    v = F.col(vec_col)
    fine = df.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))))
    common = fine.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), "size").first()
    return fine.where(F.size(v) == (common["size"] if common else 0))


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)
