"""Vector columns as numpy blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """True for a vector that is not null, not empty and has only finite components."""
    inf = float("inf")
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0)
                      & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(``vid`` long, ``vec`` array<double>) of the rows that take part."""
    return (table.select(F.col(id_col).cast("long").alias("vid"),
                         F.col(vec_col).cast("array<double>").alias("vec"))
            .where(F.col("vid").isNotNull() & finite(F.col("vec"))))


def matrix(column, dim: int) -> np.ndarray:
    """Arrow list column of equal lengths as a (rows, dim) double matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
