"""Vectors of whole numbers from tables of real ones, shared by the operators that count exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MOST = 1 << 30  # largest size of a whole component; products and sums of squares stay exact


def finite(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    plain = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(plain, F.lit(False))


def whole_vectors(table: DataFrame, column: str, scale: int, name: str = "x") -> DataFrame:
    """The rows with finite vectors, with ``name``: floor(scale * component) as an array of int.

    Vectors of unequal length are filled up with zeros to the longest. A component beyond ``MOST`` after scaling fails.
    """
    floors = F.transform(column, lambda c: F.floor(c.cast("double") * scale))
    fits = F.forall(floors, lambda c: F.abs(c) <= MOST)
    whole = F.when(fits, floors.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a scaled component exceeds {MOST}")))
    kept = table.filter(finite(F.col(column))).withColumn(name, whole)
    sizes = kept.agg(F.min(F.size(name)).alias("least"), F.max(F.size(name)).alias("most")).first()
    if sizes["least"] == sizes["most"]:
        return kept
    return kept.withColumn(name, F.concat(name, F.array_repeat(F.lit(0), F.lit(sizes["most"]) - F.size(name))))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
