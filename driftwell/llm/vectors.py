"""Vectors as (vec_id, vector): which take part, and their equal copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame) -> DataFrame:
    """vec_id, vector (array of double) and width (its components) of rows whose vector is not null or zero and holds no null,
    NaN or infinity.  Vectors of different widths are never compared.  Rows without vec_id take no part."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    found = df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    return found.where(F.coalesce(fine, F.lit(False))).withColumn("width", F.size("vector"))


def by_width(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of each width of a list column."""
    widths = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        yield batch if (widths == width).all() else batch.take(pa.array(np.flatnonzero(widths == width)))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Rows x components of an Arrow list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.empty((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, without overflow for very large or small components."""
    if not rows.size:
        return rows
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))
