"""What the operators on vectors share: which rows take part, and integers made of their components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored


def finite(vector: str) -> Column:
    """The vector is there and all of its components are finite numbers."""
    v = F.col(vector).cast("array<double>")
    return F.col(vector).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def integers(vectors: DataFrame, keep: list[Column], vector: str, scale: int, plus: int, below: int, multiple: int = 1) -> DataFrame:
    """``keep`` and x, the components as floor(scale * c) + plus, of the finite vectors of the usual length; written once.

    The usual length is the most frequent one above zero that is a multiple of ``multiple``, the least of equally frequent
    ones. Vectors of another length, or with a component of ``below`` or more in size, take no part.
    """
    v = F.col(vector).cast("array<double>")
    rows = vectors.where(finite(vector)).where(~F.exists(v, lambda c: F.abs(c) >= below)).select(*keep, F.transform(v, lambda c: F.floor(c * scale) + plus).alias("x"))
    sizes = rows.select(F.size("x").alias("n")).where((F.col("n") > 0) & (F.col("n") % multiple == 0)).groupBy("n").agg(F.count("*").alias("rows"))
    usual = sizes.orderBy(F.desc("rows"), "n").first()
    return stored(rows.where(F.size("x") == (usual.n if usual else -1)), "integers")


def matrix(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    """A list column, all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(len(column), -1 if len(column) else 1)


def summed(partial: DataFrame, kind: str) -> dict[int, float | int]:
    """Sums over the tasks of (at, value): a number for each place, of which there are as many as in one task."""
    return {r["at"]: r["total"] for r in partial.groupBy("at").agg(F.sum(F.col("value").cast(kind)).alias("total")).collect()}
