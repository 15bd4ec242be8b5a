"""Vector functions over array columns, and their numpy forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class NotANumberError(ArithmeticError):
    """A vector sum met a NaN."""


def dot(a: Column, b: Column, size: int | None = None) -> Column:
    """Scalar product; with a known ``size`` an unrolled sum, which compiles, else a fold."""
    if size is not None:
        total = F.get(a, F.lit(0)) * F.get(b, F.lit(0))
        for i in range(1, size):
            total = total + F.get(a, F.lit(i)) * F.get(b, F.lit(i))
        return total
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def length_sqr(a: Column, size: int | None = None) -> Column:
    return dot(a, a, size)


def add(a: Column, b: Column) -> Column:
    """Sum of two vectors; raises on NaN."""
    total = F.zip_with(a, b, lambda x, y: x + y)
    return F.when(F.exists(total, F.isnan), F.raise_error(F.lit("NaN in a vector sum"))).otherwise(total)


def attach_length(a: Column) -> Column:
    """(len, vec)."""
    return F.struct(F.sqrt(length_sqr(a)).alias("len"), a.alias("vec"))


def sum_vectors(column: str, size: int) -> Column:
    """Aggregate: element-wise sum of an array column of known size."""
    return F.array(*(F.sum(F.get(F.col(column), F.lit(i))) for i in range(size)))


def np_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a + b
    if np.isnan(total).any():
        raise NotANumberError("NaN in a vector sum")
    return total


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")
