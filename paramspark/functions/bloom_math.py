"""Cardinality estimates of Bloom bit sets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimate(bits: int, hashes: int, ones: int) -> float:
    """Estimated members of a set with ``ones`` of ``bits`` set; infinite if all are."""
    return math.inf if ones >= bits else -bits / hashes * math.log(1 - ones / bits)


def union_estimate(bits: int, hashes: int, a: set[int], b: set[int]) -> float:
    return estimate(bits, hashes, len(a | b))


def estimate_column(bits: int, hashes: int, ones: Column) -> Column:
    """``estimate`` for a column; the guard keeps ln(0) from being null."""
    return F.when(ones >= bits, F.lit(math.inf)).otherwise(F.lit(-bits / hashes) * F.ln(F.lit(1.0) - ones / F.lit(float(bits))))


def common_estimate(bits: int, hashes: int, a: Column, b: Column) -> Column:
    """Estimated size of the intersection of two bit arrays."""
    e = lambda x: estimate_column(bits, hashes, F.size(x))
    return e(a) + e(b) - e(F.array_union(a, b))
