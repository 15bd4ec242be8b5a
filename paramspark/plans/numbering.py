"""Consecutive numbers in a total order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

_ROW_BITS = 33  # of monotonically_increasing_id


def numbered(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 0 to n - 1 in the order ``by``, which should be total.

    Rows are dealt out by range and sorted where they are; only the counts by partition are summed up in order."""
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, "numbered")
    part = F.shiftright("__at", _ROW_BITS)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("__part", before.alias("__first"))  # a row for each partition
    inside = F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(firsts), "__part").withColumn(name, F.col("__first") + inside).drop("__part", "__first", "__at")
