"""Keyed parameters: push-only transforms, model load, partitioners, exact folds of user logic.

A push is a row (id, delta). Where the update is a sum, min, max or last value, a push-only transform is one grouped aggregation
(``emit='final'``) or one running window (``emit='every'``): no loop. Anything else is a fold of each id's pushes in order by user
logic, run once for each id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize

AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}


def push(data: DataFrame, *, id: str, delta: str | Column, order: str | None = None, update: str = "sum", init: Column | None = None, emit: str = "final") -> DataFrame:  # noqa: A002
    """Parameters (id, value) after all pushes, or after every push (with ``order``). ``init``: what an unseen id starts from, by its column ``id``."""
    rows = data.select(F.col(id).alias("id"), (F.col(delta) if isinstance(delta, str) else delta).alias("delta"), *([F.col(order).alias("seq")] if order else []))
    total = AGGREGATES[update]
    start = (lambda v: v) if init is None else {"sum": lambda v: v + init, "min": lambda v: F.least(v, init), "max": lambda v: F.greatest(v, init)}[update]
    if emit == "final":
        return rows.groupBy("id").agg(total("delta").alias("value")).withColumn("value", start(F.col("value")))
    if order is None:
        raise ValueError("emitting at every push needs an order")
    return _running(rows, update).select("seq", "id", start(F.col("value")).alias("value"))


def _running(rows: DataFrame, update: str) -> DataFrame:
    """(seq, id, value) after each push. Rows are dealt out by ranges of (id, seq), so a hot id is many ranges: what a range does to an id
    is one row, and these few rows are summed up in order."""
    total, merge = AGGREGATES[update], {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}[update]
    placed = materialize(rows.repartitionByRange("id", "seq").withColumn("__part", F.spark_partition_id()), "pushes")
    inside = Window.partitionBy("__part", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy("__part", "id").agg(total("delta").alias("v"))
    ends = ends.select(F.col("__part").alias("__p"), F.col("id").alias("__id"), total("v").over(before).alias("__before"))
    here = placed.withColumn("__now", total("delta").over(inside))
    met = here.join(ends, (F.col("__part") == F.col("__p")) & F.col("id").eqNullSafe(F.col("__id")))
    return met.select("seq", "id", F.when(F.col("__before").isNull(), F.col("__now")).when(F.col("__now").isNull(), F.col("__before")).otherwise(merge(F.col("__before"), F.col("__now"))).alias("value"))


def push_loose(data: DataFrame, *, id: str, delta: Column, order: str, init: Column, on_first_push: str = "init_then_update") -> DataFrame:  # noqa: A002
    """Sums whose value type differs from the delta's. The first push of an id gives ``init`` updated by it, ``init`` alone, or the delta alone."""
    rows = data.select(F.col(id).alias("id"), delta.alias("delta"), F.col(order).alias("seq"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("seq")) == 1
    counted = rows.withColumn("first", first)
    value = {"init_then_update": init + F.sum("delta"), "init": init + F.sum(F.when(~F.col("first"), F.col("delta")).otherwise(0)), "delta": F.sum("delta")}[on_first_push]
    return counted.groupBy("id").agg(value.alias("value"))


def load_model(model: DataFrame, pushes: DataFrame, update: str = "sum") -> DataFrame:
    """Model rows (id, value) enter as pushes before the data's pushes (id, delta); repeated ids merge by the update."""
    rows = model.select("id", F.col("value").alias("delta")).unionByName(pushes.select("id", "delta"))
    return rows.groupBy("id").agg(AGGREGATES[update]("delta").alias("value"))


def pull(data: DataFrame, params: DataFrame, on: str, init: Column) -> DataFrame:
    """Data rows with the ``value`` of their parameter; ids without one get ``init``."""
    return data.join(params.select(F.col("id").alias(on), "value"), on, "left").withColumn("value", F.coalesce("value", init))


def touched(pulls: DataFrame, params: DataFrame, init: Column) -> DataFrame:
    """At close, parameters that were only pulled come out too, with their initial value."""
    return params.unionByName(pulls.select("id").distinct().join(params, "id", "left_anti").withColumn("value", init))


def hash_partition(df: DataFrame, id: str, parts: int) -> DataFrame:  # noqa: A002
    return df.repartition(parts, id)


def hash_owner(id: Column, parts: int) -> Column:  # noqa: A002
    """Owner of a hashed id; never negative."""
    return F.pmod(id, F.lit(parts))


def range_owner(id: Column, features: int, parts: int) -> Column:  # noqa: A002
    """Owner of an integer id under equal ranges of ``features`` ids: 0 to ``parts`` - 1. Ids from ``features`` on are the last owner's."""
    return F.least(F.floor(F.abs(id) / math.ceil(features / parts)), F.lit(parts - 1)).cast("int")


def range_partition(df: DataFrame, id: str, features: int, parts: int) -> DataFrame:  # noqa: A002
    return df.repartitionByRange(parts, range_owner(F.col(id), features, parts))


def transform(data: DataFrame, *, id: str, order: str, logic: Callable[[], Any], output: str) -> DataFrame:  # noqa: A002
    """User logic for each id, exactly in order: ``on_push(id, row) -> outputs`` and ``close(id) -> outputs``, one object an id.

    Ids are independent, so they run in parallel; the rows of one id pass through one task in order, a batch at a time, so that Python holds
    the object and a batch, however many rows an id has. Spark sorts them, on disk where they are many."""
    names = [part.split()[0] for part in output.split(", ")]

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        server = logic()
        for rows in batches:
            yield pd.DataFrame([x for row in rows.itertuples(index=False) for x in server.on_push(key[0], row)], columns=names)
        yield pd.DataFrame(list(server.close(key[0])), columns=names)

    # groups of rows that are dealt out and sorted by the id already are neither dealt out nor sorted again
    placed = data.repartition(id).sortWithinPartitions(F.col(id), F.col(order).asc_nulls_last())
    return placed.groupBy(id).applyInPandas(fold, output)
