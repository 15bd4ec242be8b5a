"""Dataflow helpers: a map that knows the end of its input, and a delayed start."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def flat_map_with_end(df: DataFrame, make: Callable[[], Any], schema: str, *, key: str | None = None, parts: int | None = None) -> DataFrame:
    """Each partition feeds its rows to one ``make()`` object: ``on_row(row) -> outputs``, then ``on_end() -> outputs`` once, rows or none.

    ``key`` deals rows out by a column first, so that equal keys share an object."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = make()
        for rows in batches:
            yield pd.DataFrame([x for row in rows.itertuples(index=False) for x in worker.on_row(row)], columns=names)
        yield pd.DataFrame(list(worker.on_end()), columns=names)

    dealt = df.repartition(parts, key) if key and parts else df.repartition(key) if key else df.repartition(parts) if parts else df
    return dealt.mapInPandas(run, schema)


def delayed(df: DataFrame, seconds: float) -> DataFrame:
    """Each partition waits before its first row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        time.sleep(seconds)
        yield from batches

    return df.mapInPandas(run, df.schema)
