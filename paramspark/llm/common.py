"""Helpers shared by the training-data operators: hold-out buckets, shared storage, Arrow mapping."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import discard, materialize, shared_dir

__all__ = ["discard", "materialize", "shared_dir"]

#: Upper-case ASCII and what it becomes; the contracts lower-case A-Z only, never other letters.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ASCII_LOWER = str.maketrans(UPPER, LOWER)

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def held_out(doc_id: Column, modulus: int, remainder: int = 2) -> Column:
    """True for rows that no model may learn labels from; rows without an id are never held out."""
    return F.coalesce(id_bucket(doc_id, modulus) == remainder, F.lit(False))


def give_back() -> None:
    """Returns freed memory to the system: an idle Python worker, kept for the next task, else holds what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with freed memory given back at the task's end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema) -> DataFrame:
    """mapInArrow with state per task: ``make()`` runs once in each task and gives the function for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in slices(batch):
                if (out := each(part)) is not None:
                    yield out

    return df.mapInArrow(tidy(run), schema)


def rewrite_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """map_batches for functions that keep all columns of ``df``, whatever they are."""
    return map_batches(df, make, df.schema)


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy runs of rows of about ``most_bytes`` at most (a longer row comes alone), so that Python objects for long texts stay few."""
    if batch.nbytes <= most_bytes or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), most_bytes)
    yield from slices(batch.slice(half), most_bytes)


def record_batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)
