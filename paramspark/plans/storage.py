"""Shared storage for iterated plans: cuts lineage by a table in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_A_FILE = 250_000
#: Folders of tables written and not deleted yet.
_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a folder of our own if all runs on this machine, else an error: executors elsewhere
    could not see it."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame, name: str, rows: int | None = None, by: str | None = None) -> DataFrame:
    """Writes ``df`` once and reads it back; survives lost executors, unlike a local checkpoint. ``rows``: about how many there are at most, of
    a few bytes each; a small table is then a few files, however many partitions a shuffle has. ``by``: the last column, whose values are folders, so
    that a filter on it reads no other rows."""
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_clean)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._shared_path = path
    _written.add(path)
    return found


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in shared storage; it goes with the tables of ``materialize``."""
    if not _written:
        atexit.register(_clean)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def written_text(lines: DataFrame, name: str) -> str:
    """The folder in shared storage that the lines (column ``value``) are written to; it goes with the tables of ``materialize``."""
    path = folder(lines.sparkSession, name)
    lines.write.text(path)
    return path


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that no later plan reads. Others are left alone."""
    for table in tables:
        path = getattr(table, "_shared_path", None)
        if path in _written:
            _written.remove(path)
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_written) if spark else []:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            break
