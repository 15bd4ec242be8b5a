"""Tables of a ``foreachBatch`` sink under the number of their micro-batch in shared storage, so that a batch leaves its rows exactly once.

A batch is done once its last table is complete. One that comes again after it was done is skipped; one that was interrupted is written
anew over what it left. The numbers are those of the stream's checkpoint: a sink and its checkpoint belong together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Folders ``location``/number/name; ``last``: the name of the table that each batch writes last."""

    def __init__(self, spark: SparkSession, location: str, last: str):
        self.spark, self.location, self.last = spark, location.rstrip("/"), last
        root = spark._jvm.org.apache.hadoop.fs.Path(self.location)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        numbers = [int(n) for x in files.listStatus(root) if (n := x.getPath().getName()).isdigit()] if files.exists(root) else []
        self.done = sorted(n for n in numbers if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{n}/{last}/_SUCCESS")))

    def has(self, number: int) -> bool:
        return bool(self.done) and number <= self.done[-1]

    def write(self, df: DataFrame, number: int, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.location}/{number}/{name}")
        if name == self.last:
            self.done.append(number)

    def newest(self, name: str, schema: str) -> DataFrame:
        """The table of the last batch that is done; empty before the first."""
        return self._read(self.done[-1:], name, schema)

    def all(self, name: str, schema: str) -> DataFrame:
        """The tables of all batches that are done, together."""
        return self._read(self.done, name, schema)

    def _read(self, numbers: list[int], name: str, schema: str) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.location}/{n}/{name}" for n in numbers))
