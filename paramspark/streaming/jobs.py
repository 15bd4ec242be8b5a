"""Structured Streaming forms: running parameters, sketches by slot under a watermark, stateful model load, prequential learning, replay."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor

from ..operators.factorization import Factors, sgd_round
from ..plans.storage import materialize


def stream_parquet(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream with the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_sums(stream: DataFrame, *, id: str, delta) -> DataFrame:  # noqa: A002
    """Parameters (id, value) as a streaming aggregation; output mode ``update`` emits changes, ``complete`` all of them."""
    return stream.groupBy(F.col(id).alias("id")).agg(F.sum(delta).alias("value"))


def slotted_counts(stream: DataFrame, *, ts: str, key: str, hours: int, late: str = "1 hour") -> DataFrame:
    """(slot_start, key, n) by tumbling window; slots close and leave the state once the watermark passes."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", f"{hours} hours").alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("slot_start"), "key", "n")


def slotted_bloom(stream: DataFrame, *, ts: str, doc_id: str, word: str, num_bits: int, num_hashes: int, hours: int, late: str = "1 hour") -> DataFrame:
    """(slot_start, word, bits): Bloom sketches by tumbling window under a watermark."""
    from ..functions.hashing import family

    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    bits = timed.select("__ts", F.col(word).alias("word"), F.explode(F.transform(family(F.col(doc_id), num_hashes), lambda h: F.pmod(h, F.lit(num_bits)).cast("int"))).alias("bit"))
    return bits.groupBy(F.window("__ts", f"{hours} hours").alias("w"), "word").agg(F.array_sort(F.collect_set("bit")).alias("bits")).select(F.col("w.start").alias("slot_start"), "word", "bits")


class LoadedSums(StatefulProcessor):
    """Running sums by id that start from a loaded model: model rows come first, as the initial state."""

    def init(self, handle) -> None:
        self.value = handle.getValueState("value", "value bigint")

    def _add(self, more: int) -> int:
        now = (self.value.get()[0] if self.value.exists() else 0) + int(more)
        self.value.update((now,))
        return now

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        total = sum(int(r["delta"].sum()) for r in rows)
        yield pd.DataFrame({"id": [key[0]], "value": [self._add(total)]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self._add(initialState["value"].sum())

    def close(self) -> None:
        pass


def sums_from_model(stream: DataFrame, model: DataFrame) -> DataFrame:
    """(id, value) after each micro-batch for a stream (id, delta), starting from model rows (id, value)."""
    return stream.groupBy("id").transformWithStateInPandas(LoadedSums(), "id string, value bigint", "Update", "None", model.groupBy("id"))


class OnlineFactors:
    """A ``foreachBatch`` sink that learns each micro-batch of ratings; a batch that comes again after a failure is skipped. With a
    ``location`` (a shared folder), the factors after each batch are tables under the batch's number there, and a new sink goes on
    from the last one that is complete, so a restart learns no batch twice."""

    def __init__(self, factors: Factors, *, size: int, rate: float, loss: str = "squared", location: str | None = None):
        self.factors, self.size, self.rate, self.loss, self.last, self.location = factors, size, rate, loss, -1, location
        if location:
            spark = factors.users.sparkSession
            root = spark._jvm.org.apache.hadoop.fs.Path(location)
            files = root.getFileSystem(spark._jsc.hadoopConfiguration())
            done = lambda n, side: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{location}/{n}/{side}/_SUCCESS"))
            numbers = [int(x.getPath().getName()) for x in files.listStatus(root)] if files.exists(root) else []
            if whole := [n for n in numbers if done(n, "users") and done(n, "items")]:
                self.last = max(whole)
                self.factors = self._read(spark)

    def _read(self, spark: SparkSession) -> Factors:
        return Factors(*(spark.read.parquet(f"{self.location}/{self.last}/{side}") for side in ("users", "items")))

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        new = sgd_round(batch.select("user", "item", "rating"), self.factors, size=self.size, rate=self.rate, loss=self.loss)
        if self.location:
            new.users.write.mode("overwrite").parquet(f"{self.location}/{number}/users")
            new.items.write.mode("overwrite").parquet(f"{self.location}/{number}/items")
            self.last = number
            self.factors = self._read(batch.sparkSession)
        else:
            self.factors = Factors(materialize(new.users, "users"), materialize(new.items, "items"))
            self.last = number


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and returns its memory table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


class _ReplayReader(SimpleDataSourceStreamReader):
    """Serves lines ``ts,...`` in order of time: each read moves the clock by ``speed`` seconds of event time, and past ``until`` by all there is."""

    def __init__(self, options: dict):
        rows = sorted((int(x.split(",", 1)[0]), x) for x in self._lines(options) if x)
        self.rows, self.times, self.speed = rows, [t for t, _ in rows], int(options.get("speed", "3600"))
        self.until = int(options["until"]) if "until" in options else None

    @staticmethod
    def _lines(options: dict) -> list[str]:
        if "lines" in options:
            return options["lines"].split("\n")
        with open(options["path"], encoding="utf-8") as file:
            return file.read().split("\n")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"clock": self.times[0] if self.rows else 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end, last = start["clock"] + self.speed, self.times[-1] + 1 if self.rows else 0
        if self.until is not None and start["clock"] >= self.until:
            end = last
        end = max(start["clock"], min(end, last))
        return self.readBetweenOffsets(start, {"clock": end}), {"clock": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self.rows[bisect_left(self.times, start["clock"]) : bisect_left(self.times, end["clock"])])


class ReplaySource(DataSource):
    """Stream source ``replay``: event-time replay of the text lines of the file ``path`` (which the driver reads, as a replay of one clock must)
    or of the option ``lines``, at ``speed`` seconds a micro-batch until ``until``."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "ts bigint, value string"

    def simpleStreamReader(self, schema) -> _ReplayReader:  # noqa: N802
        return _ReplayReader(self.options)


def replayed(spark: SparkSession, path: str, *, speed: int = 3600, until: int | None = None, late: str = "0 seconds") -> DataFrame:
    """(ts, value, event_time) of a replayed file, with a watermark on the event time."""
    spark.dataSource.register(ReplaySource)
    reader = spark.readStream.format("replay").option("path", path).option("speed", str(speed))
    if until is not None:
        reader = reader.option("until", str(until))
    return reader.load().withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", late)
