"""nDCG of recommendations while they are made: by period of event time, and in total.

An event is (item, ts, recommended): what happened, when (seconds), and the items that were recommended before it, best first. ``gained`` looks the
item up in its list; there is no join. ``ndcg_periods`` is an aggregation by windows of ``period`` seconds under a watermark: a period comes out
once the watermark passes its end and then leaves the state; an event that comes later is late and is not counted. ``PrequentialTotals`` is a
``foreachBatch`` sink whose totals go on after a restart and count each micro-batch once.

Edge cases: an event without a list, with an empty one, or whose item is null or not in it, counts with a gain of 0; of repeats in a list the first
counts (the batch form takes lists without repeats); events without a time are left out of periods and counted in totals.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions

TOTALS = "n bigint, hits bigint, ndcg_sum double"


def gained(events: DataFrame) -> DataFrame:
    """Events with ``ndcg``: ln 2 / ln(1 + place of the item in its list), or 0."""
    place = F.coalesce(F.array_position("recommended", F.col("item")), F.lit(0))
    return events.withColumn("ndcg", F.when(place > 0, F.lit(math.log(2)) / F.ln(place + 1.0)).otherwise(0.0))


def ndcg_periods(events: DataFrame, *, period: int = 86_400, late: str = "0 seconds") -> DataFrame:
    """(period, n, hits, ndcg_sum, ndcg_avg) of closed periods, for output mode ``append``; numbers of periods are those of ``evaluation.ndcg_by_period``."""
    timed = gained(events.where("ts IS NOT NULL")).withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    found = timed.groupBy(F.window("at", f"{period} seconds").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("ndcg") > 0).alias("hits"), F.sum("ndcg").alias("s"))
    number = F.floor(F.unix_timestamp("w.start") / period).cast("long")
    return found.select(number.alias("period"), "n", "hits", F.round("s", 6).alias("ndcg_sum"), F.round(F.col("s") / F.col("n"), 6).alias("ndcg_avg"))


class PrequentialTotals:
    """Totals after each micro-batch of events, in shared storage under the batch's number."""

    def __init__(self, spark: SparkSession, location: str):
        self.versions = Versions(spark, location, "totals")

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self.versions.has(number):
            return
        now = gained(batch).agg(F.count("*").alias("n"), F.count_if(F.col("ndcg") > 0).alias("hits"), F.coalesce(F.sum("ndcg"), F.lit(0.0)).alias("ndcg_sum"))
        both = now.unionByName(self.versions.newest("totals", TOTALS)).agg(*(F.sum(c).alias(c) for c in ("n", "hits", "ndcg_sum")))
        self.versions.write(both, number, "totals")

    def totals(self) -> DataFrame:
        """(n, hits, ndcg_sum, ndcg_avg) so far; no row before the first batch."""
        return self.versions.newest("totals", TOTALS).select("n", "hits", F.round("ndcg_sum", 6).alias("ndcg_sum"), F.round(F.col("ndcg_sum") / F.col("n"), 6).alias("ndcg_avg"))


class Appended:
    """A sink that leaves the rows of each micro-batch once, as a table under its number."""

    def __init__(self, spark: SparkSession, location: str, schema: str):
        self.versions, self.schema = Versions(spark, location, "rows"), schema

    def __call__(self, batch: DataFrame, number: int) -> None:
        if not self.versions.has(number):
            self.versions.write(batch, number, "rows")

    def rows(self) -> DataFrame:
        return self.versions.all("rows", self.schema)


PERIODS = "period bigint, n bigint, hits bigint, ndcg_sum double, ndcg_avg double"


def measured(events: DataFrame, location: str, checkpoint: str, *, period: int = 86_400, late: str = "0 seconds") -> DataFrame:
    """Runs ``ndcg_periods`` over all that is there and returns the periods that have closed so far; goes on from an earlier run's folders."""
    sink = Appended(events.sparkSession, location, PERIODS)
    stream = ndcg_periods(events, period=period, late=late).writeStream.foreachBatch(sink).outputMode("append")
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sink.rows()
