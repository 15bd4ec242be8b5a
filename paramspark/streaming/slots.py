"""Tug-of-war sketches by time slot as a stream, and the answers to a stream of queries once a slot closes.

``slotted_tow`` is one aggregation by (slot, word) under a watermark: a slot's sketches leave the state, and come out, in the micro-batch in which the
watermark passes the slot's end. Queries are a stream too, (time, word): a query asks for the words that share documents with its own in the slot
of its time. They are united with the documents before the aggregation, where a query meets its word's sketch in the group that both
belong to; so there is no join of two streams, whose state would hold each slot twice. Each side has a watermark of its own, and a slot
closes when both have passed it.

``SlotAnswers`` is the ``foreachBatch`` sink of that stream. All words of a slot come in one micro-batch, and are searched by the bounded search of
``operators.sketches``; answers are in shared storage under the batch's number, exactly once whatever restarts.

Slots are whole windows of ``hours`` from ``start`` (negative before it; the batch form rounds towards zero instead and so puts the window before the
start into slot 0). Edge cases: rows without a time, and words that are null, are left out; a word that repeats in a document counts again;
rows of a slot that has closed are late and are dropped; repeated queries are one; a query whose word its slot lacks has no answer; a slot
that the watermark has not passed has none yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import family, pack_bits
from ..operators import sketches as S
from ..plans.storage import discard, materialize
from .versions import Versions

ANSWER = "query string, slot int, rank int, word string, score double"


def slotted_tow(docs: DataFrame, queries: DataFrame | None = None, *, num_hashes: int, hours: int, start: int = 0, late: str = "1 hour", hashes: str = "portable") -> DataFrame:
    """(slot, word, sums, asked) of closed slots from streams of documents (ts: seconds, doc_id, words) and queries (ts, word), for output mode ``append``.
    ``sums`` is null for a word that is only asked for."""
    timed = lambda rows: rows.where("ts IS NOT NULL").withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    signs = pack_bits(family(F.col("doc_id"), (num_hashes + 31) // 32, hashes), num_hashes)
    rows = timed(docs).select("at", "words", signs.alias("h")).select("at", F.explode("words").alias("word"), "h", F.lit(False).alias("asks"))
    if queries is not None:
        rows = rows.unionByName(timed(queries).select("at", "word", F.lit(None).cast("array<int>").alias("h"), F.lit(True).alias("asks")))
    width = hours * 3600
    window = F.window("at", f"{width} seconds", f"{width} seconds", f"{start % width} seconds")
    sums = [F.sum(F.get("h", F.lit(i))).alias(f"s{i}") for i in range(num_hashes)]
    found = rows.where("word IS NOT NULL").groupBy(window.alias("w"), "word").agg(*sums, F.max("asks").alias("asked"))
    slot = F.floor((F.unix_timestamp("w.start") - start) / width).cast("int")
    whole = F.when(F.col("s0").isNotNull(), F.array(*(F.col(f"s{i}") for i in range(num_hashes))))
    return found.select(slot.alias("slot"), "word", whole.alias("sums"), "asked")


class SlotAnswers:
    """Answers the queries of the slots that close in a micro-batch of ``slotted_tow``: the ``k`` best words of each (query, slot)."""

    def __init__(self, spark: SparkSession, location: str, *, num_hashes: int, num_means: int, k: int):
        self.versions = Versions(spark, location, "answers")
        self.options = {"num_hashes": num_hashes, "num_means": num_means, "k": k}

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self.versions.has(number):
            return
        closed = materialize(batch, "closed")  # a second action would run the state's update again
        if not closed.isEmpty():
            model = closed.where("sums IS NOT NULL").select("word", "slot", "sums")
            self.versions.write(S.tow_answers(model, closed.where("asked").select("word", "slot"), **self.options), number, "answers")
        discard(closed)

    def answers(self) -> DataFrame:
        """(query, slot, rank, word, score) of all slots that have closed."""
        return self.versions.all("answers", ANSWER)


def answered(docs: DataFrame, queries: DataFrame, location: str, checkpoint: str, *, num_hashes: int, num_means: int, k: int, hours: int, start: int = 0, late: str = "1 hour") -> DataFrame:
    """Runs both streams over all that is there and returns the answers so far; goes on from ``checkpoint`` and ``location`` if they hold an earlier run's."""
    sink = SlotAnswers(docs.sparkSession, location, num_hashes=num_hashes, num_means=num_means, k=k)
    closed = slotted_tow(docs, queries, num_hashes=num_hashes, hours=hours, start=start, late=late)
    closed.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sink.answers()
