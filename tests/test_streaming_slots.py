"""Slotted sketches and their answers on a stream: equal to the batch form once slots close, whatever restarts; the state goes with its slots."""

import random

import pytest
from pyspark.sql import functions as F
from test_streaming_state import in_files, runs, source

from paramspark.operators import sketches as S
from paramspark.streaming import slots as L

HOUR, START = 3600, 1_704_067_200
OPTIONS = {"num_hashes": 8, "hours": 2, "start": START, "late": "10 minutes"}
ASK = {"num_hashes": 8, "num_means": 4, "k": 3}


def made(spark, seed=0, hours=11):
    rng = random.Random(seed)
    docs = [(START + i * 300 + rng.randrange(300), i, rng.choices("abcdefg", k=rng.randrange(5))) for i in range(hours * 12)]
    queries = [(START + i * 1700 + rng.randrange(1700), rng.choice([*"abcxy", None])) for i in range(hours * 2)]
    docs = spark.createDataFrame(docs + [(None, 9999, ["a"])], "ts long, doc_id long, words array<string>")
    return docs, spark.createDataFrame(queries, "ts long, word string")


def slot(ts="ts"):
    return F.floor((F.col(ts) - START) / (2 * HOUR)).cast("int").alias("slot")


def batch_answers(docs, queries, before):
    """Answers of the batch form in the slots below ``before``."""
    model = S.tow_build(docs.where("ts IS NOT NULL").withColumn("slot", slot()), num_hashes=8, slot=True)
    asked = queries.where("word IS NOT NULL").select("word", slot())
    return sorted(map(tuple, S.tow_answers(model, asked, **ASK).where(F.col("slot") < before).collect()))


def closed_slots(docs, queries):
    """Slots whose end both watermarks have passed."""
    last = min(docs.agg(F.max("ts")).first()[0], queries.agg(F.max("ts")).first()[0]) - 600
    return (last - START) // (2 * HOUR)


def test_answers_equal_the_batch_form(spark, tmp_path):
    docs, queries = made(spark)
    a, b = in_files(docs, str(tmp_path / "docs"), "ts", 5), in_files(queries, str(tmp_path / "queries"), "ts", 3)
    got = L.answered(source(spark, a, docs.schema), source(spark, b, queries.schema), str(tmp_path / "out"), str(tmp_path / "checkpoint"), **OPTIONS, num_means=4, k=3)
    want = batch_answers(docs, queries, closed_slots(docs, queries))
    assert closed_slots(docs, queries) >= 4 and len(want) > 10
    assert sorted(map(tuple, got.collect())) == want


def test_answers_are_the_same_after_a_kill(spark, tmp_path):
    """A sink that dies once its answers are half written, and a new one that goes on from the checkpoint."""
    docs, queries = made(spark, 1)
    a, b = in_files(docs, str(tmp_path / "docs"), "ts", 4), in_files(queries, str(tmp_path / "queries"), "ts", 4)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    stream = lambda: L.slotted_tow(source(spark, a, docs.schema), source(spark, b, queries.schema), **OPTIONS)

    class Killed(L.SlotAnswers):
        def __call__(self, batch, number):
            super().__call__(batch, number)
            if len(self.versions.done) == 2:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{number}/answers/_SUCCESS")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
                raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        runs(stream(), Killed(spark, out, **ASK), checkpoint)
    again = L.SlotAnswers(spark, out, **ASK)
    assert len(again.versions.done) == 1
    runs(stream(), again, checkpoint)
    want = batch_answers(docs, queries, closed_slots(docs, queries))
    assert sorted(map(tuple, again.answers().collect())) == want
    # A third start has nothing left to do.
    runs(stream(), L.SlotAnswers(spark, out, **ASK), checkpoint)
    assert sorted(map(tuple, L.SlotAnswers(spark, out, **ASK).answers().collect())) == want


def test_state_goes_with_its_slots(spark, tmp_path):
    """What the state holds in the end are the words of open slots; late rows change nothing."""
    docs, _ = made(spark, 2)
    late = spark.createDataFrame([(START + 5, 7777, ["a", "b"])], docs.schema)
    folder = in_files(docs.where("ts IS NOT NULL"), str(tmp_path / "docs"), "ts", 3)
    rows = []
    sink = lambda batch, _: rows.extend(batch.collect())
    runs(L.slotted_tow(source(spark, folder, docs.schema), **OPTIONS), sink, str(tmp_path / "checkpoint"))
    late.coalesce(1).write.mode("append").parquet(folder)
    query = L.slotted_tow(source(spark, folder, docs.schema), **OPTIONS).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    model = S.tow_build(docs.where("ts IS NOT NULL").withColumn("slot", slot()), num_hashes=8, slot=True)
    last = (docs.agg(F.max("ts")).first()[0] - 600 - START) // (2 * HOUR)
    assert sorted((r["word"], r["slot"], tuple(r["sums"])) for r in rows) == sorted((r["word"], r["slot"], tuple(r["sums"])) for r in model.where(F.col("slot") < last).collect())
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == model.where(F.col("slot") >= last).count()
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress) == 2


def test_times_before_the_start_are_negative_slots(spark, tmp_path):
    docs = spark.createDataFrame([(START - 1, 1, ["a"]), (START - 2 * HOUR - 1, 2, ["a"]), (START + 5 * HOUR, 3, ["b"])], "ts long, doc_id long, words array<string>")
    rows = []
    runs(L.slotted_tow(source(spark, in_files(docs, str(tmp_path / "docs"), "ts", 1), docs.schema), **OPTIONS), lambda batch, _: rows.extend(batch.collect()), str(tmp_path / "c"))
    assert sorted((r["slot"], r["word"]) for r in rows) == [(-2, "a"), (-1, "a")]
