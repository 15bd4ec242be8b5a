"""Streams with state: what comes out after restarts equals the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from paramspark.operators import passive_aggressive as PA
from paramspark.operators import topk as K
from paramspark.streaming import classify as C
from paramspark.streaming import memory as U


def in_files(df, folder, order, n):
    """Rows in order over ``n`` files, of rising times."""
    import os
    import time

    rows = df.orderBy(order).collect()
    step = -(-len(rows) // n)
    for i in range(n):
        some = df.sparkSession.createDataFrame(rows[i * step : (i + 1) * step], df.schema)
        some.coalesce(1).write.parquet(f"{folder}-part{i}")
        os.makedirs(folder, exist_ok=True)
        for name in os.listdir(f"{folder}-part{i}"):
            if name.endswith(".parquet"):
                os.rename(f"{folder}-part{i}/{name}", f"{folder}/{i:03}.parquet")
                os.utime(f"{folder}/{i:03}.parquet", (time.time() - 1000 + i,) * 2)
    return folder


def runs(stream, sink, checkpoint, mode="append"):
    query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def source(spark, folder, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("latestFirst", "false").parquet(folder)


def collected(spark, make, folder, tmp_path, schema):
    """Rows of a stream that is stopped after two files and started again from its checkpoint."""
    import os

    os.makedirs(f"{folder}-now")
    rows = []
    files = sorted(os.listdir(folder))
    for stop in (2, len(files)):
        for name in files[:stop]:
            if not os.path.exists(f"{folder}-now/{name}"):
                os.link(f"{folder}/{name}", f"{folder}-now/{name}")
        runs(make(source(spark, f"{folder}-now", schema)), lambda batch, _: rows.extend(batch.collect()), str(tmp_path / "checkpoint"), "append")
    return rows


@pytest.mark.parametrize("memory", [0, 1, 3])
def test_memory_of_users_equals_the_batch_form(spark, tmp_path, memory):
    rng = random.Random(memory)
    events = spark.createDataFrame([(i, rng.choice([1, 2, 3, 4, None]), rng.randrange(6)) for i in range(80)], "event long, user int, item long")
    folder = in_files(events, str(tmp_path / "events"), "event", 4)
    got = collected(spark, lambda s: U.remembered(s, user="user", item="item", order="event", memory=memory), folder, tmp_path, events.schema)
    want = K.recent_items(events, user="user", item="item", order="event", memory=memory).collect()
    assert sorted((r["order"], r["user"] or 0, r["item"], list(r["recent"])) for r in got) == sorted((r["event"], r["user"] or 0, r["item"], list(r["recent"])) for r in want)


def test_lists_without_what_is_remembered(spark, tmp_path):
    """Repeats hold places: two of the same item push an older one out. What is remembered leaves before the cut to k."""
    rng = random.Random(7)
    rows = [(i, i % 3, rng.randrange(5), [(j, float(rng.randrange(4))) for j in range(6)] if i % 7 else None) for i in range(60)]
    events = spark.createDataFrame(rows, "event long, user int, item long, candidates array<struct<item:bigint,score:double>>")
    folder = in_files(events, str(tmp_path / "events"), "event", 3)
    got = collected(spark, lambda s: U.recommended(s, user="user", item="item", order="event", candidates="candidates", k=3, memory=3), folder, tmp_path, events.schema)
    want, seen = [], {}
    for event, user, item, candidates in rows:
        left = [(-s, j) for j, s in candidates or [] if j not in seen.get(user, [])]
        want += [(event, user, rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(left)[:3])]
        seen[user] = (seen.get(user, []) + [item])[-3:]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_memory_has_a_bound():
    with pytest.raises(ValueError):
        U.UserMemory(-1)


def examples(spark, classes, n=90):
    rng = random.Random(classes)
    rows = []
    for i in range(n):
        label = rng.randrange(classes)
        features = {label * 3 + j: rng.random() for j in range(3)} | {20 + rng.randrange(4): rng.random() / 2}
        known = (2 * label - 1 if classes == 2 else label) if rng.random() < 0.6 else None
        rows.append((i, features if i % 17 else {}, known))
    return spark.createDataFrame(rows, "vec long, features map<int,double>, label int")


@pytest.mark.parametrize("classes", [2, 3])
def test_answers_are_the_same_after_a_kill(spark, tmp_path, classes):
    """One query over all; another that dies in the middle of a batch, after its answers and before its weights, and is started again with a new sink."""
    rows = examples(spark, classes)
    folder = in_files(rows, str(tmp_path / "rows"), "vec", 5)
    whole = C.MixedClassifier(spark, str(tmp_path / "whole"), classes=classes)
    runs(source(spark, folder, rows.schema), whole, str(tmp_path / "checkpoint"))

    class Killed(C.MixedClassifier):
        def __call__(self, batch, number):
            super().__call__(batch, number)
            if number == 2:
                path = self._path("2/weights/_SUCCESS")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
                raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        runs(source(spark, folder, rows.schema), Killed(spark, str(tmp_path / "killed"), classes=classes), str(tmp_path / "killed-checkpoint"))
    again = C.MixedClassifier(spark, str(tmp_path / "killed"), classes=classes)
    assert again.done == [0, 1]
    runs(source(spark, folder, rows.schema), again, str(tmp_path / "killed-checkpoint"))
    answers = lambda sink: sorted(tuple(r) for r in sink.answers().collect())
    assert answers(again) == answers(whole) and again.done == whole.done == [0, 1, 2, 3, 4]
    asked = {r["vec"] for r in rows.where("label IS NULL AND size(features) > 0").collect()}
    assert [v for v, _, _ in answers(whole)] == sorted(asked)
    # A third start has nothing left to do.
    runs(source(spark, folder, rows.schema), C.MixedClassifier(spark, str(tmp_path / "killed"), classes=classes), str(tmp_path / "killed-checkpoint"))
    assert answers(C.MixedClassifier(spark, str(tmp_path / "killed"), classes=classes)) == answers(whole)


@pytest.mark.parametrize("classes", [2, 3])
def test_answers_equal_the_batch_form(spark, tmp_path, classes):
    """Micro-batches of a file each are those of ``train_and_predict`` over as many equal parts."""
    rows = examples(spark, classes)
    folder = in_files(rows, str(tmp_path / "rows"), "vec", 3)
    sink = C.MixedClassifier(spark, str(tmp_path / "out"), classes=classes)
    runs(source(spark, folder, rows.schema), sink, str(tmp_path / "checkpoint"))
    features = rows.select("vec", F.explode("features").alias("feature", "x"))
    want = PA.train_and_predict(rows.select("vec", F.col("vec").alias("seq"), F.col("label").cast("double" if classes == 2 else "int").alias("label")), features, batches=3, classes=classes)
    assert sorted((r["vec"], r["predicted"], r["batch"]) for r in sink.answers().collect()) == sorted((r["vec"], r["predicted"], r["batch"]) for r in want.collect())
