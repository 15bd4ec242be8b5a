import numpy as np
from pyspark.sql import functions as F

from paramspark import jobs
from paramspark.operators import sketches as S
from paramspark.operators.factorization import Factors, initial
from paramspark.sources import tweets as T
from paramspark.streaming import jobs as J


def test_tweets(spark):
    lines = spark.createDataFrame([("1|1000|x|y|z|Hello big  World",), ("2|-4000|x|y|z|nothing",), ("3|8000|||| world",)], "value string")
    got = {(r["doc_id"], tuple(r["words"]), r["slot"]) for r in T.read_tweets(lines, r"\|", ["hello", "world"], start=0, hours=1).collect()}
    assert got == {(1, ("hello", "world"), 0), (3, ("world",), 2)}
    assert [r["doc_id"] for r in T.read_tweets(lines, r"\|", ["Hello"], lower=False).collect()] == [1]
    assert lines.select(T.time_slot(F.lit(-4000), 0, 1).alias("s")).first()["s"] == -1


def test_sketch_text_round_trip(spark):
    model = spark.createDataFrame([("a:b", 3, [1, 2]), ("c", -1, [5])], "word string, slot int, v array<int>")
    assert {(r["word"], tuple(r["values"])) for r in T.read_sketch(T.sketch_lines(model, "v")).collect()} == {("a:b", (1, 2)), ("c", (5,))}
    assert {(r["word"], r["slot"], tuple(r["values"])) for r in T.read_sketch(T.sketch_lines(model, "v", "slot"), True).collect()} == {("a:b", 3, (1, 2)), ("c", -1, (5,))}


def test_prediction_and_factor_lines(spark):
    p = spark.createDataFrame([("q", 2, "b", 1.4), ("q", 1, "a", 2.6)], "query string, rank int, word string, score double")
    assert T.prediction_lines(p).first()["value"] == "q - (a,3), (b,1)"
    f = spark.createDataFrame([(1, [0.5, 1.5])], "id int, vec array<double>")
    assert [r["value"] for r in T.factor_lines(f).collect()] == ["1;0.5", "1;1.5"]


def test_ratings_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("10,1,2\n11,3,4\n")
    assert {tuple(r) for r in T.read_ratings(spark, str(tmp_path / "r.csv")).collect()} == {(1, 2, 1.0, 10), (3, 4, 1.0, 11)}


def test_cli(spark, tmp_path):
    (tmp_path / "in.txt").write_text("".join(f"{i},0,x,y,z,red {'blue' if i % 2 else 'green'}\n" for i in range(20)))
    (tmp_path / "words.txt").write_text("red\nblue\ngreen\n")
    for job in ("bloom", "tow"):
        jobs.main([job, str(tmp_path / "in.txt"), str(tmp_path / job), "--words", str(tmp_path / "words.txt"), "--hashes", "16"])
        jobs.main([f"{job}-predict", str(tmp_path / job), str(tmp_path / f"{job}p"), "--words", str(tmp_path / "words.txt"), "--hashes", "16", "--k", "2"])
        assert spark.read.text(str(tmp_path / f"{job}p")).count() == 3
    jobs.main(["minhash", str(tmp_path / "in.txt"), str(tmp_path / "m"), "--words", str(tmp_path / "words.txt"), "--hours", "1"])
    assert spark.read.text(str(tmp_path / "m")).where("value like '(red,0):%'").count() == 1


def files(spark, tmp_path, df, n=3):
    df.repartition(n).write.parquet(str(tmp_path / "in"))
    return J.stream_parquet(spark, str(tmp_path / "in"))


def test_running_sums_equal_batch(spark, tmp_path):
    df = spark.range(50).select((F.col("id") % 4).cast("string").alias("k"), F.col("id").alias("v"))
    got = J.drain(J.running_sums(files(spark, tmp_path, df), id="k", delta="v"), "sums", "complete", str(tmp_path / "c"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in df.groupBy("k").agg(F.sum("v")).collect()}


def test_slotted_stream_equals_batch(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    bloom = J.slotted_bloom(files(spark, tmp_path, events, 2), ts="ts", doc_id="event_id", word="event_type", num_bits=256, num_hashes=2, hours=24, late="40 days")
    got = {(r["slot_start"], r["word"]): r["bits"] for r in J.drain(bloom, "bloom", "complete", str(tmp_path / "c")).collect()}
    docs = events.select(F.col("event_id").alias("doc_id"), F.array("event_type").alias("words"), F.dayofyear("ts").alias("slot"))
    want = S.bloom_build(docs, num_bits=256, num_hashes=2, slot=True)
    assert sorted(map(tuple, got.values())) == sorted(tuple(r["bits"]) for r in want.collect())
    counts = J.slotted_counts(J.stream_parquet(spark, str(tmp_path / "in")), ts="ts", key="event_type", hours=24)
    assert J.drain(counts, "counts", "complete", str(tmp_path / "c2")).agg(F.sum("n")).first()[0] == events.count()


def test_model_load_stream(spark, tmp_path):
    df = spark.range(30).select(F.concat(F.lit("id"), (F.col("id") % 10).cast("string")).alias("id"), F.lit(1).cast("bigint").alias("delta"))
    model = spark.range(10).select(F.concat(F.lit("id"), F.col("id").cast("string")).alias("id"), (F.col("id") * 10).alias("value"))
    got = J.drain(J.sums_from_model(files(spark, tmp_path, df), model), "loaded", "update", str(tmp_path / "c"))
    last = {r["id"]: r["v"] for r in got.groupBy("id").agg(F.max("value").alias("v")).collect()}
    assert last == {f"id{i}": 10 * i + 3 for i in range(10)}


def test_online_factors_skip_repeated_batches(spark):
    rows = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.5)], "user int, item int, rating double")
    sink = J.OnlineFactors(Factors(initial(rows, "user", 2, 0.0, 0.1), initial(rows, "item", 2, 0.0, 0.1)), size=2, rate=0.5)
    sink(rows, 0)
    first = sink.factors.users.first()["vec"]
    sink(rows, 0)
    assert sink.factors.users.first()["vec"] == first
    sink(rows, 1)
    assert not np.allclose(sink.factors.users.first()["vec"], first)


def test_replay(spark, tmp_path):
    spark.dataSource.register(J.ReplaySource)
    stream = spark.readStream.format("replay").option("lines", "30,b\n10,a\n95,c").option("speed", "50").load()
    q = stream.writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(100):
            q.awaitTermination(0.3)
            if spark.table("replayed").count() == 3:
                break
        assert [r["value"] for r in spark.table("replayed").orderBy("ts").collect()] == ["10,a", "30,b", "95,c"]
    finally:
        q.stop()


def test_factor_text_round_trip(spark, tmp_path):
    from paramspark.sources import tweets as T

    rows = [(i, [i + k / 8 for k in range(6)]) for i in range(20)]
    T.factor_lines(spark.createDataFrame(rows, "id bigint, vec array<double>")).coalesce(1).write.text(f"{tmp_path}/f")
    assert sorted((r["id"], list(r["vec"])) for r in T.read_factors(spark, f"{tmp_path}/f").collect()) == rows


def test_factors_over_many_files(spark, tmp_path):
    """Shuffled vectors over eight files, read in small blocks; an id whose lines are in two files is refused."""
    import random

    import pytest
    from pyspark.sql import functions as F

    rows = [(i, [i + k / 8 for k in range(9)]) for i in range(5003)]
    mixed = random.Random(4).sample(rows, len(rows))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        T.factor_lines(spark.createDataFrame(mixed, "id bigint, vec array<double>").repartition(6)).write.text(f"{tmp_path}/many")
        assert len(list((tmp_path / "many").glob("part-*"))) > 1
        assert sorted((r["id"], list(r["vec"])) for r in T.read_factors(spark, f"{tmp_path}/many").collect()) == rows
        spark.createDataFrame([("1;0.5",)], "value string").select(F.col("value")).write.mode("append").text(f"{tmp_path}/many")
        with pytest.raises(Exception, match="two files"):
            T.read_factors(spark, f"{tmp_path}/many").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_replay_of_a_file_under_a_watermark(spark, tmp_path):
    from pyspark.sql import functions as F

    from paramspark.streaming import jobs as J

    (tmp_path / "log").write_text("\n".join(f"{t},u{t % 3},i{t}" for t in range(0, 36_000, 600)))
    stream = J.replayed(spark, str(tmp_path / "log"), speed=7200, until=20_000)
    hours = stream.groupBy(F.window("event_time", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
    query = hours.writeStream.format("memory").queryName("replayed_hours").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.table("replayed_hours").collect()
    assert len(got) >= 5 and all(r["n"] == 6 for r in got)


def test_jobs_factorize_classify_evaluate(spark, tmp_path):
    from paramspark import jobs
    from paramspark.sources import tweets as T

    (tmp_path / "ratings").write_text("".join(f"{t},{t % 7},{t % 5}\n" for t in range(60)))
    jobs.main(["mf", str(tmp_path / "ratings"), str(tmp_path / "mf"), "--rounds", "2", "--factors", "3", "--negatives", "1"])
    users = T.read_factors(spark, str(tmp_path / "mf" / "users")).collect()
    assert {r["id"] for r in users} == set(range(7)) and all(len(r["vec"]) == 3 for r in users)
    for classes, label in ((2, lambda t: 1 if t % 2 else -1), (3, lambda t: t % 3)):
        (tmp_path / f"train{classes}").write_text("".join(f"{label(t)} {t % classes}:1.0 {5 + t % 4}:0.1\n" for t in range(90)))
        jobs.main(["pa", str(tmp_path / f"train{classes}"), str(tmp_path / f"pa{classes}"), "--classes", str(classes), "--rounds", "3"])
        jobs.main(["evaluate", str(tmp_path / f"pa{classes}"), str(tmp_path / f"ok{classes}")])
        assert spark.read.text(str(tmp_path / f"ok{classes}")).first()[0] == "90,100.0"


def test_jobs_minhash_predict(spark, tmp_path):
    from paramspark import jobs

    (tmp_path / "tweets").write_text("".join(f"{i},0,,,,{'a b' if i % 2 else 'a c'}\n" for i in range(40)))
    (tmp_path / "words").write_text("a\nb\nc\n")
    (tmp_path / "counts").write_text("a:40\nb:20\nc:20\n")
    for job in ("minhash", "minhash-variation"):
        jobs.main([job, str(tmp_path / "tweets"), str(tmp_path / job), "--words", str(tmp_path / "words"), "--hashes", "8"])
        jobs.main(["minhash-predict", str(tmp_path / job), str(tmp_path / f"{job}-p"), "--words", str(tmp_path / "words"), "--counts", str(tmp_path / "counts"), "--hashes", "8", "--k", "2"])
        lines = {r[0].split(" - ")[0]: r[0] for r in spark.read.text(str(tmp_path / f"{job}-p")).collect()}
        assert set(lines) == {"a", "b", "c"} and lines["a"].startswith("a - (a,40)")


def test_online_factors_go_on_after_a_restart(spark, tmp_path):
    from paramspark.operators.factorization import Factors, initial
    from paramspark.streaming.jobs import OnlineFactors

    rated = spark.createDataFrame([(i % 5, i % 3, 1.0) for i in range(15)], "user int, item int, rating double")
    start = Factors(initial(rated, "user", 3, 0.0, 0.5, 0), initial(rated, "item", 3, 0.0, 0.5, 1))
    sink = OnlineFactors(start, size=3, rate=0.1, location=str(tmp_path / "f"))
    sink(rated, 0)
    sink(rated, 1)
    vectors = lambda s: sorted((r["id"], list(r["vec"])) for r in s.factors.users.collect())
    again = OnlineFactors(start, size=3, rate=0.1, location=str(tmp_path / "f"))
    assert again.last == 1 and vectors(again) == vectors(sink)
    again(rated, 1)  # a batch that comes again
    assert vectors(again) == vectors(sink)
    again(rated, 2)
    assert vectors(again) != vectors(sink)
