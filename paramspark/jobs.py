"""Command line: build sketches from delimited text, predict from sketches, factorize ratings, classify, evaluate.

    python -m paramspark.jobs bloom|minhash|minhash-variation|tow INPUT OUTPUT --words FILE [--hours N --start EPOCH]
    python -m paramspark.jobs bloom-predict|tow-predict|minhash-predict MODEL OUTPUT --words FILE --k 10 [--counts FILE]
    python -m paramspark.jobs mf INPUT OUTPUT --rounds 10        lines "ts,user,item"; writes OUTPUT/users and OUTPUT/items, "id;value" a line
    python -m paramspark.jobs pa INPUT OUTPUT --classes 2 --test FILE   lines "label index:value …"; writes "row,label,answer" of the test lines
    python -m paramspark.jobs evaluate ANSWERS OUTPUT             lines "row,label,answer"; writes the number of rows and the percentage that is right
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation as E
from .operators import factorization as M
from .operators import passive_aggressive as PA
from .operators import sketches as S
from .plans.storage import materialize
from .sources import tweets as T


def factorize(spark: SparkSession, a: argparse.Namespace) -> None:
    rated = T.read_ratings(spark, a.input, a.delimiter)
    found = M.train_offline(rated, size=a.factors, rate=a.rate, rounds=a.rounds, negatives=a.negatives)
    T.factor_lines(found.users).write.text(f"{a.output}/users")
    T.factor_lines(found.items).write.text(f"{a.output}/items")


def _examples(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, labels) of lines ``label index:value …``."""
    rows = lines.where("value <> ''").select(F.monotonically_increasing_id().alias("vec"), F.split("value", " +").alias("parts"))
    rows = materialize(rows, "examples")
    entries = rows.select("vec", F.explode(F.slice("parts", 2, F.size("parts"))).alias("e")).select("vec", F.split("e", ":").alias("e"))
    features = entries.select("vec", F.get("e", F.lit(0)).cast("int").alias("feature"), F.get("e", F.lit(1)).cast("double").alias("x"))
    return features, rows.select("vec", F.get("parts", F.lit(0)).cast("int").alias("label"))


def classify(spark: SparkSession, a: argparse.Namespace) -> None:
    train, labels = _examples(spark.read.text(a.input))
    test, wanted = _examples(spark.read.text(a.test or a.input))
    taught = labels.select("vec", (F.when(F.col("label") > 0, 1.0).otherwise(-1.0) if a.classes == 2 else F.col("label")).alias("label"))
    answers, _ = PA.classify_offline(train, taught, test, classes=a.classes, rounds=a.rounds, variant=a.variant, c=a.aggressiveness)
    answer = F.when(F.col("predicted"), 1).otherwise(-1) if a.classes == 2 else F.col("predicted")
    answers.join(wanted, "vec").select(F.concat_ws(",", "vec", "label", answer).alias("value")).write.text(a.output)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.csv(a.input, schema="row bigint, label int, predicted int")
    E.accuracy(rows).select(F.concat_ws(",", "n", "accuracy").alias("value")).write.text(a.output)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=["bloom", "minhash", "minhash-variation", "tow", "bloom-predict", "tow-predict", "minhash-predict", "mf", "pa", "evaluate"])
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--words", help="text file with a word a line")
    p.add_argument("--counts", help="text file with word:count a line")
    p.add_argument("--test", help="lines to classify")
    p.add_argument("--rounds", type=int, default=10)
    p.add_argument("--factors", type=int, default=10)
    p.add_argument("--rate", type=float, default=0.01)
    p.add_argument("--negatives", type=int, default=0)
    p.add_argument("--classes", type=int, default=2)
    p.add_argument("--variant", default="PA", choices=["PA", "PA-I", "PA-II"])
    p.add_argument("--aggressiveness", type=float, default=1.0)
    p.add_argument("--delimiter", default=",")
    p.add_argument("--hours", type=int)
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--bits", type=int, default=1024)
    p.add_argument("--hashes", type=int, default=4)
    p.add_argument("--means", type=int, default=4)
    p.add_argument("--k", type=int, default=10)
    p.add_argument("--family", default="portable", choices=["portable", "murmur3", "xx64"])
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.job in ("mf", "pa", "evaluate"):
        {"mf": factorize, "pa": classify, "evaluate": evaluate}[a.job](spark, a)
        return
    if not a.words:
        p.error("--words is needed")
    slot = a.hours is not None
    if a.job.endswith("-predict"):
        queries = spark.read.text(a.words).select(F.col("value").alias("word"))
        values = {"bloom-predict": "bits", "tow-predict": "sums", "minhash-predict": "signature"}[a.job]
        model = T.read_sketch(spark.read.text(a.input), slot).withColumnRenamed("values", values)
        if values == "bits":
            found = S.bloom_predict(model.withColumn("bits", F.col("bits").cast("array<int>")), queries, num_bits=a.bits, num_hashes=a.hashes, k=a.k, slot=slot)
        elif values == "signature":
            counts = T.read_sketch(spark.read.text(a.counts)).select("word", F.get("values", F.lit(0)).alias("n"))
            found = S.minhash_predict(model, counts, queries, num_hashes=a.hashes, k=a.k)
        else:
            found = S.tow_predict(model, queries, num_hashes=a.hashes, num_means=a.means, k=a.k, slot=slot)
        T.prediction_lines(found).write.text(a.output)
        return
    keep = [r["value"] for r in spark.read.text(a.words).collect()]
    docs = T.read_tweets(spark.read.text(a.input), a.delimiter, keep, start=a.start, hours=a.hours)
    if a.job == "bloom":
        lines = T.sketch_lines(S.bloom_build(docs, num_bits=a.bits, num_hashes=a.hashes, slot=slot, hashes=a.family), "bits", "slot" if slot else None)
    elif a.job == "minhash-variation":
        lines = T.sketch_lines(S.minhash_build_rehashed(docs, num_hashes=a.hashes, hashes=a.family), "signature")
    elif a.job == "minhash":
        lines = T.sketch_lines(S.minhash_build(docs, num_hashes=a.hashes, slot=slot, hashes=a.family), "signature", "slot" if slot else None)
    else:
        lines = T.sketch_lines(S.tow_build(docs, num_hashes=a.hashes, slot=slot, hashes=a.family), "sums", "slot" if slot else None)
    lines.write.text(a.output)


if __name__ == "__main__":
    main()
