"""Readers of delimited text: documents with words, optionally in time slots; ratings; sketches, predictions and factors as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Places of a line's fields.
ID_FIELD, TIME_FIELD, TEXT_FIELD = 0, 1, 5


def words_of(text: Column, keep: list[str] | None = None, lower: bool = True, separator: str = " ") -> Column:
    """Words of a text, those of ``keep`` only if given, without empty ones."""
    words = F.split(F.lower(text) if lower else text, f"[{separator}]" if separator == " " else separator)
    return F.filter(words, lambda w: w.isin(keep)) if keep else F.array_remove(words, "")


def time_slot(seconds: Column, start: int, hours: int) -> Column:
    """Number of the window that holds a time; truncates toward zero."""
    return ((seconds - F.lit(start)) / F.lit(hours * 3600)).cast("int")


def read_tweets(lines: DataFrame, delimiter: str, keep: list[str], *, lower: bool = True, start: int | None = None, hours: int | None = None) -> DataFrame:
    """(doc_id, words[, slot]) of text lines (column ``value``) that hold a word of ``keep``."""
    fields = F.split("value", delimiter)
    columns = [F.get(fields, F.lit(ID_FIELD)).cast("long").alias("doc_id"), words_of(F.get(fields, F.lit(TEXT_FIELD)), keep, lower).alias("words")]
    if hours is not None:
        columns.append(time_slot(F.get(fields, F.lit(TIME_FIELD)).cast("long"), start or 0, hours).alias("slot"))
    return lines.select(*columns).where(F.size("words") > 0)


def read_ratings(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(user, item, rating, ts) of lines ``ts, user, item``; every rating is 1."""
    rows = spark.read.csv(path, sep=separator, schema="ts bigint, user int, item int")
    return rows.select("user", "item", F.lit(1.0).alias("rating"), "ts")


def sketch_lines(sketch: DataFrame, values: str, slot: str | None = None) -> DataFrame:
    """Lines ``word:v,v,…`` or ``(word,slot):v,v,…``."""
    key = F.concat(F.lit("("), F.col("word"), F.lit(","), F.col(slot).cast("string"), F.lit(")")) if slot else F.col("word")
    return sketch.select(F.concat(key, F.lit(":"), F.array_join(F.col(values).cast("array<string>"), ",")).alias("value"))


def read_sketch(lines: DataFrame, slotted: bool = False) -> DataFrame:
    """(word[, slot], values) of sketch lines."""
    values = F.split(F.regexp_extract("value", r":([^:]*)$", 1), ",").cast("array<bigint>").alias("values")
    if slotted:
        return lines.select(F.regexp_extract("value", r"^\((.*),(-?\d+)\):", 1).alias("word"), F.regexp_extract("value", r"^\((.*),(-?\d+)\):", 2).cast("int").alias("slot"), values)
    return lines.select(F.regexp_extract("value", r"^(.*):[^:]*$", 1).alias("word"), values)


def prediction_lines(predictions: DataFrame) -> DataFrame:
    """Lines ``word - (w1,c1), (w2,c2)…`` of (query, rank, word, score); scores rounded."""
    pair = F.concat(F.lit("("), F.col("word"), F.lit(","), F.round("score").cast("long").cast("string"), F.lit(")"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", pair.alias("text")))), lambda x: x["text"])
    return predictions.groupBy("query").agg(F.concat_ws(", ", listed).alias("text")).select(F.concat(F.col("query"), F.lit(" - "), F.col("text")).alias("value"))


def factor_lines(factors: DataFrame) -> DataFrame:
    """Lines ``id;value``, one for each coordinate in order; those of an id are in one partition, so in one file."""
    one = factors.select("id", F.posexplode("vec").alias("k", "v"))
    placed = one.repartitionByRange("id").sortWithinPartitions("id", "k")
    return placed.select(F.concat_ws(";", F.col("id").cast("string"), F.col("v").cast("string")).alias("value"))


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec) of text files of factor lines ``id;value``: an id's lines are its coordinates in the order of its file, whatever order the files are
    read in. Ids whose lines are in two files have no order and are refused (when the rows are read)."""
    files = spark.read.text(path)
    parts = F.split("value", ";")
    own = F.col("_metadata")
    rows = files.where("value <> ''").select(
        F.get(parts, F.lit(0)).cast("bigint").alias("id"), F.get(parts, F.lit(1)).cast("double").alias("v"),
        own["file_path"].alias("file"), own["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"),
    )
    # Blocks of a file are read in any order, rows of a block in the file's.
    found = rows.groupBy("id").agg(F.min("file").alias("first"), F.max("file").alias("last"), F.collect_list(F.struct("block", "row", "v")).alias("rows"))
    twice = F.raise_error(F.concat(F.lit("factor "), F.col("id").cast("string"), F.lit(" is in two files: "), F.col("first"), F.lit(" and "), F.col("last"))).cast("array<double>")
    return found.select("id", F.when(F.col("first") == F.col("last"), F.transform(F.array_sort("rows"), lambda x: x["v"])).otherwise(twice).alias("vec"))


def split_by_time(events: DataFrame, ts: str, train_days: int, test_days: int) -> tuple[DataFrame, DataFrame]:
    """Train: the first ``train_days`` from the earliest time on; test: the next ``test_days``."""
    first = events.agg(F.min(ts).alias("first"))
    dated = events.crossJoin(F.broadcast(first))  # one row
    day = F.floor((F.unix_timestamp(ts) - F.unix_timestamp("first")) / 86400)
    dated = dated.withColumn("__day", day).drop("first")
    return dated.where(F.col("__day") < train_days).drop("__day"), dated.where((F.col("__day") >= train_days) & (F.col("__day") < train_days + test_days)).drop("__day")
