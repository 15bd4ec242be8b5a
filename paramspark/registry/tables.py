"""Views on the tables that the registered queries share, and the SQL of the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tweets import time_slot, words_of

BLANKS = "[ \\n\\t\\r]+"
START = 1_704_067_200  # 2024-01-01, the first event's day


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. It may be one file, which a stream reads by a pattern only."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, words) of all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", words_of(F.col("text"), separator=BLANKS).alias("words"))


def epoch(ts) -> object:
    """Whole seconds of a time, read as UTC."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / 1_000_000).cast("long")


def slotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, words, slot) of all events: type and user as words, a day a slot."""
    events = table(spark, sf_dir, "events")
    words = F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return events.select(F.col("event_id").alias("doc_id"), words.alias("words"), time_slot(epoch(F.col("ts")), START, 24).alias("slot"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item, rating, ts): mean quantity of each customer and part, centred and scaled; ts is the first order's day."""
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    mean = F.avg("l_quantity") / 50
    day = F.floor(epoch(F.min("o_orderdate")) / 86_400).cast("long")
    return bought.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(mean.alias("rating"), day.alias("ts"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec) of all embeddings, as doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def word_list(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


HASH = "('0x' || substr(md5({key} || ':' || {i}), 1, 15))::BIGINT"


def hash_sql(key: str, i: str) -> str:
    return HASH.format(key=f"CAST({key} AS VARCHAR)", i=f"CAST({i} AS VARCHAR)")


WORDED_SQL = "w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\n\\t\\r]+'), lambda x: x <> '') AS words FROM documents)"
PAIRS_SQL = "dw AS (SELECT DISTINCT doc_id, unnest(words) AS word FROM w)"
EVENTS_SQL = f"""s AS (SELECT event_id AS doc_id, ['' || event_type, 'u' || user_id] AS words, CAST(trunc((floor(epoch(ts)) - {START}) / 86400.0) AS INTEGER) AS slot FROM events),
sw AS (SELECT doc_id, slot, unnest(words) AS word FROM s)"""
RATINGS_SQL = "r AS (SELECT o_custkey AS \"user\", l_partkey AS item, avg(l_quantity) / 50 AS rating, CAST(floor(epoch(min(o_orderdate)) / 86400) AS BIGINT) AS ts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"
