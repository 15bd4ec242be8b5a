"""Keyed parameters, readers and partitioners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parameters as P
from ..operators.logic import LockServer, Server
from ..plans.storage import written_text
from ..sources.tweets import factor_lines, read_factors, read_tweets, split_by_time
from .tables import START, epoch, slotted, table, vectors

KEEP = ["the", "of", "and", "die", "la", "des"]


def count_final(spark, d):
    return P.push(table(spark, d, "events"), id="event_type", delta=F.lit(1).cast("long")).select(F.col("id").alias("event_type"), F.col("value").alias("n"))


def count_running(spark, d):
    return P.push(table(spark, d, "events"), id="event_type", delta=F.lit(1).cast("long"), order="event_id", emit="every").select("seq", "id", "value")


def max_by_user(spark, d):
    return P.push(table(spark, d, "events"), id="user_id", delta="value", update="max", init=F.lit(10.0))


def loose(mode):
    def run(spark, d):
        return P.push_loose(table(spark, d, "events"), id="event_type", delta=F.floor("value"), order="event_id", init=1000 * F.length("id"), on_first_push=mode)

    return run


def model_load(spark, d):
    events = table(spark, d, "events")
    model = events.select(F.col("event_type").alias("id"), (10 * F.length("event_type")).cast("long").alias("value")).distinct()
    return P.load_model(model.unionByName(model), events.select(F.col("event_type").alias("id"), F.lit(1).cast("long").alias("delta")))


def double_model_load(spark, d):
    events = table(spark, d, "events")
    users = P.push(events, id="user_id", delta=F.lit(1).cast("long"))
    types = P.push(events, id="event_type", delta=F.floor("value"))
    rows = events.select("event_id", "user_id", "event_type")
    by_user = P.pull(rows, users, "user_id", F.lit(0)).withColumnRenamed("value", "user_value")
    return P.pull(by_user, types, "event_type", F.lit(0)).select("event_id", "user_value", F.col("value").alias("type_value"))


def pulled_only(spark, d):
    pulls = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    params = P.push(table(spark, d, "orders").where("o_orderstatus = 'F'"), id="o_custkey", delta=F.lit(1).cast("long"))
    return P.touched(pulls, params, F.lit(0).cast("long"))


def range_partition(spark, d):
    lines = table(spark, d, "lineitem")
    features = (lines.agg(F.max("l_partkey")).first()[0] or 0) + 1
    dealt = P.range_partition(lines.select("l_partkey", "l_quantity"), "l_partkey", features, 8)
    return dealt.groupBy(F.col("l_partkey").alias("id"), P.range_owner(F.col("l_partkey"), features, 8).alias("owner")).agg(F.sum("l_quantity").cast("long").alias("value"))


def hash_partition(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.groupBy(P.hash_owner(F.col("l_partkey"), 8).cast("int").alias("owner")).agg(F.sum("l_quantity").cast("long").alias("value"))


class _Locked:
    """Each row pulls and pushes at once: updates of an id are serial."""

    def __init__(self):
        self.server = LockServer(lambda _: 0, lambda a, b: a + b)

    def on_push(self, id, row):  # noqa: A002
        self.server.pull(id, 0)
        (_, value), _ = self.server.push(id, int(row.value))
        yield (int(row.event_id), id, value)

    def close(self, id):  # noqa: A002
        return []


class _Largest:
    """A server whose update is no aggregate: keeps the larger of half the old value and the delta."""

    def __init__(self):
        self.server = Server(lambda _: 0, lambda a, b: max(a // 2, b), on_first_push="delta", emit="close")

    def on_push(self, id, row):  # noqa: A002
        return self.server.push(id, int(row.value))

    def close(self, id):  # noqa: A002
        return self.server.close()


def lock_serial(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    return P.transform(events, id="event_type", order="event_id", logic=_Locked, output="seq bigint, id string, value bigint")


def explicit_logic(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    return P.transform(events, id="event_type", order="event_id", logic=_Largest, output="id string, value bigint")


def tweet_reader(spark, d):
    docs = table(spark, d, "documents")
    lines = docs.select(F.concat_ws("\x01", F.col("doc_id").cast("string"), F.lit("0"), F.lit(""), F.lit(""), F.lit(""), "text").alias("value"))
    return read_tweets(lines, "\x01", KEEP).select("doc_id", F.array_join("words", " ").alias("words"))


def slots(spark, d):
    return slotted(spark, d).groupBy("slot").agg(F.count("*").alias("n"))


def tweet_slots(spark, d):
    events = table(spark, d, "events")
    lines = events.select(F.concat_ws("|", F.col("event_id").cast("string"), epoch(F.col("ts")).cast("string"), F.lit(""), F.lit(""), F.lit(""), "event_type").alias("value"))
    return read_tweets(lines, r"\|", ["click", "view"], start=START + 86_400, hours=6).groupBy("slot", F.get("words", F.lit(0)).alias("word")).agg(F.count("*").alias("n"))


def time_split(spark, d):
    train, test = split_by_time(table(spark, d, "events"), "ts", 10, 5)
    n = lambda df, part: df.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("part", F.lit(part))
    return n(train, "train").unionByName(n(test, "test"))


def activity_quantiles(spark, d):
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    q = [0.1, 0.25, 0.5, 0.75, 0.9]
    found = counts.agg(*(F.round(F.percentile("n", F.lit(x)), 6).alias(f"q{int(100 * x)}") for x in q))
    return found


def factor_text(spark, d):
    """Vectors written as lines of one coordinate and read back: a sum that depends on the order of the coordinates."""
    found = read_factors(spark, written_text(factor_lines(vectors(spark, d).select("id", "vec")), "factors"))
    order = F.aggregate(F.transform("vec", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return found.select("id", F.size("vec").alias("n"), (F.round(order, 4) + 0.0).alias("weighted"))


_PUSH = "SELECT event_type, floor(value)::BIGINT AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events"

QUERIES = {
    "param_count_final": count_final,
    "param_count_running": count_running,
    "param_max_init": max_by_user,
    "param_loose_init_then_update": loose("init_then_update"),
    "param_loose_init": loose("init"),
    "param_loose_delta": loose("delta"),
    "param_model_load": model_load,
    "param_double_model_load": double_model_load,
    "param_pulled_only": pulled_only,
    "param_range_partition": range_partition,
    "param_hash_partition": hash_partition,
    "lock_serial_updates": lock_serial,
    "param_explicit_logic": explicit_logic,
    "tweet_reader": tweet_reader,
    "time_slot": slots,
    "tweet_reader_slotted": tweet_slots,
    "time_split": time_split,
    "user_activity_quantiles": activity_quantiles,
    "factor_text": factor_text,
}

ORACLE_SQL = {
    "param_count_final": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "param_count_running": "SELECT event_id AS seq, event_type AS id, count(*) OVER (PARTITION BY event_type ORDER BY event_id) AS value FROM events",
    "param_max_init": "SELECT user_id AS id, greatest(max(value), 10.0::DOUBLE) AS value FROM events GROUP BY 1",
    "param_loose_init_then_update": f"SELECT event_type AS id, CAST(1000 * length(event_type) + sum(v) AS BIGINT) AS value FROM ({_PUSH}) GROUP BY event_type",
    "param_loose_init": f"SELECT event_type AS id, CAST(1000 * length(event_type) + sum(CASE WHEN rn > 1 THEN v ELSE 0 END) AS BIGINT) AS value FROM ({_PUSH}) GROUP BY event_type",
    "param_loose_delta": f"SELECT event_type AS id, CAST(sum(v) AS BIGINT) AS value FROM ({_PUSH}) GROUP BY event_type",
    "param_model_load": "SELECT event_type AS id, CAST(20 * length(event_type) + count(*) AS BIGINT) AS value FROM events GROUP BY event_type",
    "param_double_model_load": """SELECT event_id, user_value, type_value FROM events
        JOIN (SELECT user_id, count(*) AS user_value FROM events GROUP BY 1) USING (user_id)
        JOIN (SELECT event_type, CAST(sum(floor(value)) AS BIGINT) AS type_value FROM events GROUP BY 1) USING (event_type)""",
    "param_pulled_only": """SELECT id, CAST(max(n) AS BIGINT) AS value FROM (SELECT c_custkey AS id, 0 AS n FROM customer
        UNION ALL SELECT o_custkey, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) GROUP BY id""",
    "param_range_partition": "SELECT l_partkey AS id, CAST(least(l_partkey // CAST(ceil((SELECT max(l_partkey) + 1 FROM lineitem) / 8.0) AS BIGINT), 7) AS INTEGER) AS owner, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY 1",
    "param_hash_partition": "SELECT CAST(l_partkey % 8 AS INTEGER) AS owner, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY 1",
    "param_explicit_logic": "SELECT event_type AS id, list_reduce(list(CAST(trunc(value) AS BIGINT) ORDER BY event_id), lambda a, b: greatest(a // 2, b)) AS value FROM events GROUP BY 1",
    "lock_serial_updates": "SELECT event_id AS seq, event_type AS id, CAST(sum(trunc(value)) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS value FROM events",
    "tweet_reader": f"""SELECT doc_id, array_to_string(k, ' ') AS words FROM (SELECT doc_id,
        list_filter(string_split(lower(text), ' '), lambda x: x IN ({", ".join(f"'{k}'" for k in KEEP)})) AS k FROM documents) WHERE len(k) > 0""",
    "time_slot": f"SELECT CAST(trunc((floor(epoch(ts)) - {START}) / 86400.0) AS INTEGER) AS slot, count(*) AS n FROM events GROUP BY 1",
    "tweet_reader_slotted": f"""SELECT CAST(trunc((floor(epoch(ts)) - {START + 86_400}) / 21600.0) AS INTEGER) AS slot, event_type AS word, count(*) AS n
        FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2""",
    "time_split": """SELECT user_id, count(*) AS n, CASE WHEN d < 10 THEN 'train' ELSE 'test' END AS part FROM (
        SELECT user_id, floor((floor(epoch(ts)) - floor(epoch((SELECT min(ts) FROM events)))) / 86400) AS d FROM events) WHERE d < 15 GROUP BY user_id, part""",
    "factor_text": "SELECT vec_id AS id, 64 AS n, round(list_sum(list_transform(embedding, lambda v, k: v::DOUBLE * k)), 4) AS weighted FROM embeddings",
    "user_activity_quantiles": """SELECT round(quantile_cont(n, 0.1), 6) AS q10, round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS q50, round(quantile_cont(n, 0.75), 6) AS q75, round(quantile_cont(n, 0.9), 6) AS q90
        FROM (SELECT count(*) AS n FROM events GROUP BY user_id)""",
}
