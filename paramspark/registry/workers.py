"""Worker and server logic of one's own: pulls, answers, pushes, outputs, limits and locks over partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.workers import Client, Locking, Simple, range_owner, run_workers
from .tables import table


class PushVector:
    def on_recv(self, row, client: Client) -> None:
        client.push(row.id, row.vec)

    def on_pull(self, id, value, client) -> None:  # noqa: A002
        raise AssertionError("nothing is pulled")

    def close(self, client) -> None:
        pass


class PullThenPush:
    """Each row pulls its id; each answer is put out and pushes 1."""

    def on_recv(self, row, client: Client) -> None:
        client.pull(row.id)

    def on_pull(self, id, value, client: Client) -> None:  # noqa: A002
        client.output(id, value)
        client.push(id, 1)

    def close(self, client: Client) -> None:
        client.output(None, -1)


class Futures(PullThenPush):
    """The same by a callback with each pull."""

    def on_recv(self, row, client: Client) -> None:
        client.pull(row.id, lambda value, c, id=row.id: (c.output(id, value), c.push(id, 1)))


class Enqueue(PushVector):
    def on_recv(self, row, client: Client) -> None:
        client.push(row.x % 2, [row.x])


VECTORS = [(i, [float(n), 0.5 * n, 1.0, -float(n), 2.0]) for n, i in enumerate((1, 2, 2, 3, 5, 4, 5, 1))]


def vector_push(spark, d):
    data = spark.createDataFrame(VECTORS, "id int, vec array<double>").withColumn("seq", F.monotonically_increasing_id())
    add = lambda a, b: [x + y for x, y in zip(a, b, strict=True)]
    found = run_workers(data, PushVector, lambda: Simple(lambda _: [0.0] * 5, add, emit="close"), order="seq", output="id int", emitted="id int, vec array<double>")
    return found.servers.select("id", F.posexplode("vec").alias("k", "v"))


def int_model(spark, d):
    """A model (i, 10 i) is loaded; every id comes three times and adds 1 each time."""
    model = spark.range(50).select(F.col("id").cast("int").alias("id"), (10 * F.col("id")).alias("value"))
    data = spark.range(150).select((F.col("id") * 7 % 50).cast("int").alias("id"), F.col("id").alias("seq"))
    server = lambda: Simple(lambda _: 0, lambda a, b: a + b, emit="close")
    found = run_workers(data, PullThenPush, server, order="seq", output="id int, value bigint", emitted="id int, value bigint", model=model, owner=range_owner(50), limit=10)
    return found.servers


def parity_queues(spark, d):
    data = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, 5, 6, 7, 9)], "x int")
    found = run_workers(data, Enqueue, lambda: Simple(lambda _: [], lambda a, b: a + b, emit="close"), order="x", output="id int", emitted="id int, items array<int>")
    return found.servers.select("id", F.array_join(F.array_sort("items"), ",").alias("items"))


#: Open pulls of a worker at most; it gets twice as many rows at a time.
OPEN_PULLS = 25_000


def event_counts(logic):
    """Pulls and pushes of each event's type, with the workers' outputs counted. A worker has a third of its rows as open pulls, but at most ``OPEN_PULLS``: more
    events are more rounds, not larger ones."""

    def run(spark, d):
        data = table(spark, d, "events").select(F.col("event_type").alias("id"), F.col("event_id").alias("seq"), "user_id")
        n = min(OPEN_PULLS, max(1, data.count() // (8 * 3)))
        server = lambda: Simple(lambda _: 0, lambda a, b: a + b, emit="close")
        found = run_workers(data, logic, server, order="seq", partition=F.col("user_id"), workers=8, output="id string, value bigint", emitted="id string, value bigint", limit=n, rows_a_round=2 * n)
        answers = found.workers.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("answers"))
        return found.servers.join(answers, "id").select("id", "value", "answers")

    return run


def locks(once: bool):
    """Four workers pull every nation twice; the lock gives a value to one at a time."""

    def run(spark, d):
        nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
        data = nations.select("id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select("id", (F.col("k") % 4).alias("w"), (F.col("k") * 100 + F.col("id")).alias("seq"))
        server = lambda: Locking(lambda _: 0, lambda a, b: a + b, once_per_worker=once)
        found = run_workers(data, PullThenPush, server, order="seq", partition=F.col("w"), output="id bigint, value bigint", emitted="id bigint, value bigint")
        return found.servers

    return run


QUERIES = {
    "ps_vector_push": vector_push,
    "ps_int_model": int_model,
    "ps_parity_queues": parity_queues,
    "ps_pull_then_push": event_counts(PullThenPush),
    "ps_futures": event_counts(Futures),
    "ps_lock_contention": locks(False),
    "ps_lock_once_per_worker": locks(True),
}

_VALUES = ", ".join(f"({i}, [{', '.join(f'{x}::DOUBLE' for x in v)}])" for i, v in VECTORS)
_COUNTS = "SELECT event_type AS id, count(*) AS value, count(*) AS answers FROM events GROUP BY 1"
ORACLE_SQL = {
    "ps_vector_push": f"SELECT id, CAST(k AS INTEGER) AS k, sum(vec[k + 1]) AS v FROM (VALUES {_VALUES}) t(id, vec), unnest(range(0, 5)) AS u(k) GROUP BY 1, 2",
    "ps_int_model": "SELECT CAST(i AS INTEGER) AS id, CAST(10 * i + 3 AS BIGINT) AS value FROM range(0, 50) t(i)",
    "ps_parity_queues": "SELECT x % 2 AS id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS items FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (9)) t(x) GROUP BY 1",
    "ps_pull_then_push": _COUNTS,
    "ps_futures": _COUNTS,
    "ps_lock_contention": "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(k AS BIGINT) AS value FROM nation, range(1, 9) t(k)",
    "ps_lock_once_per_worker": "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(k AS BIGINT) AS value FROM nation, range(1, 6) t(k)",
}
