"""Worker and server logic of the user's own, run over partitions in rounds.

Workers hold a part of the data each and may pull a parameter, push a change to it and put out rows; servers hold the parameters of
the ids that they own. A round delivers all answers and some rows to the workers, and then all pulls and pushes to the servers; both
sides are grouped maps, so messages are rows of a shuffle, and what objects know is written to the shared folder between rounds,
where it survives lost executors. Messages to one receiver travel as lists. Everything is delivered in a fixed order, so results
repeat. A worker's limit of open pulls holds back the others until answers come.

A worker logic has ``on_recv(row, client)``, ``on_pull(id, value, client)`` and ``close(client)``; a server logic ``on_pull(id, worker, ps)``,
``on_push(id, delta, worker, ps)``, ``load(id, value)`` and ``close(ps)``. Whatever a partition holds must fit in one task, as keyed state must:
choose ``workers``, ``servers`` and ``rows_a_round`` accordingly. A worker with a ``limit`` gets new rows only in every so many rounds as it needs to send
the pulls of the rows before (if a row pulls once), so that what waits does not grow with the input. Where an update is an aggregate, ``operators.parameters`` needs no rounds.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from types import SimpleNamespace
from typing import Any, NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.logic import CombiningSender, CountTrigger, LockServer, PullLimiter, Server
from .storage import materialize

_MESSAGES = "place int, kind string, n bigint, payload binary"


class Outputs(NamedTuple):
    """What workers and what servers put out."""

    workers: DataFrame
    servers: DataFrame


def hash_owner(id: Any, servers: int) -> int:  # noqa: A002
    """The same on every machine, never negative."""
    return id % servers if isinstance(id, int) else zlib.crc32(str(id).encode()) % servers


def range_owner(size: int) -> Callable[[int, int], int]:
    """Owners by equal ranges of ``size`` ids."""
    return lambda id, servers: min(servers - 1, abs(id) // -(-size // servers))  # noqa: A006


class Client:
    """A worker's way to the parameters."""

    def __init__(self, limit: int | None):
        self.sent: list[tuple] = []
        self.outputs: list[tuple] = []
        self.then: dict[Any, deque] = defaultdict(deque)
        self.limiter = PullLimiter(self._send_pull, limit) if limit else None

    def _send_pull(self, id: Any) -> None:  # noqa: A002
        self.sent.append(("pull", id, None))

    def pull(self, id: Any, then: Callable[[Any, Client], None] | None = None) -> None:  # noqa: A002
        """Asks for a value: ``then(value, client)`` or else the logic's ``on_pull`` gets the answer, in the order of the pulls of an id."""
        self.then[id].append(then)
        self.limiter.pull(id) if self.limiter else self._send_pull(id)

    def push(self, id: Any, delta: Any) -> None:  # noqa: A002
        self.sent.append(("push", id, delta))

    def output(self, *row: Any) -> None:
        self.outputs.append(row)

    def _answered(self, id: Any, value: Any, logic: Any) -> None:  # noqa: A002
        if self.limiter:
            self.limiter.answered()
        then = self.then[id].popleft() if self.then[id] else None
        if not self.then[id]:
            del self.then[id]
        then(value, self) if then else logic.on_pull(id, value, self)


class Ps:
    """A server's way to the workers."""

    def __init__(self) -> None:
        self.sent: list[tuple] = []
        self.outputs: list[tuple] = []

    def answer(self, id: Any, value: Any, worker: int) -> None:  # noqa: A002
        self.sent.append((worker, id, value))

    def output(self, *row: Any) -> None:
        self.outputs.append(row)


class Simple:
    """A server over ``operators.logic.Server``: values by an initial value and an update, put out at every push or at the close."""

    def __init__(self, init: Callable[[Any], Any], update: Callable[[Any, Any], Any], **options: Any):
        self.server = Server(init, update, **options)

    def load(self, id: Any, value: Any) -> None:  # noqa: A002
        self.server.push(id, value)

    def on_pull(self, id: Any, worker: int, ps: Ps) -> None:  # noqa: A002
        ps.answer(id, self.server.pull(id), worker)

    def on_push(self, id: Any, delta: Any, worker: int, ps: Ps) -> None:  # noqa: A002
        for row in self.server.push(id, delta):
            ps.output(*row)

    def close(self, ps: Ps) -> None:
        for row in self.server.close():
            ps.output(*row)


class Locking:
    """A server over ``operators.logic.LockServer``: a pull keeps its id until a push, other workers wait their turn."""

    def __init__(self, init: Callable[[Any], Any], update: Callable[[Any, Any], Any], **options: Any):
        self.server = LockServer(init, update, **options)

    def load(self, id: Any, value: Any) -> None:  # noqa: A002
        self.server.values[id] = value

    def on_pull(self, id: Any, worker: int, ps: Ps) -> None:  # noqa: A002
        for answer in self.server.pull(id, worker):
            ps.answer(*answer)

    def on_push(self, id: Any, delta: Any, worker: int, ps: Ps) -> None:  # noqa: A002
        row, answers = self.server.push(id, delta)
        ps.output(*row)
        for answer in answers:
            ps.answer(*answer)

    def close(self, ps: Ps) -> None:
        pass


def _rows(kinds: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(kinds, columns=["place", "kind", "n", "payload"])


def _letters(messages: Iterator[tuple[int, Any]], batch: int) -> list[tuple]:
    """Message rows: lists of at most ``batch`` messages to one receiver, in order."""
    out: list[tuple] = []
    senders: dict[int, CombiningSender] = {}
    for place, message in messages:
        if place not in senders:
            senders[place] = CombiningSender(lambda many, place=place: out.append((place, "to", len(out), cloudpickle.dumps(many))), [CountTrigger(batch)])
        senders[place].add(message)
    for place, sender in senders.items():
        if sender.buffer:
            sender.send(sender.buffer)
    return out


def _inbox(rows: pd.DataFrame) -> tuple[Any, list[Any], list[Any], bool]:
    """The state, the messages, the data rows and whether to close."""
    state, messages, data, close = None, [], [], False
    for kind, payload in rows.sort_values("n", kind="stable")[["kind", "payload"]].itertuples(index=False):
        if kind == "state":
            state = cloudpickle.loads(payload)
        elif kind == "to":
            messages += cloudpickle.loads(payload)
        elif kind == "row":
            data.append(cloudpickle.loads(payload))
        else:
            close = True
    return state, messages, data, close


def _worker_round(worker: Callable[[], Any], limit: int | None, owner: Callable[[Any, int], int], servers: int, batch: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        place = int(key[0])
        state, answers, data, close = _inbox(rows)
        logic, client = state or (worker(), Client(limit))
        for _, id, value in sorted(answers, key=lambda m: m[0]):  # noqa: A001
            client._answered(id, value, logic)
        for row in data:
            logic.on_recv(row, client)
        if close:
            logic.close(client)
        out = _letters(((owner(id, servers), ((place, n), kind, id, delta)) for n, (kind, id, delta) in enumerate(client.sent)), batch)
        out += [(place, "out", n, cloudpickle.dumps(x)) for n, x in enumerate(client.outputs)]
        client.sent, client.outputs = [], []
        if client.limiter:
            client.limiter.send = client._send_pull
        out.append((place, "state", -1, cloudpickle.dumps((logic, client))))
        return _rows(out)

    return run


def _server_round(server: Callable[[], Any], batch: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        place = int(key[0])
        logic, messages, _, close = _inbox(rows)
        logic, ps = logic or server(), Ps()
        for (worker, _), kind, id, delta in sorted(messages, key=lambda m: m[0]):  # noqa: A001
            if kind == "load":
                logic.load(id, delta)
            elif kind == "pull":
                logic.on_pull(id, worker, ps)
            else:
                logic.on_push(id, delta, worker, ps)
        if close:
            logic.close(ps)
        out = _letters(((worker, ((place, n), id, value)) for n, (worker, id, value) in enumerate(ps.sent)), batch)
        out += [(place, "out", n, cloudpickle.dumps(x)) for n, x in enumerate(ps.outputs)]
        out.append((place, "state", -1, cloudpickle.dumps(logic)))
        return _rows(out)

    return run


def run_workers(data: DataFrame, worker: Callable[[], Any], server: Callable[[], Any], *, order: str, output: str, emitted: str, partition: Column | None = None, workers: int = 4, servers: int = 4,
                owner: Callable[[Any, int], int] = hash_owner, model: DataFrame | None = None, limit: int | None = None, rows_a_round: int | None = None, batch: int = 1000) -> Outputs:
    """Runs until no row, answer or message is left, then closes workers and servers. ``output`` and ``emitted`` are the schemas of what workers
    and servers put out; ``partition`` gives a row's worker (default: a hash of the row); ``model`` has rows (id, value) that servers load first."""
    spark = data.sparkSession
    names = data.columns
    place = F.pmod(partition if partition is not None else F.xxhash64(*names), F.lit(workers)).cast("int")
    turn = F.row_number().over(Window.partitionBy("__place").orderBy(order)) - 1
    dealt = data.withColumn("__place", place).withColumn("__turn", turn).withColumn("__round", F.floor(F.col("__turn") / F.lit(rows_a_round)) if rows_a_round else F.lit(0).cast("long"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            held = rows[names].to_dict("records")
            yield pd.DataFrame({"place": rows["__place"], "kind": "row", "n": rows["__turn"], "payload": [cloudpickle.dumps(SimpleNamespace(**x)) for x in held], "round": rows["__round"]})

    inputs = materialize(dealt.mapInPandas(packed, f"{_MESSAGES}, round bigint"), "rows", by="round")
    rounds = (inputs.agg(F.max("round")).first()[0] if names else None) or 0
    nothing = spark.createDataFrame([], _MESSAGES)

    def loads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            own = [(int(i) if hasattr(i, "__index__") else i, v) for i, v in zip(rows["id"], rows["value"].tolist(), strict=True)]
            yield _rows([(owner(i, servers), "to", -1, cloudpickle.dumps([((-1, 0), "load", i, v)])) for i, v in own])

    to_servers = model.mapInPandas(loads, _MESSAGES) if model is not None else nothing
    worker_state = server_state = answers = nothing
    worker_out, server_out = [], []
    pause = max(1, -(-rows_a_round // limit)) if limit and rows_a_round else 1
    number, closing, closed = 0, False, False
    while not closed:
        turn = number // pause
        kept = inputs.where(F.col("round") == turn).drop("round") if number % pause == 0 and turn <= rounds else nothing
        end = spark.range(workers).select(F.col("id").cast("int").alias("place"), F.lit("close").alias("kind"), F.lit(1 << 40).alias("n"), F.lit(None).cast("binary").alias("payload")) if closing else nothing
        met = worker_state.unionByName(answers).unionByName(kept).unionByName(end)
        done = materialize(met.groupBy("place").applyInPandas(_worker_round(worker, limit, owner, servers, batch), _MESSAGES), "workers")
        worker_state, sent = done.where("kind = 'state'"), done.where("kind = 'to'")
        worker_out.append(done.where("kind = 'out'"))
        end = spark.range(servers).select(F.col("id").cast("int").alias("place"), F.lit("close").alias("kind"), F.lit(1 << 40).alias("n"), F.lit(None).cast("binary").alias("payload")) if closing else nothing
        met = server_state.unionByName(sent).unionByName(to_servers).unionByName(end)
        done = materialize(met.groupBy("place").applyInPandas(_server_round(server, batch), _MESSAGES), "servers")
        server_state, answers, to_servers = done.where("kind = 'state'"), done.where("kind = 'to'"), nothing
        server_out.append(done.where("kind = 'out'"))
        number, closed = number + 1, closing
        closing = closing or number > rounds * pause and not answers.take(1)
    return Outputs(_unpacked(worker_out, output), _unpacked(server_out, emitted))


def _unpacked(parts: list[DataFrame], schema: str) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([cloudpickle.loads(x) for x in rows["payload"]], columns=names)

    return every.select("payload").mapInPandas(read, schema)
