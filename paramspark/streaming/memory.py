"""User memory as keyed streaming state: the last items of each user, left out of the lists that come for them.

An event of a user meets the user's items before it and then becomes one of them; the state of a user is a list of at most ``memory`` items
(repeats hold places of their own) that expires after ``ttl_ms`` without an event. Micro-batches are taken in the order of ``order``, which must not
go back from one to the next for a user; within one, events are ordered. Rows equal those of ``topk.recent_items`` over the whole table.

Edge cases: a null user is a user like others; events that tie in ``order`` are taken by item; a list of no candidates gives no rows; ``memory`` 0 keeps
nothing. A memory without bound is a batch question (``topk.recent_items``): as state it would grow for ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


#: The key of a null user; state has no null keys. Other keys are the user as text behind a letter.
_NOBODY = "n"


class UserMemory(StatefulProcessor):
    """Rows (user, order, item[, candidates]): with ``k`` the ``k`` best candidates (item, score) that are not in memory, else the memory itself."""

    def __init__(self, memory: int, k: int = 0, ttl_ms: int | None = None):
        if memory < 0:
            raise ValueError("a streamed memory has a bound")
        self.memory, self.k, self.ttl_ms = memory, k, ttl_ms

    def init(self, handle) -> None:
        self.items = handle.getValueState("items", "items array<bigint>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = list(self.items.get()[0]) if self.items.exists() else []
        events = pd.concat(list(rows)).sort_values(["order", "item"], kind="stable")
        out = []
        for event in events.itertuples(index=False):
            if not self.k:
                out.append((event.order, None if key[0] == _NOBODY else key[0][1:], event.item, sorted(set(seen))))
            elif event.candidates is not None:
                known = set(seen)
                best = sorted((-c["score"], c["item"]) for c in event.candidates if c["item"] not in known)[: self.k]
                out += [(event.order, None if key[0] == _NOBODY else key[0][1:], rank + 1, item, -score) for rank, (score, item) in enumerate(best)]
            seen = (seen + [event.item])[-self.memory :] if self.memory else []
        self.items.update(([int(x) for x in seen],))
        names = ["order", "user", "rank", "item", "score"] if self.k else ["order", "user", "item", "recent"]
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def _by_user(events: DataFrame, user: str, processor: UserMemory, columns: dict[str, tuple[str, str]], output: str) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("u"), F.col(user).cast("string")), F.lit(_NOBODY)).alias("key")
    rows = events.select(key, *(F.col(name).cast(kind).alias(to) for to, (name, kind) in columns.items()))
    found = rows.groupBy("key").transformWithStateInPandas(processor, f"order bigint, user string, {output}", "Append", "None")
    return found.withColumn("user", F.col("user").cast(events.schema[user].dataType))


def remembered(events: DataFrame, *, user: str, item: str, order: str, memory: int, ttl_ms: int | None = None) -> DataFrame:
    """(order, user, item, recent): each event of a stream with the distinct items of its user's last ``memory`` events before it."""
    columns = {"item": (item, "bigint"), "order": (order, "bigint")}
    return _by_user(events, user, UserMemory(memory, ttl_ms=ttl_ms), columns, "item bigint, recent array<bigint>")


def recommended(events: DataFrame, *, user: str, item: str, order: str, candidates: str, k: int, memory: int, ttl_ms: int | None = None) -> DataFrame:
    """(order, user, rank, item, score): the ``k`` best of the candidates (item, score) that come with each event of a stream, without the items of the
    user's last ``memory`` events: what is in memory leaves before the cut to ``k``."""
    columns = {"item": (item, "bigint"), "order": (order, "bigint"), "candidates": (candidates, "array<struct<item:bigint,score:double>>")}
    return _by_user(events, user, UserMemory(memory, k, ttl_ms), columns, "rank int, item bigint, score double")
