"""Single-threaded server and client logic: the semantics of pulls, pushes, locks, limits and message batching.

On a cluster pulls are joins and pushes are aggregations (``parameters``, ``plans.iterate``); these classes state what a server or
a client does with one message at a time, for exact folds and for tests.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable
from typing import Any


class Server:
    """Values by id. ``on_first_push``: what a push to an unseen id stores ('delta', 'init' or 'init_then_update'); ``emit``: every push or at close."""

    def __init__(self, init: Callable[[Any], Any], update: Callable[[Any, Any], Any], *, on_first_push: str = "delta", emit: str = "every", store: Callable[[Any], Any] = lambda d: d):
        self.init, self.update, self.first, self.emit, self.store = init, update, on_first_push, emit, store
        self.values: dict[Any, Any] = {}

    def pull(self, id: Any) -> Any:  # noqa: A002
        return self.values.setdefault(id, self.init(id))

    def push(self, id: Any, delta: Any) -> list[tuple[Any, Any]]:  # noqa: A002
        if id in self.values:
            self.values[id] = self.update(self.values[id], delta)
        elif self.first == "delta":
            self.values[id] = self.store(delta)
        else:
            self.values[id] = self.init(id)
            if self.first == "init_then_update":
                self.values[id] = self.update(self.values[id], delta)
        return [(id, self.values[id])] if self.emit == "every" else []

    def close(self) -> list[tuple[Any, Any]]:
        return sorted(self.values.items()) if self.emit == "close" else []


class RangeServer(Server):
    """A server for the ids of one range, kept as a list; emits touched ids at close."""

    def __init__(self, first: int, size: int, init: Callable[[int], Any], update: Callable[[Any, Any], Any]):
        super().__init__(init, update, emit="close")
        self.range = range(first, first + size)

    def _own(self, id: int) -> int:  # noqa: A002
        if id not in self.range:
            raise IndexError(f"id {id} is outside of {self.range}")
        return id

    def pull(self, id: int) -> Any:  # noqa: A002
        return super().pull(self._own(id))

    def push(self, id: int, delta: Any) -> list[tuple[Any, Any]]:  # noqa: A002
        return super().push(self._own(id), delta)


class LockServer:
    """A pull locks its id until a push; other pulls wait in order. ``once_per_worker``: a worker waits for an id once at most."""

    def __init__(self, init: Callable[[Any], Any], update: Callable[[Any, Any], Any], *, once_per_worker: bool = False):
        self.init, self.update, self.once = init, update, once_per_worker
        self.values: dict[Any, Any] = {}
        self.waiting: dict[Any, deque] = {}
        self.locked: set[Any] = set()

    def pull(self, id: Any, worker: Any) -> list[tuple[Any, Any, Any]]:  # noqa: A002
        """Answers (id, value, worker): none if the id is locked."""
        value = self.values.setdefault(id, self.init(id))
        queue = self.waiting.setdefault(id, deque())
        if id in self.locked:
            if not (self.once and worker in queue):
                queue.append(worker)
            return []
        self.locked.add(id)
        return [(id, value, worker)]

    def push(self, id: Any, delta: Any) -> tuple[tuple[Any, Any], list[tuple[Any, Any, Any]]]:  # noqa: A002
        """The new value, and the answer to the next one that waits."""
        if id not in self.values:
            raise RuntimeError(f"push to id {id}, which nobody pulled")
        self.values[id] = self.update(self.values[id], delta)
        if queue := self.waiting[id]:
            return (id, self.values[id]), [(id, self.values[id], queue.popleft())]
        self.locked.discard(id)
        return (id, self.values[id]), []


class PullLimiter:
    """Lets ``limit`` unanswered pulls through; others wait, and each answer lets one go."""

    def __init__(self, send: Callable[[Any], None], limit: int):
        self.send, self.limit, self.open, self.queue = send, limit, 0, deque()

    def pull(self, id: Any) -> None:  # noqa: A002
        if self.open < self.limit:
            self.open += 1
            self.send(id)
        else:
            self.queue.append(id)

    def answered(self) -> None:
        self.open -= 1
        if self.queue:
            self.pull(self.queue.popleft())


class CountTrigger:
    """Fires at ``most`` messages."""

    def __init__(self, most: int):
        self.most, self.n = most, 0

    def seen(self) -> None:
        self.n += 1

    def fires(self, now: float) -> bool:
        return self.n >= self.most

    def reset(self, now: float) -> None:
        self.n = 0


class TimerTrigger:
    """Fires ``seconds`` after the last sending."""

    def __init__(self, seconds: float, now: float = 0.0):
        self.seconds, self.since = seconds, now

    def seen(self) -> None:
        pass

    def fires(self, now: float) -> bool:
        return now - self.since >= self.seconds

    def reset(self, now: float) -> None:
        self.since = now


class CombiningSender:
    """Buffers messages until a condition over its triggers holds (``any`` or ``all`` of them, or one's own), then sends them as one list."""

    def __init__(self, send: Callable[[list], None], triggers: Iterable[Any], condition: Callable[[Iterable[bool]], bool] = any):
        self.send, self.triggers, self.condition, self.buffer = send, list(triggers), condition, []

    def add(self, message: Any, now: float = 0.0) -> None:
        self.buffer.append(message)
        for t in self.triggers:
            t.seen()
        self.tick(now)

    def tick(self, now: float) -> None:
        if self.buffer and self.condition([t.fires(now) for t in self.triggers]):
            out, self.buffer = self.buffer, []
            for t in self.triggers:
                t.reset(now)
            self.send(out)
