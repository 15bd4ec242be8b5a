import pytest

from paramspark.operators.logic import CombiningSender, CountTrigger, LockServer, PullLimiter, RangeServer, Server, TimerTrigger

add = lambda a, b: a + b


def test_server_inits_on_pull_and_emits_pushes():
    s = Server(lambda i: 0, add)
    assert s.pull(42) == 0
    assert s.push(42, 23) == [(42, 23)]


@pytest.mark.parametrize(("first", "value"), [("delta", 5), ("init", 100), ("init_then_update", 105)])
def test_first_push(first, value):
    assert Server(lambda i: 100, add, on_first_push=first).push("x", 5) == [("x", value)]


def test_emit_at_close_includes_pulled_only():
    s = Server(lambda i: 7, add, emit="close")
    s.pull(1)
    assert s.push(2, 3) == []
    assert s.close() == [(1, 7), (2, 3)]


def test_range_server():
    s = RangeServer(10, 5, lambda i: 0, add)
    s.push(12, 4)
    assert s.pull(14) == 0
    assert s.close() == [(12, 4), (14, 0)]
    with pytest.raises(IndexError):
        s.pull(15)


def locked(**options):
    return LockServer(lambda i: 0, add, **options)


def test_push_first_raises():
    with pytest.raises(RuntimeError):
        locked().push(42, 1)


def test_lock_queues_and_hands_over():
    s = locked()
    assert s.pull(42, 42) == [(42, 0, 42)]
    assert s.pull(42, 43) == [] and s.pull(42, 43) == []
    assert len(s.waiting[42]) == 2
    assert s.push(42, 23) == ((42, 23), [(42, 23, 43)])
    assert s.push(42, 1) == ((42, 24), [(42, 24, 43)])
    assert s.push(42, 1) == ((42, 25), [])
    assert s.pull(42, 1) == [(42, 25, 1)]


def test_lock_once_per_worker():
    s = locked(once_per_worker=True)
    s.pull(42, 42), s.pull(42, 43), s.pull(42, 43)
    assert len(s.waiting[42]) == 1


def test_limiter():
    sent = []
    limiter = PullLimiter(sent.append, 10)
    for i in range(20):
        limiter.pull(i)
    assert len(sent) == 10
    for _ in range(5):
        limiter.answered()
    assert len(sent) == 15
    limiter.pull(20)
    assert len(sent) == 15
    for _ in range(16):
        limiter.answered()
    assert len(sent) == 21 and sent == sorted(sent)


def test_count_sender():
    out = []
    s = CombiningSender(out.append, [CountTrigger(3)])
    for i in range(7):
        s.add(i)
    assert out == [[0, 1, 2], [3, 4, 5]]


def test_timer_sender():
    out = []
    s = CombiningSender(out.append, [TimerTrigger(5)])
    s.add("a", 1)
    s.tick(4.9)
    assert out == []
    s.tick(5)
    s.tick(20)
    assert out == [["a"]]


def test_or_and_and():
    either, both = [], []
    s = CombiningSender(either.append, [CountTrigger(5), TimerTrigger(5)], any)
    t = CombiningSender(both.append, [CountTrigger(5), TimerTrigger(5)], all)
    for i in range(5):
        s.add(i, 0), t.add(i, 0)
    assert either == [[0, 1, 2, 3, 4]] and both == []
    t.add(5, 6)
    assert both == [[0, 1, 2, 3, 4, 5]]


def test_what_waits_does_not_grow_with_the_input(spark, monkeypatch):
    """A worker gets new rows when the pulls of those before have been sent: its state is as large for five times the rounds."""
    from pyspark.sql import functions as F

    from paramspark.plans import workers as W
    from paramspark.registry.workers import PullThenPush

    states, real = [], W.materialize

    def materialize(df, name, **options):
        found = real(df, name, **options)
        if name == "workers":
            states.append(found.where("kind = 'state'").agg(F.max(F.length("payload"))).first()[0])
        return found

    monkeypatch.setattr(W, "materialize", materialize)
    largest = []
    for n in (400, 2000):
        states.clear()
        data = spark.range(n).select((F.col("id") % 3).alias("id"), F.col("id").alias("seq"))
        server = lambda: W.Simple(lambda _: 0, lambda a, b: a + b, emit="close")
        found = W.run_workers(data, PullThenPush, server, order="seq", output="id bigint, value bigint", emitted="id bigint, value bigint", workers=1, servers=1, limit=100, rows_a_round=200)
        assert sum(r["value"] for r in found.servers.collect()) == n
        largest.append(max(states))
    assert largest[1] <= 1.2 * largest[0], largest
