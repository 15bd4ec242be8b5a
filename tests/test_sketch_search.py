"""The bounded search of additive sketches against all products."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from paramspark.operators import sketches as S


def brute(model, asked, k, parts, score):
    """Every product: [(query, slot, rank, word, score)]."""
    rows = []
    for query, slot in asked:
        q = model.get((query, slot))
        if q is not None:
            ranked = sorted(((score(q, v), w) for (w, s), v in model.items() if s == slot), reverse=True)[:k]
            rows += [(query, slot, i + 1, w, x) for i, (x, w) in enumerate(ranked)]
    return sorted(rows)


def median_score(parts):
    return lambda a, b: round(statistics.median(sum(x * y for x, y in zip(a[i:j], b[i:j], strict=True)) / (j - i) for i, j in parts), 6)


def sketched(rng, words, n, slots=1):
    """Sketches of very unlike lengths, some zero, many that tie."""
    made = {}
    for i in range(words):
        scale = rng.choice([0, 1, 1, 2, 9, 60, 400])
        made[f"w{i}", rng.randrange(slots)] = [rng.randint(-scale, scale) for _ in range(n)]
    return made


def frame(spark, model):
    return spark.createDataFrame([(w, s, v) for (w, s), v in model.items()], "word string, slot int, sums array<bigint>")


@pytest.mark.parametrize("hashes, means, k", [(8, 4, 3), (10, 3, 5), (6, 1, 1), (8, 4, 400)])
@pytest.mark.parametrize("broadcast", [True, False])
def test_search_equals_all_products(spark, monkeypatch, hashes, means, k, broadcast):
    monkeypatch.setattr(S, "SEEDS", 4)
    if not broadcast:
        monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    model = sketched(random.Random(hashes * k), 200, hashes, slots=3)
    parts = S._parts(hashes, means)
    words = sorted({w for w, _ in model})[::9]
    got = S.tow_predict(frame(spark, model), spark.createDataFrame([(w,) for w in words] + [("nobody",), (None,)], "word string"), num_hashes=hashes, num_means=means, k=k, slot=True)
    assert sorted((r["query"], r["slot"], r["rank"], r["word"], r["score"]) for r in got.collect()) == brute(model, [(w, s) for w in words for s in range(3)], k, parts, median_score(parts))


def test_most_words_leave_before_the_product(spark, monkeypatch):
    """A corpus has few long sketches; the products that are taken are counted."""
    monkeypatch.setattr(S, "SEEDS", 16)
    rng = random.Random(5)
    model = {(f"w{i}", 0): [round(rng.gauss(0, 1 + 3000 / (i + 1))) for _ in range(8)] for i in range(1500)}
    table = frame(spark, model)
    own = table.where("word IN ('w0', 'w3', 'w40')").select(F.col("word").alias("query"), "slot", F.col("sums").alias("q"))
    parts = S._parts(8, 4)
    pairs = S.bounded_pairs(table, own, k=5, parts=parts, score=S.tow_score(8, 4))
    plan = pairs._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))
    assert pairs.count() < 0.25 * 3 * 1500
    got = S.top_k(pairs, 5, by=["query", "slot"]).select("query", "slot", "rank", "word", "score")
    assert sorted(map(tuple, got.collect())) == brute(model, [("w0", 0), ("w3", 0), ("w40", 0)], 5, parts, median_score(parts))


@pytest.mark.parametrize("words", [24, 400])
def test_many_queries_are_not_broadcast(spark, monkeypatch, words):
    """Spark would broadcast them by their compressed bytes, and with a copy for each salt. With few words these are broadcast instead."""
    monkeypatch.setattr(S, "BROADCAST_BYTES", 40 * 200)
    model = sketched(random.Random(6), words, 8)
    parts = S._parts(8, 4)
    table = frame(spark, {x: v for x, v in model.items()})
    own = table.crossJoin(spark.range(150)).select(F.concat("word", F.lit("-"), "id").alias("query"), "slot", F.col("sums").alias("q"))
    pairs = S.bounded_pairs(table, own, k=3, parts=parts, score=S.tow_score(8, 4))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    build = [x for x in plan.splitlines() if "BroadcastHashJoin" in x]
    assert len(build) == (words == 24) and all("BuildRight" in x for x in build)
    got = S.top_k(pairs, 3, by=["query", "slot"]).where("query LIKE '%-7'").select("query", "slot", "rank", "word", "score")
    want = brute(model, sorted(model), 3, parts, median_score(parts))
    assert sorted((r["query"].removesuffix("-7"), *r[1:]) for r in got.collect()) == want


def test_dot_products_and_unknown_words(spark, monkeypatch):
    monkeypatch.setattr(S, "SEEDS", 2)
    model = {(w, 0): v for (w, _), v in sketched(random.Random(1), 60, 5).items()}
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    asked = spark.createDataFrame([("w3",), ("w3",), ("w7",), ("nobody",)], "word string")
    got = S.additive_top(frame(spark, model).drop("slot"), asked, k=4)
    last = sorted((w for w, _ in model), reverse=True)[:4]
    want = [(q, r, w, x) for q, _, r, w, x in brute(model, [("w3", 0), ("w7", 0)], 4, None, score)] + [("nobody", i + 1, w, 0) for i, w in enumerate(last)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_products_compile(spark):
    """Sketches of unlike sizes too: a place that one lacks counts as zero."""
    model = spark.createDataFrame([("a", [1, 2, 3]), ("b", [4, 5]), ("c", [-1, 7, 2])], "word string, sums array<bigint>")
    found = S.additive_top(model, spark.createDataFrame([("a",), ("b",)], "word string"), k=3)
    assert "lambdafunction(" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("a", 1, "c", 19), ("a", 2, "b", 14), ("a", 3, "a", 14), ("b", 1, "b", 41), ("b", 2, "c", 31), ("b", 3, "a", 14)]


def test_a_query_asks_in_its_slot_only(spark):
    model = sketched(random.Random(2), 40, 8, slots=2)
    asked = [*[x for x in sorted(model) if x[1] == 1][:5], ("w0", 7), ("nobody", 0)]
    got = S.tow_answers(frame(spark, model), spark.createDataFrame(asked + asked[:2], "word string, slot int"), num_hashes=8, num_means=4, k=3)
    parts = S._parts(8, 4)
    assert sorted(map(tuple, got.collect())) == brute(model, asked, 3, parts, median_score(parts))


def test_empty_tables(spark):
    model, asked = frame(spark, {}), spark.createDataFrame([("a",)], "word string")
    assert S.tow_predict(model, asked, num_hashes=8, num_means=4, k=3).count() == 0
    some = frame(spark, {("a", 0): [1] * 8})
    assert S.tow_predict(some, asked.limit(0), num_hashes=8, num_means=4, k=3).count() == 0
    assert [tuple(r) for r in S.tow_predict(some, asked, num_hashes=8, num_means=4, k=3).collect()] == [("a", 1, "a", 1.0)]


@pytest.mark.parametrize("hashes, means, k", [(8, 4, 3), (10, 3, 5), (6, 1, 1), (7, 7, 2), (8, 4, 400)])
def test_matrices_equal_all_products(spark, monkeypatch, hashes, means, k):
    for name, n in (("SEEDS", 4), ("MANY_PAIRS", 0), ("CELL_WORDS", 30), ("CELL_QUERIES", 7), ("BLOCK", 64)):
        monkeypatch.setattr(S, name, n)
    model = sketched(random.Random(hashes + k), 300, hashes, slots=3)
    parts = S._parts(hashes, means)
    words = sorted({w for w, _ in model})[::5]
    got = S.tow_predict(frame(spark, model), spark.createDataFrame([(w,) for w in words], "word string"), num_hashes=hashes, num_means=means, k=k, slot=True)
    assert sorted((r["query"], r["slot"], r["rank"], r["word"], r["score"]) for r in got.collect()) == brute(model, [(w, s) for w in words for s in range(3)], k, parts, median_score(parts))


def test_many_pairs_leave_a_few_rows_a_query(spark, monkeypatch):
    """Words much alike, which no length leaves out: the best of a cell come out, not a row for each pair."""
    monkeypatch.setattr(S, "MANY_PAIRS", 1000, raising=False)
    rng = random.Random(8)
    model = {(f"w{i}", 0): [rng.choice([-1, 1]) * 5 for _ in range(8)] for i in range(600)}
    parts = S._parts(8, 4)
    table = frame(spark, model)
    own = table.where("word < 'w2'").select(F.col("word").alias("query"), "slot", F.col("sums").alias("q"))
    pairs = S.bounded_pairs(table, own, k=3, parts=parts, score=S.tow_score(8, 4))
    assert pairs.count() <= 3 * own.count()
    got = S.top_k(pairs, 3, by=["query", "slot"]).select("query", "slot", "rank", "word", "score")
    assert sorted(map(tuple, got.collect())) == brute(model, [(r["query"], 0) for r in own.collect()], 3, parts, median_score(parts))


def test_matrices_are_exact_for_long_sketches():
    rng = random.Random(2)
    a, b = ([[rng.randint(-(1 << 27), 1 << 27) for _ in range(8)] for _ in range(n)] for n in (5, 40))
    parts = S._parts(8, 4)
    i, j, score = S._best_of_cell(S.np.array(a), S.np.array(b), S.np.full(5, -S.np.inf), 40, parts)
    exact = lambda x, y: statistics.median(sum(p * q for p, q in zip(x[s:t], y[s:t], strict=True)) / (t - s) for s, t in parts)
    assert sorted(zip(i.tolist(), j.tolist(), score.tolist(), strict=True)) == sorted((m, n, exact(x, y)) for m, x in enumerate(a) for n, y in enumerate(b))
    with pytest.raises(OverflowError):
        S._best_of_cell(S.np.array(a) << 10, S.np.array(b) << 10, S.np.full(5, -S.np.inf), 3, parts)
