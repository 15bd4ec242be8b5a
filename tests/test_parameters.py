import gc
import random

import pandas as pd
from pyspark.sql import functions as F

from paramspark.operators import parameters as P
from paramspark.operators.logic import Server
from paramspark.plans.iterate import run_bsp, run_sequential


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_word_count(spark):
    words = spark.createDataFrame([(w,) for w in "a b a c b a".split()], "word string").withColumn("one", F.lit(1))
    assert rows(P.push(words, id="word", delta="one")) == {("a", 3), ("b", 2), ("c", 1)}


def test_every_push(spark):
    data = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 1)], "n int, id string, d int")
    assert rows(P.push(data, id="id", delta="d", order="n", emit="every", init=F.lit(10))) == {(1, "a", 15), (2, "a", 22), (3, "b", 11)}


def test_model_load_ints_and_strings(spark):
    for name in (lambda i: i, lambda i: f"id{i}"):
        kind = "int" if name(0) == 0 else "string"
        model = spark.createDataFrame([(name(i), 10 * i) for i in range(50)], f"id {kind}, value int")
        pushes = spark.createDataFrame([(name(i % 50), 1) for i in range(150)], f"id {kind}, delta int")
        assert rows(P.load_model(model, pushes)) == {(name(i), 10 * i + 3) for i in range(50)}


def test_owners(spark):
    df = spark.createDataFrame([(-5,), (0,), (7,), (9,)], "id int")
    assert [r[0] for r in df.select(P.hash_owner(F.col("id"), 4)).collect()] == [3, 0, 3, 1]
    assert [r[0] for r in df.select(P.range_owner(F.col("id"), 10, 3)).collect()] == [1, 0, 1, 2]
    assert [r[0] for r in df.select(P.range_owner(F.col("id") + 95, 10, 3)).collect()] == [2, 2, 2, 2]


def test_explicit_logic_equals_sum(spark):
    class Logic:
        def __init__(self):
            self.s = Server(lambda i: 0, lambda a, b: a + b, emit="close")

        def on_push(self, id, row):
            return self.s.push(id, row.d)

        def close(self, id):
            return self.s.close()

    data = spark.createDataFrame([(i, i % 3, i) for i in range(30)], "n int, id int, d int")
    got = P.transform(data, id="id", order="n", logic=Logic, output="id int, value bigint")
    assert rows(got) == rows(P.push(data, id="id", delta="d"))


def test_explicit_logic_holds_a_batch_of_an_id(spark):
    """Ids longer and shorter than a batch, one of them null: pushes come in order, and what Python holds does not grow with an id's rows."""

    class Logic:
        def __init__(self):
            self.seen, self.sum, self.most = 0, 0, 0

        def on_push(self, id, row):
            self.seen, self.sum = self.seen + 1, (7 * self.sum + row.d) % 1_000_003
            if self.seen % 1000 == 0:
                self.most = max(self.most, *(len(x) for x in gc.get_objects() if isinstance(x, pd.DataFrame)))
            yield (row.n, id, self.sum, 0)

        def close(self, id):
            yield (-1, id, self.sum, self.most)

    ids = [2**60 + 1] * 12_000 + [2**60] * 700 + [None] * 1500 + list(range(40))
    random.Random(1).shuffle(ids)
    pushes = [(n, id, n % 97) for n, id in enumerate(ids)]
    want, sums = set(), {}
    for n, id, d in pushes:
        sums[id] = (7 * sums.get(id, 0) + d) % 1_000_003
        want.add((n, id, sums[id]))
    random.Random(2).shuffle(pushes)
    data = spark.createDataFrame(pushes, "n int, id bigint, d int").repartition(8)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, 500)
    try:
        got = P.transform(data, id="id", order="n", logic=Logic, output="n int, id bigint, value bigint, most int").collect()
    finally:
        spark.conf.set(name, usual)
    assert {tuple(r)[:3] for r in got if r["n"] >= 0} == want
    assert {r["id"]: r["value"] for r in got if r["n"] < 0} == sums
    assert 0 < max(r["most"] for r in got) <= 1000


def test_vector_parameters(spark):
    from paramspark.functions.vectors import sum_vectors

    ids = [1, 2, 2, 3, 5, 4, 5, 1]
    data = spark.createDataFrame([(i, [float(i + k) for k in range(5)]) for i in ids], "id int, vec array<double>")
    got = {r["id"]: r["v"] for r in data.groupBy("id").agg(sum_vectors("vec", 5).alias("v")).collect()}
    assert got == {i: [ids.count(i) * float(i + k) for k in range(5)] for i in set(ids)}


def test_sequential_equals_fold(spark):
    class Running:
        def __init__(self):
            self.total = 0

        def on_row(self, row):
            self.total = self.total * 2 + row.x
            yield (row.n, self.total)

        def close(self):
            yield (-1, self.total)

    data = spark.createDataFrame([(i, i % 4) for i in range(20)], "n int, x int").repartition(3)
    total, want = 0, set()
    for i in range(20):
        total = total * 2 + i % 4
        want.add((i, total))
    assert rows(run_sequential(data, "n", Running, "n bigint, total bigint")) == want | {(-1, total)}


def test_bsp_rounds(spark):
    params = spark.createDataFrame([(1, 1.0)], "id int, value double")
    assert rows(run_bsp(params, lambda p, i: p.withColumn("value", F.col("value") * 2 + i), 3)) == {(1, 12.0)}


def test_end_of_input_comes_once_to_each_worker(spark):
    from paramspark.operators.flow import delayed, flat_map_with_end

    class Sum:
        def __init__(self):
            self.total = 0

        def on_row(self, row):
            self.total += row.x
            return []

        def on_end(self):
            yield (1, self.total)

    data = spark.createDataFrame([(s, s) for s in range(7) for _ in range(5)], "source int, x int")
    got = flat_map_with_end(data, Sum, "ends int, total int", key="source", parts=4).collect()
    assert len(got) == 4 and sum(r["ends"] for r in got) == 4 and sum(r["total"] for r in got) == sum(range(7)) * 5
    import time

    began = time.time()
    assert delayed(data.coalesce(1), 1.0).count() == 35 and time.time() - began >= 0.9


def test_numbers_follow_the_order(spark):
    from paramspark.plans.numbering import numbered

    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("x")).repartition(7)
    got = [(r["x"], r["k"]) for r in numbered(df, [F.desc("x")], "k").collect()]
    assert sorted(got, reverse=True) == [(x, k) for k, x in enumerate(sorted((x for x, _ in got), reverse=True))]
