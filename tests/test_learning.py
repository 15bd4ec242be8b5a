import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from paramspark.operators import evaluation as E
from paramspark.operators import factorization as M
from paramspark.operators import passive_aggressive as PA
from paramspark.plans.iterate import run_sequential


@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(47)
    u, v = rng.random((20, 3)), rng.random((15, 3))
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 20, 100), rng.integers(0, 15, 100), strict=True)})
    return spark.createDataFrame([(a, b, float(u[a] @ v[b]), i * 37 % len(pairs)) for i, (a, b) in enumerate(pairs)], "user int, item int, rating double, ts bigint").cache()


def test_offline_rmse(rated):
    factors = M.train_offline(rated, size=15, low=0.0, high=0.3, rate=0.5, rounds=5)
    assert E.rmse(M.predict(rated, factors)).first()["rmse"] <= 0.5


def test_training_lowers_the_error(rated):
    few, more = (E.rmse(M.predict(rated, M.train_offline(rated, size=4, low=0.0, high=0.3, rate=0.5, rounds=n))).first()["rmse"] for n in (1, 4))
    assert more < few


def test_one_rating_step_equals_the_exact_learner(spark):
    row = spark.createDataFrame([(1, 2, 1.0, 0)], "user int, item int, rating double, ts bigint")
    users = spark.createDataFrame([(1, [0.1, 0.2])], "id int, vec array<double>")
    items = spark.createDataFrame([(2, [0.3, -0.1])], "id int, vec array<double>")
    for loss in ("squared", "sigmoid"):
        learner = M.OnlineLearner(2, 0.5, loss=loss)
        learner.users[1], learner.items[2] = np.array([0.1, 0.2]), np.array([0.3, -0.1])
        learner.on_row(type("Row", (), dict(user=1, item=2, rating=1.0, ts=0)))
        new = M.sgd_round(row, M.Factors(users, items), size=2, rate=0.5, loss=loss)
        assert new.users.first()["vec"] == pytest.approx(learner.users[1].tolist())
        assert new.items.first()["vec"] == pytest.approx(learner.items[2].tolist())


def test_sequential_prequential_lists(rated):
    got = run_sequential(rated, "ts", lambda: M.OnlineLearner(4, 0.1, k=3, memory=2), "user bigint, item bigint, ts bigint, rank bigint, recommended bigint, score double").collect()
    assert got and max(r["rank"] for r in got) <= 3


def test_negatives_avoid_recent(rated):
    ratings = {(r["user"], r["item"], r["ts"]) for r in rated.collect()}
    by_user = {}
    for u, i, t in sorted(ratings, key=lambda x: x[2]):
        by_user.setdefault(u, []).append((t, i))
    got = M.negative_samples(rated, rate=2, memory=3).collect()
    assert got
    for r in got:
        seen = [i for t, i in by_user[r["user"]] if t <= r["ts"]][-4:]
        assert r["negative"] not in seen


def test_equal_ratings_have_negatives_each(spark):
    rated = spark.createDataFrame([(1, 1, 1.0, 0)] * 2 + [(2, i, 1.0, i) for i in range(1, 30)], "user bigint, item bigint, rating double, ts bigint")
    got = [r["negative"] for r in M.negative_samples(rated, rate=3, memory=20).where("user = 1").collect()]
    assert len(got) == 6 and len(set(got)) == 3 and 1 not in got


def test_online_and_prequential(rated):
    factors = M.train_online(rated, size=4, low=0.0, high=0.3, rate=0.3, batches=3)
    assert factors.users.count() == rated.select("user").distinct().count()
    events = rated.withColumn("event", F.col("ts"))
    lists, _ = M.prequential(events, size=4, rate=0.3, k=3, batches=3, low=0.0, high=0.3, memory=2)
    assert lists.agg(F.max("rank")).first()[0] == 3
    total = E.ndcg_total(E.gains(lists, events)).first()
    assert total["n"] == rated.count() and 0 <= total["ndcg_avg"] <= 1


def test_ndcg_values(spark):
    lists = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 1, 9)], "query int, rank int, item int")
    events = spark.createDataFrame([(1, 8, 0), (2, 1, 90_000)], "event int, item int, ts bigint")
    got = {r["event"]: r["ndcg"] for r in E.gains(lists, events).collect()}
    assert got == {1: pytest.approx(np.log(2) / np.log(3)), 2: 0.0}
    assert {r["period"] for r in E.ndcg_by_period(E.gains(lists, events)).collect()} == {0, 1}


def test_ndcg_lines(spark):
    events = spark.createDataFrame([(1, 8, 0)], "event int, item int, ts bigint")
    lists = spark.createDataFrame([(1, 1, 8)], "query int, rank int, item int")
    gained = E.gains(lists, events)
    assert E.ndcg_lines(gained).first()["value"] == "n: 1, hits: 1, ndcg_sum: 1.0, ndcg_avg: 1.0"
    assert E.ndcg_lines(gained, 10, csv=True).first()["value"] == "0,1,1,1.0"


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(50)
    w = rng.normal(0, 1, 30)
    x = rng.normal(0, 1, (80, 30)) * (rng.random((80, 30)) < 0.4)
    y = np.where(x @ w > 0, 1.0, -1.0)
    features = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(80) for j in range(30) if x[i, j]], "vec int, feature int, x double").cache()
    labels = spark.createDataFrame([(i, float(y[i])) for i in range(80)], "vec int, label double").cache()
    return features, labels, x, y


@pytest.mark.parametrize("variant", PA.VARIANTS)
def test_binary_training_accuracy(separable, variant):
    features, labels, _, _ = separable
    w = PA.train_binary(features, labels, rounds=4, variant=variant, c=1.0)
    answers = PA.binary_predict(features, w).join(labels.select("vec", (F.col("label") > 0).alias("label")), "vec")
    assert E.accuracy(answers).first()["accuracy"] >= 80


@pytest.mark.parametrize("variant", PA.VARIANTS)
def test_exact_learner_and_one_example_round(spark, variant):
    learner = PA.BinaryLearner(variant, 0.3)
    learner.w = {0: 0.5, 1: -0.2}
    delta = learner.learn([0, 1, 2], [1.0, 2.0, -1.0], -1)
    features = spark.createDataFrame([(9, i, v) for i, v in enumerate([1.0, 2.0, -1.0])], "vec int, feature int, x double")
    weights = spark.createDataFrame([(0, 0.5), (1, -0.2)], "feature int, w double")
    got = {r["feature"]: r["w"] for r in PA.binary_round(features, spark.createDataFrame([(9, -1.0)], "vec int, label double"), weights, variant=variant, c=0.3).collect()}
    assert got == {i: pytest.approx(learner.w[i]) for i in range(3)} and len(delta) == 3


def test_offline_job(separable):
    features, labels, _, y = separable
    answers, weights = PA.classify_offline(features, labels, features.where("vec < 20"), rounds=3)
    assert np.mean([r["predicted"] == (y[r["vec"]] > 0) for r in answers.collect()]) >= 0.8 and weights.count() == 30


def test_exact_learner_separates(separable):
    _, _, x, y = separable
    learner = PA.BinaryLearner()
    for _ in range(5):
        for row, label in zip(x, y, strict=True):
            at = np.flatnonzero(row)
            learner.learn(at.tolist(), row[at].tolist(), int(label))
    right = [learner.predict(np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) == (v > 0) for r, v in zip(x, y, strict=True)]
    assert np.mean(right) >= 0.8


def test_no_features_no_step_no_answer(spark):
    features = spark.createDataFrame([(1, 0, 1.0)], "vec int, feature int, x double")
    labels = spark.createDataFrame([(1, 1.0), (2, 1.0)], "vec int, label double")
    w = PA.binary_round(features, labels, PA.zero_weights(features))
    assert [tuple(r) for r in w.collect()] == [(0, 1.0)]
    assert PA.binary_predict(features, w).count() == 1


@pytest.mark.parametrize("method", ["OVA", "PB", "ML"])
def test_multiclass(spark, method):
    rng = np.random.default_rng(2)
    centers = np.eye(3) * 3
    x = [(i, centers[i % 3] + rng.normal(0, 0.3, 3)) for i in range(45)]
    features = spark.createDataFrame([(i, k, float(v[k])) for i, v in x for k in range(3)], "vec int, feature int, x double").cache()
    labels = spark.createDataFrame([(i, i % 3) for i, _ in x], "vec int, label int").cache()
    w = PA.train_multi(features, labels, classes=3, rounds=4, method=method)
    assert E.accuracy(PA.multi_predict(features, w, 3).join(labels, "vec")).first()["accuracy"] >= 80


def test_unknown_variant():
    with pytest.raises(ValueError):
        PA.rate(F.lit(1), F.lit(1), "PA-9", 1.0)


def test_train_and_predict(separable):
    features, labels, _, _ = separable
    mixed = labels.select("vec", F.col("vec").alias("seq"), F.when(F.col("vec") % 4 != 0, F.col("label")).alias("label"))
    got = PA.train_and_predict(mixed, features, batches=3).collect()
    assert {r["vec"] for r in got} == {i for i in range(80) if i % 4 == 0}


def test_sparse_vector():
    a, b = PA.SparseVector(9, {1: 2.0, 3: 4.0}), PA.SparseVector(9, {3: 4, 1: 2})
    assert a == b and hash(a) == hash(b) and a.get(7) == 0 and a.indices == [1, 3] and a.values == [2.0, 4.0] and len(a) == 2
    assert a != PA.SparseVector(8, {1: 2.0, 3: 4.0})


def test_correlations(spark):
    both = spark.createDataFrame([("q", w, float(x), float(y)) for w, x, y in [("a", 1, 1), ("b", 2, 3), ("c", 3, 2), ("d", 4, 4)]], "query string, word string, x double, y double")
    r = E.correlations(both).first()
    assert r["pearson"] == pytest.approx(0.8) and r["spearman"] == pytest.approx(0.8) and r["kendall"] == pytest.approx(2 / 3, abs=1e-6)
    assert E.mean_correlations(E.correlations(both)).first()["n"] == 1


@pytest.mark.parametrize("memory", [0, 2, -1])
def test_prequential_searches_once_for_a_user(spark, monkeypatch, memory):
    """With a bounded memory a search serves all events of a user in a batch; lists are those of a search for each event."""
    from paramspark.operators import topk as K

    rng = np.random.default_rng(6)
    rows = [(n, int(rng.integers(3)), int(rng.integers(8)), 1.0, n) for n in range(60)]
    events = spark.createDataFrame(rows, "event bigint, user bigint, item bigint, rating double, ts bigint")
    asked, real = [], K.top_items

    def top_items(queries, items, **options):
        asked.append((queries.count(), {r["id"]: np.array(r["vec"]) for r in items.collect()}, {r["id"]: np.array(r["vec"]) for r in queries.collect()}))
        return real(queries, items, **options)

    monkeypatch.setattr(K, "top_items", top_items)
    lists, _ = M.prequential(events, size=3, rate=0.3, k=3, batches=2, low=0.0, high=0.3, memory=memory)
    n, items, vectors = asked[0]
    assert n == (3 if memory >= 0 else 30)
    got = {}
    for r in lists.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["item"])
    for event, user, *_ in rows[30:]:
        before = [i for _, u, i, *_ in rows[:event] if u == user]
        recent = set(before if memory < 0 else before[len(before) - memory :] if memory else [])
        q = vectors[user if memory >= 0 else event]
        best = sorted((-round(float(v @ q), 6), i) for i, v in items.items() if i not in recent)[:3]
        assert got.get(event, []) == [i for _, i in best]


def moved(spark, run):
    """Bytes that ``run`` writes to shuffles, by Spark's own count."""
    context = spark.sparkContext._jsc.sc()

    def total():
        time.sleep(0.3)  # the counts are brought up to date by the next task
        spark.range(1).count()
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    run()
    return total() - before


@pytest.mark.parametrize("how", ["mean", "sum"])
@pytest.mark.parametrize("loss", ["squared", "sigmoid"])
def test_rounds_in_parts_are_rounds(rated, monkeypatch, how, loss):
    """Parts cut through users; unknown ids, nulls and repeated ratings are as in a round by joins."""
    monkeypatch.setattr(M, "PART_RATINGS", 15)
    ratings = rated.unionByName(rated.limit(5)).unionByName(rated.limit(3).withColumn("rating", F.lit(None).cast("double"))).unionByName(rated.limit(1).withColumn("user", F.lit(99)))
    factors = M.Factors(M.initial(rated, "user", 3, 0.0, 0.3, 0), M.initial(rated, "item", 3, 0.0, 0.3, 1))
    got, want = M.Parts(ratings).round(factors, size=3, rate=0.1, loss=loss, how=how), M.sgd_round(ratings, factors, size=3, rate=0.1, loss=loss, how=how)
    for a, b in zip(got, want, strict=True):
        a, b = ({r["id"]: r["vec"] for r in x.collect()} for x in (a, b))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-12) for k in b)
    assert E.rmse(M.Parts(ratings).predict(factors)).first() == E.rmse(M.predict(ratings, factors)).first()


def test_rounds_do_not_move_a_vector_for_each_rating(spark):
    """Two more rounds over the same ids with ten times the ratings move little more than the ratings."""
    rows = spark.range(40_000).select((F.col("id") % 50).alias("user"), F.expr("id div 50 % 800").alias("item"), F.lit(1.0).alias("rating"), F.col("id").alias("ts"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = (moved(spark, lambda n=n: M.train_offline(rows, size=10, rounds=n)) for n in (1, 3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert many - few < 40_000 * 40, (few, many)


def test_negatives_do_not_multiply_the_ratings(spark):
    """A rating meets the items ahead of it once, not in a row for each."""
    rows = spark.range(40_000).select((F.col("id") % 500).alias("user"), F.expr("id div 500").alias("item"), F.col("id").alias("ts"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bytes_ = moved(spark, lambda: M.negative_samples(rows, rate=2, memory=4).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert bytes_ < 40_000 * 100, bytes_


def test_offline_training_deals_out_ratings_once_and_writes_a_sum_for_each_id(spark, small, monkeypatch):
    """Its prediction reads the parts of the training; sums of steps are added up over the parts before they are written."""
    from paramspark.registry.learning import mf_offline

    made, steps = [], []

    class Counted(M.Parts):
        def __init__(self, ratings):
            made.append(ratings.count())
            super().__init__(ratings)

    def kept(df, name, *rest, real=M.materialize, **more):
        found = real(df, name, *rest, **more)
        if name == "steps":
            steps.append((found.count(), found.select("user", "item").distinct().count()))
        return found

    monkeypatch.setattr(M, "PART_RATINGS", 1000)
    monkeypatch.setattr(M, "Parts", Counted)
    monkeypatch.setattr(M, "materialize", kept)
    mf_offline(spark, small).collect()
    assert len(made) == 1 and made[0] > 3000
    assert len(steps) == 6 and all(rows == ids for rows, ids in steps)


def test_parts_leave_out_ratings_without_factors(spark, monkeypatch):
    """Also where names are texts and a part is cut in several."""
    monkeypatch.setattr(M, "PART_RATINGS", 2)
    rows = [(f"u{a}", f"i{b}", 0.1 * (a + 2 * b)) for a in range(4) for b in range(6)]
    ratings = spark.createDataFrame(rows, "user string, item string, rating double")
    factors = M.Factors(M.initial(ratings.where("user <> 'u1'"), "user", 3, 0.0, 1.0), M.initial(ratings.where("item <> 'i4'"), "item", 3, 0.0, 1.0, 1))
    got, want = M.Parts(ratings).round(factors, size=3, rate=0.1), M.sgd_round(ratings, factors, size=3, rate=0.1)
    for g, w in zip(got, want, strict=True):
        g, w = ({r["id"]: r["vec"] for r in x.collect()} for x in (g, w))
        assert g.keys() == w.keys() and all(abs(x - y) < 1e-12 for i in g for x, y in zip(g[i], w[i], strict=True))
    assert M.Parts(ratings).predict(factors).count() == 15


def test_training_with_negatives_leaves_no_parts_behind(rated):
    """Its rows with negatives, and the parts made of them, are deleted once they are in the factors."""
    from paramspark.plans import storage

    rows = rated.withColumn("ts", F.col("user") + F.col("item"))
    for train, more in ((M.train_offline, {"rounds": 2}), (M.train_online, {"batches": 2})):
        before = set(storage._written)
        train(rows, size=3, negatives=2, memory=2, **more)
        left = [x.rsplit("/", 1)[-1].split("-")[0] for x in set(storage._written) - before]
        assert not {"parts", "links", "ratings", "steps"} & set(left), left
