import numpy as np
from pyspark.sql import functions as F

from paramspark.functions.hashing import portable
from paramspark.operators import evaluation as E
from paramspark.operators import factorization as M
from paramspark.operators import stratified as S


def rated(spark, n=400, users=30, items=20):
    rng = np.random.default_rng(2)
    u, i = rng.normal(0.5, 0.3, (users, 3)), rng.normal(0.5, 0.3, (items, 3))
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, users, n), rng.integers(0, items, n), strict=True)})
    return spark.createDataFrame([(a, b, float(u[a] @ i[b]), 0) for a, b in pairs], "user long, item long, rating double, ts long")


def test_one_block_is_a_pass_in_order(spark):
    """With one block the training is the steps one after the other."""
    ratings = rated(spark, 120)
    rows = sorted((r["h"], r["user"], r["item"], r["rating"]) for r in ratings.withColumn("h", portable(F.concat_ws("|", F.col("user").cast("string"), F.col("item").cast("string")), 0)).collect())
    users = {r["id"]: np.array(r["vec"]) for r in M.initial(ratings, "user", 3, 0.0, 0.5, 0).collect()}
    items = {r["id"]: np.array(r["vec"]) for r in M.initial(ratings, "item", 3, 0.0, 0.5, 1).collect()}
    for _ in range(2):
        for _, u, i, x in rows:
            e = 0.1 * (x - float(users[u] @ items[i]))
            users[u], items[i] = users[u] + e * items[i], items[i] + e * users[u]
    found = S.train_stratified(ratings, size=3, low=0.0, high=0.5, rate=0.1, rounds=2, blocks=1)
    for side, want in ((found.users, users), (found.items, items)):
        got = {r["id"]: r["vec"] for r in side.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_strata_share_nothing_and_cover_all(spark):
    placed = S.placed_ratings(rated(spark), 5).collect()
    assert len(placed) == rated(spark).count() and {r["stratum"] for r in placed} == set(range(5))
    for s in range(5):
        for side in ("user", "item"):
            blocks = {}
            for r in placed:
                if r["stratum"] == s:
                    blocks.setdefault(r[side], set()).add(r["block"])
            assert all(len(b) == 1 for b in blocks.values())


def test_nearer_than_averaged_rounds_after_as_many_passes(spark):
    ratings = rated(spark)
    averaged = M.train_offline(ratings, size=3, low=0.0, high=0.5, rate=0.2, rounds=4)
    ordered = S.train_stratified(ratings, size=3, low=0.0, high=0.5, rate=0.2, rounds=4, blocks=4)
    one, other = (E.rmse(M.predict(ratings, f)).first()[0] for f in (averaged, ordered))
    assert other < 0.7 * one


def test_edges(spark):
    rows = [(1, 1, 1.0), (1, 1, 1.0), (1, None, 1.0), (None, 2, 1.0), (2, 2, None)]
    found = S.train_stratified(spark.createDataFrame(rows, "user long, item long, rating double"), size=2, rounds=1, blocks=3)
    assert [r["id"] for r in found.users.collect()] == [1] == [r["id"] for r in found.items.collect()]
    none = S.train_stratified(spark.createDataFrame([], "user long, item long, rating double"), size=2, rounds=1, blocks=2)
    assert none.users.count() == 0 and none.items.count() == 0
