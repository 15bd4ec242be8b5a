import numpy as np
import pytest
from pyspark.sql import functions as F

from paramspark.operators import topk as K

STRATEGIES = ["length", "coord", "incr:3", "lc:1.1", "li:3:1.1"]


def brute(ids, vectors, q, k):
    s = (vectors * q).sum(axis=1)
    order = np.lexsort((ids, -s))[:k]
    return ids[order].tolist()


@pytest.mark.parametrize("text", STRATEGIES)
@pytest.mark.parametrize("scale", [0.1, 1.0, 10.0])
def test_pruning_is_exact(text, scale):
    rng = np.random.default_rng(7)
    for _ in range(15):
        vectors = rng.normal(0, scale, (300, 8)) * rng.random((300, 1))
        ids = np.arange(300)
        items = K.Items(ids, vectors, bucket=20)
        for q in (rng.normal(0, 1, 8), -np.abs(vectors).mean(axis=0), np.zeros(8)):
            assert items.top(q, 10, K.parse_strategy(text))[0].tolist() == brute(ids, vectors, q, 10)


def test_pruning_saves_products():
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 1, (2000, 8)) * rng.random((2000, 1)) ** 3
    for text in STRATEGIES:
        items = K.Items(np.arange(2000), vectors, bucket=50)
        items.top(rng.normal(0, 1, 8), 5, K.parse_strategy(text))
        assert items.products < 1500, text


def test_parser():
    assert K.parse_strategy("LI:5:2.5") == K.Strategy("li", 5, 2.5)
    assert K.parse_strategy("incr:4").focus == 4
    for bad in ("", "incr", "lc:x", "length:1", "li:5"):
        with pytest.raises(ValueError):
            K.parse_strategy(bad)


def test_null_vectors_and_skipped_items(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 1, (20, 4))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)], "id int, vec array<double>")
    queries = spark.createDataFrame([(0, vectors[0].tolist(), [0, 1]), (1, None, None)], "id int, vec array<double>, skip array<int>")
    got = K.top_items(queries, items, k=4, strategy="coord").collect()
    want = [i for i in brute(np.arange(20), vectors, vectors[0], 20) if i not in (0, 1)][:4]
    assert [r["item"] for r in sorted(got, key=lambda r: r["rank"])] == want


def found(df):
    lists = {}
    for r in df.collect():
        lists.setdefault(r["query"], []).append((r["rank"], r["item"]))
    return {q: [i for _, i in sorted(x)] for q, x in lists.items()}


@pytest.mark.parametrize("text", ["length", "li:3:1.1"])
def test_many_buckets_in_one_job(spark, monkeypatch, text):
    """Items over many buckets and queries over several parts of each, skewed lengths, ties, repeated vectors and queries of no length."""
    monkeypatch.setattr(K, "BUCKET_ITEMS", 40)
    monkeypatch.setattr(K, "SEED_ITEMS", 16)
    monkeypatch.setattr(K, "PART_QUERIES", 7)
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(0, 1, (700, 5)) * rng.random((700, 1)) ** 2, 2)
    vectors[100:140] = vectors[100]
    vectors[300:310] = 0
    asked = np.round(rng.normal(0, 1, (30, 5)), 2)
    asked[7] = 0
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(i, v.tolist(), [j for j in range(i)]) for i, v in enumerate(asked)], "id long, vec array<double>, skip array<long>")
    got = found(K.top_items(queries, items, k=6, strategy=text))
    for i, q in enumerate(asked):
        scores = np.round((vectors * q).sum(axis=1), 6)
        order = [x for x in np.lexsort((np.arange(700), -scores)).tolist() if x >= i][:6]
        assert got[i] == order, i


def test_short_items_are_not_asked(spark, monkeypatch):
    """Queries become rows for the buckets that their seeds leave open only."""
    monkeypatch.setattr(K, "BUCKET_ITEMS", 50)
    monkeypatch.setattr(K, "SEED_ITEMS", 50)
    written = {}
    monkeypatch.setattr(K, "materialize", lambda df, name, real=K.materialize: written.setdefault(name, real(df, name)))
    rng = np.random.default_rng(5)
    vectors = np.abs(rng.normal(0, 1, (1000, 8))) * (rng.random((1000, 1)) ** 4)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, vec array<double>")
    asked = rng.normal(1, 1, (40, 8))
    queries = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(asked)], "id int, vec array<double>")
    got = found(K.top_items(queries, items, k=5, strategy="coord"))
    assert all(got[i] == brute(np.arange(1000), vectors, asked[i], 5) for i in range(40))
    assert max(r["depth"] for r in written["asked"].collect()) < 20 and written["asked"].selectExpr("avg(depth)").first()[0] < 8


def test_no_items_and_few_items(spark):
    none = spark.createDataFrame([], "id int, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "id int, vec array<double>")
    assert K.top_items(queries, none, k=3).count() == 0
    assert found(K.top_items(queries, queries.withColumn("id", F.lit("a")), k=3)) == {1: ["a"]}
    assert K.top_items(queries.limit(0), queries, k=3).count() == 0


def test_recent_items(spark):
    events = spark.createDataFrame([(i, 1, "abcab"[i]) for i in range(5)], "n int, u int, item string")
    at = lambda m: [r["recent"] for r in K.recent_items(events, user="u", item="item", order="n", memory=m).orderBy("n").collect()]
    assert at(2) == [[], ["a"], ["a", "b"], ["b", "c"], ["a", "c"]]
    assert at(0) == [[]] * 5
    assert at(-1)[4] == ["a", "b", "c"]


def test_merge_top(spark):
    parts = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.9), (1, 5, 0.7), (1, 7, 0.7)], "query int, item int, score double")
    assert [(r["item"], r["rank"]) for r in K.merge_top(parts, 2).orderBy("rank").collect()] == [(6, 1), (5, 2)]


@pytest.mark.parametrize("text", [*STRATEGIES, "li:9:2.5"])
def test_many_queries_at_once(monkeypatch, text):
    """The search of many queries by matrix products finds what that of one query finds, with ties, left out items and scores to reach."""
    monkeypatch.setattr(K, "BLOCK", 700)
    rng = np.random.default_rng(9)
    vectors = np.round(rng.normal(0, 1, (300, 8)) * rng.random((300, 1)), 1)
    vectors[:20] = 0
    items = K.Items(rng.permutation(300), vectors, bucket=20)
    queries = np.round(rng.normal(0, 1, (30, 8)), 2)
    queries[3] = 0
    skip = [rng.choice(300, n % 5, replace=False) for n in range(30)]
    pairs = np.repeat(np.arange(30), [len(x) for x in skip]), np.concatenate(skip)
    least = np.where(rng.random(30) < 0.5, -np.inf, 1.0)
    row, ids, scores = items.top_many(queries, 6, K.parse_strategy(text), pairs, least, 1e-6)
    for i, q in enumerate(queries):
        want = items.top(q, 6, K.parse_strategy(text), frozenset(skip[i].tolist()), least[i], 1e-6)
        assert ids[row == i].tolist() == want[0].tolist() and np.allclose(scores[row == i], want[1])


def test_memory_leaves_out_near_ids_of_the_own_label_only(spark, tmp_path):
    """Of the ten ids before a query those of its label; other labels, the query itself and what is further away may be among the best."""
    from paramspark.registry.learning import top_memory

    near = {49: 7, 48: 3, 45: 7, 41: None, 40: 3, 39: 7, 51: 7}
    rows = [(i, [float(i in near or i == 50), i / 1e3], near.get(i, 7)) for i in range(30, 60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert found(top_memory(spark, str(tmp_path))) == {50: [51, 50, 48, 41, 40]}
    spark.createDataFrame([(i, v, None if i == 50 else k) for i, v, k in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/null/embeddings.parquet")
    assert found(top_memory(spark, f"{tmp_path}/null")) == {50: [51, 50, 49, 48, 45]}
