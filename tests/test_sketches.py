import pytest
from pyspark.sql import functions as F

from paramspark.functions.hashing import murmur3_utf16
from paramspark.operators import sketches as S

DOCS = [(i, ["a"] + (["b"] if i % 2 else []) + (["c", "c"] if i % 5 == 0 else []), i % 2) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, words array<string>, slot int")


def queries(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def test_bloom_murmur_bits(docs):
    got = {r["word"]: r["bits"] for r in S.bloom_build(docs, num_bits=64, num_hashes=3, hashes="murmur3").collect()}
    want = sorted({murmur3_utf16(str(i), s) % 64 for i, w, _ in DOCS if "c" in w for s in range(3)})
    assert got["c"] == want


def test_slotted_bloom_union_is_bloom(docs):
    whole = {r["word"]: set(r["bits"]) for r in S.bloom_build(docs, num_bits=128, num_hashes=2).collect()}
    parts = {}
    for r in S.bloom_build(docs, num_bits=128, num_hashes=2, slot=True).collect():
        parts.setdefault(r["word"], set()).update(r["bits"])
    assert whole == parts


def test_bloom_predict_close_to_exact(spark, docs):
    model = S.bloom_build(docs, num_bits=4096, num_hashes=3)
    got = {(r["query"], r["word"]): r["score"] for r in S.bloom_predict(model, queries(spark, "a", "b"), num_bits=4096, num_hashes=3, k=5).collect()}
    for r in S.cooccurrence_exact(docs, queries(spark, "a", "b")).collect():
        assert got[r["query"], r["word"]] == pytest.approx(r["score"], abs=1.0)


def test_unknown_query(spark, docs):
    model = S.bloom_build(docs, num_bits=256, num_hashes=2)
    assert S.bloom_predict(model, queries(spark, "zzz"), num_bits=256, num_hashes=2, k=5).agg(F.max(F.abs("score"))).first()[0] == 0
    timed = S.bloom_build(docs, num_bits=256, num_hashes=2, slot=True)
    assert S.bloom_predict(timed, queries(spark, "zzz"), num_bits=256, num_hashes=2, k=5, slot=True).count() == 0


def test_minhash_variants_agree_and_estimate(spark, docs):
    a = {r["word"]: r["signature"] for r in S.minhash_build(docs, num_hashes=64).collect()}
    b = {r["word"]: r["signature"] for r in S.minhash_build_rehashed(docs, num_hashes=64).collect()}
    assert a == b
    got = {r["word"]: r["score"] for r in S.minhash_predict(S.minhash_build(docs, num_hashes=64), S.word_count(docs), queries(spark, "a"), num_hashes=64).collect()}
    assert got["a"] == 40 and abs(got["b"] - 20) <= 6


def test_minhash_absent_word_scores_zero(spark, docs):
    got = S.minhash_predict(S.minhash_build(docs, num_hashes=8), S.word_count(docs), queries(spark, "zzz"), num_hashes=8).collect()
    assert {r["score"] for r in got} == {0}


def test_tow_counts_repeats_and_estimates(spark, docs):
    model = S.tow_build(docs, num_hashes=64)
    c = {r["word"]: r["sums"] for r in model.collect()}["c"]
    assert all(x % 2 == 0 for x in c)
    got = {r["word"]: r["score"] for r in S.tow_predict(model, queries(spark, "b"), num_hashes=64, num_means=4, k=3).collect()}
    assert abs(got["b"] - 20) <= 14


def test_tow_uneven_slices(spark, docs):
    model = S.tow_build(docs, num_hashes=10)
    assert S.tow_predict(model, queries(spark, "a"), num_hashes=10, num_means=3, k=3).count() == 3


def test_sketches_merge(docs):
    one, two = docs.where("doc_id < 11"), docs.where("doc_id >= 11")
    merged = S.sketch_merge(S.tow_build(one, num_hashes=8), S.tow_build(two, num_hashes=8), "sums", ["word"])
    assert {(r["word"], tuple(r["sums"])) for r in merged.collect()} == {(r["word"], tuple(r["sums"])) for r in S.tow_build(docs, num_hashes=8).collect()}


def test_too_many_queries(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "MAX_QUERIES", 1)
    with pytest.raises(ValueError):
        S.additive_top(S.tow_build(docs, num_hashes=8), queries(spark, "a", "b"))


def test_minhash_search_is_a_join_of_postings(spark, monkeypatch):
    """No cross join, whatever the number of queries; the same rows with and without broadcasts; words without a match can be left out."""
    import random

    rng = random.Random(3)
    docs = spark.createDataFrame([(i, rng.sample("abcdefghijklmnop", 3)) for i in range(60)] + [(99, ["lonely"]), (100, [])], "doc_id long, words array<string>")
    model, counts = S.minhash_build(docs, num_hashes=4), S.word_count(docs)
    signatures = {r["word"]: r["signature"] for r in model.collect()}
    n = {r["word"]: r["n"] for r in counts.collect()}
    asked = spark.createDataFrame([(w,) for w in [*signatures, "unknown"]], "word string")

    def rows(**options):
        found = S.minhash_predict(model, counts, asked, num_hashes=4, **options)
        assert not any(x in found._jdf.queryExecution().toString() for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))
        return {(r["query"], r["word"]): r["score"] for r in found.collect()}

    def score(q, w):
        j = sum(a == b for a, b in zip(signatures.get(q, []), signatures[w], strict=False)) / 4
        return j and int(j * (n[w] + n.get(q, 0)) / (j + 1) + 0.5)

    want = {(q, w): score(q, w) for q in signatures for w in signatures if set(zip(range(4), signatures[q], strict=True)) & set(zip(range(4), signatures[w], strict=True))}
    assert rows(matched_only=True) == want
    assert rows() == {(q, w): score(q, w) for q in [*signatures, "unknown"] for w in signatures}
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    assert rows(matched_only=True) == want
    monkeypatch.setattr(S, "MAX_QUERIES", 3)
    with pytest.raises(ValueError):
        rows()


def test_signatures_are_aggregated_by_hashing(spark, docs):
    """No sort of all (word, document) rows before they are combined."""
    for build in (S.minhash_build, S.minhash_build_rehashed):
        assert "SortAggregate" not in build(docs, num_hashes=4)._jdf.queryExecution().executedPlan().toString()


def test_of_equal_hashes_the_smallest_id_counts(spark, monkeypatch):
    monkeypatch.setattr(S, "family", lambda key, n, name: F.array(*(F.pmod(key, F.lit(3 + i)) for i in range(n))))
    docs = spark.createDataFrame([(i, [f"w{j}" for j in range(5) if (i * 7 + j) % 3]) for i in range(40)], "doc_id long, words array<string>")
    held = {f"w{j}": [i for i in range(40) if (i * 7 + j) % 3] for j in range(5)}
    want = {w: [min(ids, key=lambda x: (x % (3 + i), x)) for i in range(4)] for w, ids in held.items()}
    for build in (S.minhash_build, S.minhash_build_rehashed):
        assert {r["word"]: r["signature"] for r in build(docs, num_hashes=4).collect()} == want


@pytest.mark.parametrize("slot", [False, True])
def test_bits_in_common_are_looked_up_not_joined(spark, docs, monkeypatch, slot):
    """A join on the bit makes a row for each bit of each word that a frequent query has; the same rows by both ways."""
    rows = docs.withColumn("slot", (F.col("doc_id") % 3).cast("int")) if slot else docs
    model, asked = S.bloom_build(rows, num_bits=256, num_hashes=2, slot=slot), queries(spark, "a", "b", "zzz")
    found = lambda: S.bloom_predict(model, asked, num_bits=256, num_hashes=2, k=4, slot=slot)
    looked = found()
    assert "Join" not in looked._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, looked.collect())) == sorted(map(tuple, found().collect()))
