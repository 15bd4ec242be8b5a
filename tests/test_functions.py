import math

import pytest
from pyspark.sql import functions as F

from paramspark.functions import bloom_math, hashing, vectors


def test_java_hash():
    assert hashing.java_string_hash("hello") == 99162322
    assert hashing.java_string_hash("") == 0
    assert hashing.java_string_hash("polygenelubricants") == -(1 << 31)


def test_murmur_depends_on_seed_and_text():
    assert hashing.murmur3_utf16("a", 0) != hashing.murmur3_utf16("a", 1)
    assert hashing.murmur3_utf16("abc", 7) == hashing.murmur3_utf16("abc", 7)
    assert -(1 << 31) <= hashing.murmur3_utf16("wide ☃ text", 3) < 1 << 31


def test_xx64_equals_sparks(spark):
    rows = spark.range(-3, 5).select("id", F.xxhash64("id").alias("h")).collect()
    assert all(hashing.xx64_long(r["id"], 42) == r["h"] for r in rows)


@pytest.mark.parametrize("family", ["portable", "murmur3", "xx64"])
def test_families(spark, family):
    rows = spark.range(4).select(hashing.family(F.col("id"), 3, family).alias("h")).collect()
    assert len({tuple(r["h"]) for r in rows}) == 4 and all(len(r["h"]) == 3 for r in rows)


def test_unknown_family(spark):
    with pytest.raises(ValueError):
        hashing.family(F.lit(1), 2, "none")


def test_uniform_is_repeatable(spark):
    rows = spark.range(100).select(hashing.uniform(F.col("id"), 0, 5).alias("u"), hashing.uniform(F.col("id"), 0, 5).alias("v")).collect()
    assert all(0 <= r["u"] < 1 and r["u"] == r["v"] for r in rows)


def test_bloom_estimates():
    assert bloom_math.estimate(20, 3, 4) == pytest.approx(1.487624, abs=1e-5)
    assert bloom_math.union_estimate(20, 3, {1, 4, 10, 20}, {1, 5, 10, 14}) == pytest.approx(2.37783295959154919, abs=1e-5)
    assert bloom_math.estimate(8, 2, 8) == math.inf


def test_bloom_columns(spark):
    row = spark.range(1).select(
        bloom_math.estimate_column(20, 3, F.lit(4)).alias("e"), bloom_math.estimate_column(4, 1, F.lit(4)).alias("full"),
        bloom_math.common_estimate(20, 3, F.array(*map(F.lit, [1, 4, 10, 20])), F.array(*map(F.lit, [1, 5, 10, 14]))).alias("c"),
    ).first()
    assert row["e"] == pytest.approx(1.487624, abs=1e-5)
    assert row["full"] == math.inf
    assert row["c"] == pytest.approx(2 * 1.487624 - 2.377833, abs=1e-4)


def test_vectors(spark):
    one = F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0]))
    ones, zeros = F.array(*[F.lit(1.0)] * 4), F.array(*[F.lit(0.0)] * 4)
    row = spark.range(1).select(
        vectors.dot(one, ones).alias("a"), vectors.dot(one, zeros, 4).alias("b"), vectors.add(one, ones).alias("s"), vectors.attach_length(F.array(F.lit(3.0), F.lit(4.0))).alias("l"),
        vectors.round_half_up(F.lit(2.5)).alias("r"), vectors.sigmoid(F.lit(0.0)).alias("g"),
    ).first()
    assert (row["a"], row["b"], row["s"], row["l"]["len"], row["r"], row["g"]) == (10.0, 0.0, [2.0, 3.0, 4.0, 5.0], 5.0, 3, 0.5)


def test_nan_raises(spark):
    import numpy as np

    with pytest.raises(vectors.NotANumberError):
        vectors.np_add(np.array([1.0]), np.array([np.nan]))
    with pytest.raises(Exception, match="NaN"):
        spark.range(1).select(vectors.add(F.array(F.lit(float("nan"))), F.array(F.lit(1.0)))).collect()


def test_vectorised_hashes_equal_the_jvm(spark):
    """Murmur3 of strings and Java's string hash as the JVM's own libraries compute them; XXH64 as xxhash does."""
    import numpy as np
    import xxhash

    from paramspark.functions import hashing as H

    jvm = spark._jvm
    murmur = getattr(getattr(jvm.scala.util.hashing, "MurmurHash3$"), "MODULE$")
    texts = ["", "a", "ab", "abc", "hello world", "é😀x", "x" * 501]
    for t, row, java in zip(texts, H.murmur3_utf16_all(texts, 3).tolist(), H.java_string_hash_all(texts).tolist(), strict=True):
        assert row == [murmur.stringHash(t, s) for s in range(3)] == [H.murmur3_utf16(t, s) for s in range(3)]
        assert java == jvm.java.util.Objects.hashCode(t) == H.java_string_hash(t)
    values = np.array([0, 1, -1, 1 << 40, -(1 << 63), (1 << 63) - 1])
    for v, row in zip(values.tolist(), H.xx64_all(values, 3).tolist(), strict=True):
        assert [x % (1 << 64) for x in row] == [xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), s) for s in range(3)]


def test_fixed_hash_values():
    """Values of the JVM's own hash functions of the ids 0 and 4."""
    assert [hashing.murmur3_utf16(t, s) for t in "04" for s in (0, 1)] == [-764297089, -1302509589, -516830072, -1532871171]
    assert [hashing.xx64_long(v, s) for v in (0, 4) for s in (0, 1)] == [3803688792395291579, 2506089352882295055, 3145212359238734475, -2881828142325668802]
    assert hashing.java_string_hash("word0") == 113318502
