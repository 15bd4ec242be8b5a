"""Near copies at and under the stated similarity, alone and in groups."""

import numpy as np
import pytest

from paramspark.llm import simhash


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def alike(a, b):
    return len(a & b) / len(a | b)


def changed(rng, words, low, high):
    """Words of a new text whose similarity to ``words`` is between the two."""
    while True:
        near = list(words)
        for at in rng.choice(len(words), rng.integers(1, 16), replace=False):
            near[at] = f"new{rng.integers(1 << 40)}"
        if low <= alike(shingles(words), shingles(near)) < high:
            return near


def pairs_kept(spark, seed, low, high, n=150):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        own = [f"w{x}" for x in rng.integers(1 << 40, size=300)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(changed(rng, own, low, high)))]
    return {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id").collect()}


def test_lone_pairs_at_the_threshold_are_caught(spark):
    assert pairs_kept(spark, 1, 0.80, 0.85) == {2 * i for i in range(150)}


def test_lone_pairs_under_the_threshold_stay(spark):
    assert pairs_kept(spark, 2, 0.70, 0.80) == set(range(300))


def test_groups_equal_brute_force(spark):
    """Copies of one text at all similarities: the components are those of the exact links, whatever the size of a group."""
    rng = np.random.default_rng(3)
    own = [f"w{x}" for x in rng.integers(1 << 40, size=200)]
    texts = [own]
    for _ in range(119):
        texts.append(changed(rng, texts[rng.integers(len(texts))], 0.70, 0.90))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == {i: find(i) for i in range(len(texts))}


def components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def test_large_keys_are_dealt_out(spark, monkeypatch):
    """Keys of more texts than one task may compare: two groups that share no link but many bands, and a chain."""
    monkeypatch.setattr(simhash, "PIECE", 12)
    rng = np.random.default_rng(8)
    own = [f"w{x}" for x in rng.integers(1 << 40, size=200)]
    texts = [own]
    for n in range(99):
        low, high = (0.70, 0.79) if n % 9 == 0 else (0.82, 0.97)
        texts.append(changed(rng, texts[rng.integers(len(texts))], low, high))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == components(texts)


def test_unlike_texts_under_one_id_stay(spark):
    """Rows are judged by their own text, whatever other row has their id."""
    rng = np.random.default_rng(9)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(1 << 40, size=60)) for _ in range(3))
    rows = [(5, a, 1), (5, b, 2), (6, c, 3), (6, a, 4), (7, b, 5), (7, b, 6), (8, c, 7), (8, c, 8), (None, a, 9), (9, None, 10), (10, "", 11), (10, "", 11)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node int")
    left = [(r["doc_id"], r["text"]) for r in simhash.keep_first(docs).collect()]
    assert sorted(left, key=str) == sorted([(5, a), (5, b), (6, c), (None, a), (9, None)], key=str)
    once = spark.createDataFrame([(3, a, 1), (3, a, 2), (3, a, 1)], "doc_id bigint, text string, node int")
    assert len(simhash.keep_first(once).collect()) == 1


def test_candidates_come_from_blocks_of_the_fingerprint(spark):
    """Pigeonhole: fingerprints that differ in fewer bits than there are blocks agree in a block; so do nearly all pairs at the threshold."""
    rng = np.random.default_rng(11)
    blocks, width = simhash.block_shape(220_000, 0.8)
    words = -(-blocks * width // 64)
    hashes = rng.integers(0, 1 << 63, 301, dtype=np.uint64)
    wide = simhash.wide_fingerprint(hashes, words)
    assert int(wide[0]) == simhash.fingerprint(hashes)
    caught = 0
    for _ in range(300):
        other = wide.copy()
        for bit in rng.choice(blocks * width, blocks - 1, replace=False).tolist():
            other[bit // 64] ^= np.uint64(1 << bit % 64)
        assert (np.diff(simhash.block_keys(np.stack([wide, other]), blocks, width), axis=0) == 0).any()
        both, own, new = np.split(rng.integers(0, 1 << 63, 8 * 33 + 66, dtype=np.uint64), [264, 297])
        pair = np.stack([simhash.wide_fingerprint(np.concatenate([both, x]), words) for x in (own, new)])
        caught += (np.diff(simhash.block_keys(pair, blocks, width), axis=0) == 0).any()
        assert np.bitwise_count(pair[0] ^ pair[1]).sum() <= simhash.most_differing(0.8, 64 * words)
    assert caught >= 298


def test_small_sets_meet(spark):
    """Four of five shingles: similarity 0.8, too few for their fingerprints to be as near as those of longer texts."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(200):
        own = [f"w{x}" for x in rng.integers(1 << 40, size=9)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:8]))]
    assert {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {2 * i for i in range(200)}


def test_pairs_of_a_group_grow_no_faster_than_the_group(spark, monkeypatch):
    """Texts around a common one, half of them too far for a link: each is compared with its nearest mates, not with one under each of its keys."""
    rng, counts = np.random.default_rng(13), []

    def alike(pairs, *rest, real=simhash._alike):
        counts[-1] += pairs.count()
        return real(pairs, *rest)

    monkeypatch.setattr(simhash, "_alike", alike)
    for n in (150, 900):
        counts.append(0)
        own = [f"w{x}" for x in rng.integers(1 << 40, size=120)]
        texts = [changed(rng, own, *((0.72, 0.79) if i % 2 else (0.86, 0.96))) for i in range(n)]
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == components(texts)
    assert counts[1] <= 6 * counts[0], counts


def test_rows_of_a_group_do_not_grow_a_member(spark, monkeypatch):
    """Of groups of near copies most are linked by a few blocks first; what the pass over all blocks puts out follows what is open then."""
    counts, real = {}, simhash.materialize

    def noted(df, name, rows=None):
        found = real(df, name, rows)
        if name in ("mates", "pairs"):
            counts[name] = counts.get(name, 0) + found.count()
        return found

    monkeypatch.setattr(simhash, "materialize", noted)
    a_member = {}
    for n in (100, 900):
        counts.clear()
        rng = np.random.default_rng(5)
        own = [f"w{x}" for x in rng.integers(1 << 40, size=120)]
        docs = spark.createDataFrame([(i, " ".join(changed(rng, own, 0.82, 0.97))) for i in range(n)], "doc_id bigint, text string")
        assert simhash.shingle_groups(docs).select("root").distinct().count() <= 3
        a_member[n] = sum(counts.values()) / n
    assert a_member[900] <= 2 * a_member[100] + 5 and a_member[900] < 40, a_member


@pytest.mark.parametrize("switch", [{"TOGETHER": 20, "PAIRS": 0}, {"TOGETHER": 20, "COMPARED": 0, "NEIGHBOURS": 1}, {"EARLY": (), "BROADCAST_IDS": 0, "PAIRS": 10**9}])
def test_plans_on_both_sides_of_each_switch(spark, monkeypatch, switch):
    """What only chooses a plan changes no component."""
    for name, value in switch.items():
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(21)
    texts = [[f"w{x}" for x in rng.integers(1 << 40, size=150)] for _ in range(4)]
    for _ in range(60):
        texts.append(changed(rng, texts[rng.integers(len(texts))], 0.72, 0.95))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    kept = {r["doc_id"] for r in simhash.keep_first(docs).collect()}
    assert kept == set(components(texts).values())
