"""The edit embedding against a walk step by step, edited texts against their definition, groups against brute force."""

import hashlib
import random

import numpy as np
import pytest

from paramspark.llm import edit_embedding as E

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.fixture(scope="module")
def embedding():
    return E.Embedding()


def plain(text, embedding):
    """Step by step, as the module says."""
    codes = [ord(c) for c in text or ""]
    random_bits = E._mixed(np.arange(E.WALKS * E.PERIOD, dtype=np.uint64) + np.uint64(E.SEED << 32)).reshape(E.WALKS, E.PERIOD)
    per = E.BITS // E.WALKS
    out = [False] * E.BITS
    for w in range(E.WALKS):
        i, wrote = 0, []
        while i < len(codes):
            kind = int(E._mixed(np.array([codes[i]], np.uint64))[0] >> np.uint64(58))
            wrote.append(codes[i])
            i += int(random_bits[w, (len(wrote) - 1) % E.PERIOD]) >> kind & 1
        for s in range(w * per, (w + 1) * per):
            if steps := [int(x) for x in embedding.records[:, s] if x < len(wrote)]:
                symbol = np.array([wrote[steps[-1]] ^ steps[-1] << 21], np.uint64) + np.uint64(s << 40)
                out[s % per * E.WALKS + w] = bool(E._mixed(symbol)[0] & np.uint64(1))
    return np.packbits(out, bitorder="little").tobytes().hex()


def likeness(a, b):
    return max(0.0, 1 - (int(a, 16) ^ int(b, 16)).bit_count() / (E.BITS / 2))


def expected(docs, embedding):
    """Rows (doc_id, text) in order of ids, of one id in order of texts, no id first."""
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other = E.fingerprint(text, embedding), E.fingerprint(edited, embedding)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, E.fingerprint(following, embedding))))
    return out


def read(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_walks(embedding):
    rng = random.Random(5)
    for text in ["", "a", "ab", "aaaa" * 50, "é☃😀 x" * 30, "".join(rng.choices("abc de\n", k=700))]:
        assert E.fingerprint(text, embedding) == plain(text, embedding), text


def test_texts_together_and_in_stretches(embedding, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefg ", k=rng.choice([0, 1, 5, 80, 400, 900]))) for _ in range(60)] + ["z" * 3000]
    want = [E.fingerprint(t, embedding) for t in texts]
    assert want[-1] == plain(texts[-1], embedding)
    monkeypatch.setattr(E, "STRETCH", 70)
    found = E.packed(embedding.advance(embedding.start(len(texts)), [E._code_points(t) for t in texts]).bits)
    assert [x.tobytes().hex() for x in found] == want


def test_long_text_passes_the_period(embedding):
    text = "".join(random.Random(7).choices("abcdefgh ", k=30_000))
    assert E.fingerprint(text, embedding) == plain(text, embedding)


def test_odd_rows(spark, odd, embedding):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    found = E.op11(spark, odd)
    assert sorted(read(found), key=repr) == sorted(expected(docs, embedding), key=repr)
    assert found.columns == [*COLUMNS, "component_id"]


def test_no_documents_and_one(spark, empty, embedding):
    assert E.op11(spark, empty).count() == 0
    one = spark.createDataFrame([(5, "one text", 1)], "doc_id int, text string, at int")
    (row,) = E.edited_fingerprints(one).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"one one ").hexdigest() and row["near_next"] == 1.0


def test_rows_without_ids_and_repeated_ids(spark, embedding):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdef", k=40))
    docs = [(i % 7 if i % 5 else None, word()) for i in range(60)] + [(3, "same"), (3, "same"), (None, None)]
    found = E.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_next"]) for r in found.collect()), key=repr)
    assert got == sorted(((x[0], x[1], x[2], x[6]) for x in expected(docs, embedding)), key=repr)


def test_many_ranges(spark, embedding):
    docs = [(i * 1_000_003 % (1 << 62) - (1 << 61) * (i % 3 == 0), f"text number {i} " * (i % 9)) for i in range(900)]
    found = E.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    assert found.rdd.getNumPartitions() > 4
    assert sorted(read(found.withColumnsRenamed({"print": "p"}).selectExpr("*", "lower(hex(p)) fingerprint", "lower(hex(edited_print)) edited_fingerprint")), key=repr) == sorted(expected(docs, embedding), key=repr)


def test_likeness_falls_with_edits(embedding):
    rng = random.Random(9)
    means = []
    for edits in (0, 2, 20, 200, 2000):
        alike = []
        for _ in range(30):
            text = rng.choices("etaoin shrdlucmfwyp", k=3000)
            other = list(text)
            for _ in range(edits):
                at = rng.randrange(len(other))
                other[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "q", "x"])
            alike.append(likeness(E.fingerprint("".join(text), embedding), E.fingerprint("".join(other), embedding)))
        means.append(sum(alike) / len(alike))
    assert means[0] == 1 and means[1] > 0.9 and means[2] > 0.6 and means[3] > 0.15 and means[4] < 0.15
    assert means == sorted(means, reverse=True)


def test_an_edited_half_is_half_alike(spark, middle):
    rows = E.op11(spark, middle).where("n_chars > 400").select("near_edited", "near_next").collect()
    near = sorted(r["near_edited"] for r in rows)
    assert 0.45 < near[len(near) // 2] < 0.65 and near[len(near) // 50] > 0.35
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.97 * len(rows)


def components(prints, ids, most):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in np.flatnonzero(np.bitwise_count(prints[:a] ^ prints[a]).sum(axis=1) <= most).tolist():
            root[find(a)] = find(b)
    low = {}
    for a, i in enumerate(ids):
        low[find(a)] = min(low.get(find(a), i), i)
    return {(i, find(a)): low[find(a)] for a, i in enumerate(ids)}


def test_groups_equal_brute_force(spark):
    """Groups of near fingerprints of all sizes, chains, and copies."""
    rng = np.random.default_rng(10)
    prints = []
    for size in (1, 2, 3, 40, 150):
        for _ in range(60 // size + 1):
            own = rng.integers(0, 1 << 63, E.BITS // 64, dtype=np.uint64)
            for _ in range(size):
                own = own.copy()
                for bit in rng.choice(E.BITS, rng.integers(0, 34), replace=False).tolist():
                    own[bit // 64] ^= np.uint64(1 << bit % 64)
                prints.append(own)
    prints += prints[:20]
    prints = np.stack(prints)
    ids = rng.permutation(len(prints)).tolist()
    df = spark.createDataFrame([(i, bytearray(x.tobytes()), 1) for i, x in zip(ids, prints, strict=True)], "doc_id long, print binary, node int")
    got = {r["doc_id"]: r["component_id"] for r in E.similar_fingerprints(df).collect()}
    want = {i: low for (i, _), low in components(prints, ids, E.most_apart(E.BITS)).items()}
    assert sum(got[i] != want[i] for i in want) == 0


def test_middle_table_groups(spark, middle):
    rows = E.op11(spark, middle).select("doc_id", "fingerprint", "component_id").collect()
    prints = np.stack([np.frombuffer(bytes.fromhex(r["fingerprint"]), np.uint64) for r in rows])
    want = {i: low for (i, _), low in components(prints, [r["doc_id"] for r in rows], E.most_apart(E.BITS)).items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
