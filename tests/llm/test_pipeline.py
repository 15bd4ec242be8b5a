"""The pipeline against a plain version of its decisions, stage by stage."""

import zlib

import numpy as np
import public_tokenizers
from llm_tools import brute
from tokenizers import Tokenizer

import corpus_pipeline as C
from paramspark.llm import quality_classifier, secret_scan


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if r["text"]]
    stages = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "simhash_near_dedup", "decontamination", "secret_scan", "packing"]

    good = stages["quality_classifier"](spark, docs, small).cache()
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, quality_classifier.learn_from(docs, labels)).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, s in scores.items() if s >= C.REJECT_UNDER}

    unlike = stages["simhash_near_dedup"](spark, good, small).cache()
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (good, unlike))
    sets = {i: shingles(t) for i, t in before.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    root = {i: i for i in before}  # exact: chains of documents at 0.8 or more

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(names := sorted(before)):
        for b in names[:n]:
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and alike(a, b) >= 0.8:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert set(after) == {find(i) for i in before} and len(after) < len(before)

    clean = stages["decontamination"](spark, unlike, small).cache()
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in after.items() if not brute.hits(t, items)[1]}

    safe = stages["secret_scan"](spark, clean, small).cache()
    assert {(r["doc_id"], r["text"]) for r in safe.collect()} == {(r["doc_id"], secret_scan.redact(r["text"])) for r in clean.collect()}
    assert not any(brute.base_spans(r["text"]) for r in safe.collect())
    for x in (good, unlike, clean, safe):
        assert x.columns == docs.columns

    pieces = stages["packing"](spark, safe, small).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc = {}
    for r in sorted(pieces, key=lambda r: r["start"]):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for r in safe.collect():
        ids, at = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 1], "<u4"), 0
        for p in by_doc.pop(r["doc_id"]):
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert not by_doc


def test_run_equals_stages(spark, small):
    rows = C.run(spark, small)
    assert rows.count() > 0 and "sequence_id" in rows.columns


def test_odd_and_empty(spark, odd, empty):
    assert C.run(spark, odd).count() > 0
    assert C.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, odd)
        assert docs.columns == spark.read.parquet(f"{odd}/documents.parquet").columns, name
