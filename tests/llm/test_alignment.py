"""The alignment against a plain one: whole texts, byte by byte."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paramspark.llm import alignment
from paramspark.llm.packing import _byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.letters = _byte_letters()
        self.cache = {}

    def tokens(self, text):
        raw = (" " + text).encode()
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        same = b"".join(x for _, x in a) == raw == b"".join(x for _, x in b)
        return (a, b) if text and same else ([], [])

    def one(self, text):
        """(n_a, n_b, groups as text, links) of a text."""
        if text not in self.cache:
            a, b = self.tokens(text or "")
            ends = []
            for side in (a, b):
                at, own = 0, {}
                for i, x in side:
                    at += len(x)
                    own.setdefault(at, []).append(i)
                ends.append(own)
            cuts = sorted(set(ends[0]) & set(ends[1]))
            groups, last = [], 0
            for cut in cuts:
                groups.append("|".join(",".join(str(i) for e in sorted(own) if last < e <= cut for i in own[e]) for own in ends))
                last = cut
            self.cache[text] = len(a), len(b), groups, [(x, y) for c in cuts for x in ends[0][c] for y in ends[1][c]]
        return self.cache[text]

    def all(self, docs):
        found = [(i, *self.one(t)) for i, t in docs]
        counts = Counter(x for *_, links in found for x in links)
        most = {}
        for (_, b), n in counts.items():
            most[b] = max(most.get(b, 0), n)
        return [
            (i, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for i, n_a, n_b, groups, links in found
        ]


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_odd_rows(spark, odd, plain):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    assert rows(alignment.op13(spark, odd)) == sorted(plain.all(docs), key=repr)


def test_no_documents(spark, empty):
    found = alignment.op13(spark, empty)
    assert found.count() == 0 and found.columns == COLUMNS


def test_strange_texts(spark, plain):
    texts = [
        "a  b", " a", "a ", "  ", " ", "\n", "\ta\n\n b", "a▁b", "▁", "é é ﬁ", "<s> x </s> <unk> <0x41> <|endoftext|>", "a\x00b", "　x\xa0y", "日本 語の 文", "😀 😀", "a\r\n b", "x\x1c y\x85 z", "don't we'll 'tis",
        "word\n next  two \n\n three", "x" * 3000, "a " * 5000, " ".join(f"w{i}" for i in range(3000)), "tail▁ " + "plain words " * 30, "​zero​ width", "ǅ ß İ", "1 22 333 4444", "=== --- ***", "\x1f", "\x85",
    ]
    docs = [(i, t) for i, t in enumerate(texts + texts[:7])]
    df = spark.createDataFrame(docs, "n_a long, text string").withColumn("block", F.lit(3)).repartition(3)
    got = rows(alignment.alignments(df, A, B, doc_id="n_a"))
    assert got == sorted(plain.all(docs), key=repr)


def test_bytes_that_are_no_utf8(spark):
    df = spark.sql("select 1L doc_id, cast(x'61ff62' as string) text union all select 2L, 'a b'")
    assert {r["doc_id"]: (r["n_a"], r["groups_sha256"] == "") for r in alignment.alignments(df, A, B).collect()} == {1: (0, True), 2: (2, False)}


def test_middle_table_in_many_blocks(spark, middle, plain, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 100_000)
    docs = spark.read.parquet(f"{middle}/documents.parquet").where("doc_id < 150")
    want = plain.all([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert rows(alignment.alignments(docs.repartition(4), A, B)) == sorted(want, key=repr)


def test_more_partitions_than_the_session_sets(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 40)
    monkeypatch.setattr(alignment, "PARTITION_BLOCKS", 1)
    docs = [(i, f"some words of document {i % 5} and others {i}") for i in range(60)]
    assert rows(alignment.alignments(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), A, B)) == sorted(plain.all(docs), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab cde\n\t '\x1c\x85\xa0éЖ日😀1,.▁ <|>"), max_size=30), min_size=1, max_size=6))
def test_units_equal_whole_texts(texts):
    aligner, plain = _made()
    for text in filter(None, texts):
        units = aligner.units(text)
        found = aligner.align(list(dict.fromkeys(units)))
        at = {u: i for i, u in enumerate(dict.fromkeys(units))}
        n_a, n_b, groups, links = plain.one(text)
        own = [at[u] for u in units]
        if not found.same[own].all():
            assert n_a == n_b == 0
            continue
        assert (int(found.n_a[own].sum()), int(found.n_b[own].sum())) == (n_a, n_b)
        assert b"".join(found.texts[i] for i in own)[:-1].decode() == ";".join(groups)
        starts = np.cumsum(found.n_links) - found.n_links
        assert [(int(p) >> 32, int(p) & 0xFFFFFFFF) for i in own for p in found.pairs[starts[i] : starts[i] + found.n_links[i]]] == links


_kept = []


def _made():
    if not _kept:
        _kept.extend([alignment.Aligner(A, B), Plain()])
    return _kept


def test_empty_tokens_and_many_to_many():
    groups = alignment.groups_of(np.array([2, 0, 3]), np.array([1, 1, 0, 3]))
    assert groups.cuts.tolist() == [2, 5]
    assert sorted(zip(*(x.tolist() for x in alignment.links_of(groups)), strict=True)) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 3)]


def test_salted_counts_and_ties(spark):
    lists = [(block, (a << 32) | b, n) for block in range(40) for a, b, n in ((1, 7, 2), (2, 7, 2), (3, 7, 1), (4, 9, block))]
    got = {(r["pair"] >> 32, r["pair"] & 0xFFFFFFFF): (r["count"], r["best"]) for r in alignment.pair_counts(spark.createDataFrame(lists, "block long, pair long, n long")).collect()}
    assert got == {(1, 7): (80, True), (2, 7): (80, True), (3, 7): (40, False), (4, 9): (780, True)}
