"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often they do so in the corpus.

Tokens of both tokenizers are byte ranges of the same bytes (a space and the text). Their ends are running sums of token lengths;
the ends that both have (an intersection of two sorted arrays) cut the tokens into groups, whose numbers a binary search gives. A link is
a pair of tokens that end together; ``links_of`` expands the tokens at each common end by repeats.

Neither tokenizer has a token across a single space between two visible characters: the byte-level one splits there by its pattern, the
other has no such piece (``Aligner`` looks, and takes texts whole if it has). So a text's alignment is that of its space-bound
units one after the other, and each distinct unit of a block of documents is tokenised and aligned once, in runs of ``RUN`` characters.

Plan: documents are cut once into blocks of at most ``BLOCK_BYTES`` of text, which are written. A block has its distinct id pairs with
their counts, the links of its units as numbers of these pairs, and each document as unit numbers. Pairs are counted corpus-wide in
two stages, first by pair and a salt of the block, then by pair; the highest count of each B id follows, and both join the pair lists of
the blocks, where they meet the documents. So what is shuffled is pairs of blocks and unit numbers: a frequent pair is one row a block.
Nothing is broadcast and nothing but two totals reaches the driver.

Edge cases: null and empty texts, and those whose tokens do not give back the very bytes (U+2581 in a text, which B reads as a
space; bytes that are not UTF-8), have no tokens: zeros, and '' for the groups. Special tokens in a text are plain text. Repeated rows
are documents each. A unit of any length is encoded whole. No documents give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, record_batch, slices, table, tidy
from .packing import _UNUSUAL, ByteBpe, _byte_letters

BLOCK_BYTES = 24 << 20
#: Blocks whose pairs one partition of a shuffle may hold on average; where the session sets fewer partitions, there are more.
PARTITION_BLOCKS = 8
#: Characters of units that are tokenised at a time (a longer unit comes alone).
RUN = 1 << 16
#: Parts into which the first stage of the count deals the rows of each pair.
SALTS = 16
_SPACE = "▁"
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_OTHER_BLANK = re.compile(r"[^\S \n]")
_CROSSING = re.compile(f"[^{_SPACE}]{_SPACE}")


class Groups(NamedTuple):
    """Ends of tokens of both sides in bytes, the common ones, and the group of each token."""

    ends_a: np.ndarray
    ends_b: np.ndarray
    cuts: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def groups_of(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Groups:
    """Groups of tokens with these lengths in bytes, whose sums are equal."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    cuts = np.intersect1d(ends_a, ends_b)
    return Groups(ends_a, ends_b, cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b))


def links_of(groups: Groups) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of all pairs of tokens that end together."""
    first_a, n_a = np.searchsorted(groups.ends_a, groups.cuts), np.searchsorted(groups.ends_a, groups.cuts, "right")
    first_b, n_b = np.searchsorted(groups.ends_b, groups.cuts), np.searchsorted(groups.ends_b, groups.cuts, "right")
    n_a, n_b = n_a - first_a, n_b - first_b
    pairs = n_a * n_b  # one, but where tokens are empty
    of = np.repeat(np.arange(len(pairs)), pairs)
    at = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    return first_a[of] + at // n_b[of], first_b[of] + at % n_b[of]


class PlainBpe(ByteBpe):
    """``ByteBpe`` to which special tokens in a text are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        letters = _byte_letters()
        self.bytes = [b""] * self.library.get_vocab_size()
        for word, i in self.library.get_vocab().items():
            self.bytes[i] = word.encode() if word in self.special else bytes(letters[c] for c in word)
        self.library.encode_special_tokens = True
        self.special = []


class Aligned(NamedTuple):
    """Of each unit: tokens of A and B, groups, links, whether the bytes came back, and the groups as text, each with a ';' behind it.
    ``pairs``: (A id << 32 | B id) of each link, unit by unit."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    same: np.ndarray
    texts: list[bytes]
    pairs: np.ndarray


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a = PlainBpe(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.vocab_size()
        names = [self.b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [bytes([int(names[i][3:5], 16)]) if self.b.is_byte(i) else names[i].replace(_SPACE, " ").encode() for i in range(n)]
        self.length_a = np.array([len(x) for x in self.a.bytes])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        self.whole = any(_CROSSING.search(x) for i, x in enumerate(names) if not self.b.is_byte(i))
        # An id as text with what follows it: within a side, at the end of A's side, at the end of the group.
        self.size = max(n, len(self.a.bytes))
        self.text = [b"%d%b" % (i, after) for after in (b",", b"|", b";") for i in range(self.size)]

    def units(self, text: str) -> list[str]:
        """The text cut at single spaces between visible characters; each unit has a space before it in turn."""
        if self.whole:
            return [text]
        if _OTHER_BLANK.search(text) or "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
            return _BETWEEN.split(text)
        return text.split(" ")

    def align(self, units: list[str]) -> Aligned:
        """All units, each tokenised with a space before it."""
        odd = np.fromiter((bool(_UNUSUAL.search(u)) for u in units), bool, len(units))
        order = np.argsort(odd, kind="stable")  # usual ones together: the faster encoder takes them
        sizes = np.fromiter((len(u) + 1 for u in units), np.int64, len(units))[order]
        run = (np.cumsum(sizes) - sizes) // RUN * 2 + odd[order]
        alone = (sizes > RUN) | np.fromiter((u[0].isspace() or u[-1].isspace() for u in map(units.__getitem__, order.tolist())), bool, len(units))
        run[alone] = -1 - np.flatnonzero(alone)  # long, or not bound to end where the next one begins
        stops = np.arange(1, len(units)) if self.whole else np.flatnonzero(np.diff(run)) + 1
        parts = [self._run([units[i] for i in some.tolist()]) for some in np.split(order, stops) if len(some)]
        back = np.argsort(order)
        joined = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(5)]
        texts = [t for p in parts for t in p.texts]
        pairs = np.concatenate([p.pairs for p in parts]) if parts else np.empty(0, np.int64)
        n_links = joined[3]
        starts = (np.cumsum(n_links) - n_links)[back]
        n = n_links[back]
        at = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
        return Aligned(*(x[back] for x in joined), [texts[i] for i in back.tolist()], pairs[at])

    def _run(self, units: list[str]) -> Aligned:
        text = " ".join(units)
        ids_a = self.a.ids(" " + text).astype(np.int64)
        ids_b = np.array(self.b.encode(text), np.int64)
        lengths = np.fromiter((len(u.encode("utf-8", "surrogatepass")) + 1 for u in units), np.int64, len(units))
        raw = (" " + text).encode("utf-8", "surrogatepass")
        if b"".join(map(self.a.bytes.__getitem__, ids_a.tolist())) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) != raw:
            if len(units) > 1:  # find the units at fault
                half = len(units) // 2
                x, y = self._run(units[:half]), self._run(units[half:])
                return Aligned(*(np.concatenate([x[k], y[k]]) for k in range(5)), x.texts + y.texts, np.concatenate([x.pairs, y.pairs]))
            none = np.zeros(1, np.int64)
            return Aligned(none, none, none, none, np.zeros(1, bool), [b""], np.empty(0, np.int64))
        groups = groups_of(self.length_a[ids_a], self.length_b[ids_b])
        a, b = links_of(groups)
        ends = np.cumsum(lengths)
        tokens_a, tokens_b, cuts = (np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (groups.ends_a, groups.ends_b, groups.cuts))
        n_links = np.diff(np.searchsorted(groups.ends_a[a], ends, "right"), prepend=0)
        # Tokens in the order of the groups, A's before B's: a token comes after those of its side and those of the other that are done before it.
        done_a, done_b = np.searchsorted(groups.ends_a, groups.cuts, "right"), np.searchsorted(groups.ends_b, groups.cuts, "right")
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[done_a - 1], last_b[done_b - 1] = 1, 2
        order[np.arange(len(ids_a)) + np.concatenate([[0], done_b])[groups.group_a]] = ids_a + self.size * last_a
        order[np.arange(len(ids_b)) + done_a[groups.group_b]] = ids_b + self.size * last_b
        written = list(map(self.text.__getitem__, order.tolist()))
        stops = np.cumsum(tokens_a + tokens_b).tolist()
        texts = [b"".join(written[s:e]) for s, e in zip([0, *stops], stops, strict=False)]
        return Aligned(tokens_a, tokens_b, cuts, n_links, np.ones(len(units), bool), texts, ids_a[a] << 32 | ids_b[b])


_DOC = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of three kinds. Pairs: (block, at, pair, n). Links: (block, numbers, units), the pair numbers of all units' links and how many
    each unit has. Documents: (block, doc_id, counts, groups_sha256, numbers), numbers of units."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ["at", "pair", "n", *_DOC]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, made = Aligner(path_a, path_b), TaskContext.get().partitionId(), 0
        id_type = None

        def rows(size: int, block: int, /, **given: pa.Array) -> pa.RecordBatch:
            types = {"block": pa.int64(), **dict.fromkeys(longs, pa.int64()), "doc_id": id_type, "groups_sha256": pa.string(), "numbers": pa.binary(), "units": pa.binary()}
            return record_batch({name: given.get(name, pa.nulls(size, t)) for name, t in types.items()} | {"block": pa.array(np.full(size, block))})

        def packed(x: np.ndarray) -> bytes:
            return zstandard.compress(x.astype("<u4").tobytes())

        def close(held: list[tuple[pa.Scalar, np.ndarray]], number: dict[str, int]) -> Iterator[pa.RecordBatch]:
            block = (part << 32) + made
            found = aligner.align(list(number))
            kept = [bool(len(own)) and bool(found.same[own].all()) for _, own in held]
            uses = np.zeros(len(number), np.int64)
            for (_, own), keep in zip(held, kept, strict=True):
                if keep:
                    uses += np.bincount(own, minlength=len(number))
            of = np.repeat(np.arange(len(number)), found.n_links)
            pairs, which = np.unique(found.pairs, return_inverse=True)
            counts = np.zeros(len(pairs), np.int64)
            np.add.at(counts, which, uses[of])
            for at in range(0, len(pairs), 50_000):
                n = min(50_000, len(pairs) - at)
                yield rows(n, block, at=pa.array(np.arange(at, at + n)), pair=pa.array(pairs[at : at + n]), n=pa.array(counts[at : at + n]))
            by_use = np.argsort(-uses, kind="stable")  # small numbers for frequent units: these compress well
            place = np.empty_like(by_use)
            place[by_use] = np.arange(len(by_use))
            n_links = found.n_links[by_use]
            starts = (np.cumsum(found.n_links) - found.n_links)[by_use]
            flat = which[np.arange(n_links.sum()) + np.repeat(starts - (np.cumsum(n_links) - n_links), n_links)]
            yield rows(1, block, numbers=pa.array([packed(flat)], pa.binary()), units=pa.array([packed(n_links)], pa.binary()))
            for at in range(0, len(held), 1000):
                some = held[at : at + 1000]
                sums, digests, numbers = [], [], []
                for (_, own), keep in zip(some, kept[at : at + 1000], strict=True):
                    own = own if keep else own[:0]
                    sums.append([int(x[own].sum()) for x in found[:4]])
                    digests.append(hashlib.sha256(b"".join(map(found.texts.__getitem__, own.tolist()))[:-1]).hexdigest() if keep else "")
                    numbers.append(packed(place[own]))
                n = len(some)
                totals = {name: pa.array([s[i] for s in sums], pa.int64()) for i, name in enumerate(_DOC)}
                yield rows(n, block, doc_id=pa.array([d.as_py() for d, _ in some], id_type), groups_sha256=pa.array(digests), numbers=pa.array(numbers, pa.binary()), **totals)

        number: dict[str, int] = {}
        held: list[tuple[pa.Scalar, np.ndarray]] = []
        size = 0
        for whole in batches:
            for batch in slices(whole):
                id_type = batch.column(0).type
                for doc_id, raw in zip(batch.column(0), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    raw = raw or b""
                    if held and size + len(raw) > BLOCK_BYTES:
                        yield from close(held, number)
                        made, number, held, size = made + 1, {}, [], 0
                    size += len(raw)
                    try:
                        own = aligner.units(raw.decode()) if raw else []
                    except UnicodeDecodeError:
                        own = []
                    held.append((doc_id, np.array([number.setdefault(u, len(number)) for u in own], np.uint32)))
        if held:
            yield from close(held, number)

    schema = ", ".join(["block bigint", *(f"{x} bigint" for x in longs), f"doc_id {kind}", "groups_sha256 string", "numbers binary", "units binary"])
    return docs.mapInArrow(tidy(run), schema)


def pair_counts(lists: DataFrame, salts: int = SALTS) -> DataFrame:
    """(pair, count, best) of lists (block, pair, n): how often the pair is linked, and whether no pair of its B id is more often."""
    first = lists.groupBy("pair", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = materialize(first.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    own = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    highest = counts.groupBy(own).agg(F.max("count").alias("most"))
    return counts.withColumn("b", own).join(highest, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _valued(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of a block with what its pairs count."""
    at = pairs["at"].to_numpy()
    value = np.zeros((2, len(at)), np.int64)
    value[0][at], value[1][at] = pairs["best"].to_numpy().astype(np.int64), pairs["count"].to_numpy()
    links = rows.filter(pc.is_valid(rows["units"]))
    unpacked = lambda x: np.frombuffer(zstandard.decompress(x), "<u4")
    flat, n = unpacked(links["numbers"][0].as_py()), unpacked(links["units"][0].as_py()).astype(np.int64)
    stops = np.cumsum(n)
    sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(value[:, flat], axis=1)], axis=1)
    best, count = sums[:, stops] - sums[:, stops - n]
    docs = rows.filter(pc.is_null(rows["units"]))
    own = [unpacked(x) for x in docs["numbers"].to_pylist()]
    found = {"n_best": pa.array([int(best[x].sum()) for x in own], pa.int64()), "count_sum": pa.array([int(count[x].sum()) for x in own], pa.int64())}
    return pa.table({"doc_id": docs["doc_id"], **{c: docs[c] for c in _DOC}, **found, "groups_sha256": docs["groups_sha256"]})


def alignments(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs``."""
    spark = docs.sparkSession
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    blocks = materialize(_blocks(kept, path_a, path_b), "aligned")
    lists = blocks.where("pair IS NOT NULL").select("block", "at", "pair", "n")
    rows = blocks.where("numbers IS NOT NULL").select("block", "doc_id", *_DOC, "groups_sha256", "numbers", "units")
    parts = -(-rows.where("units IS NOT NULL").count() // PARTITION_BLOCKS)
    more = parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df, key: df.repartition(parts, key) if more else df  # noqa: E731  partitions grow with the data
    counts = materialize(pair_counts(lists), "pair_counts")
    back = spread(lists.select("block", "at", "pair"), "pair").join(counts, "pair").select(F.col("block").alias("home"), "at", "count", "best")
    kind = kept.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in _DOC)}, n_best bigint, count_sum bigint, groups_sha256 string"
    return spread(rows, "block").groupBy("block").cogroup(back.groupBy("home")).applyInArrow(_valued, schema)


def op13(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return alignments(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
