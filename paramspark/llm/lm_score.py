"""LM scoring by subword lattices.

A text is a run of pieces of an existing vocabulary and an end; its probability is the sum over all segmentations. Pieces do not
cross words, so a text's log probability is the sum over its words of a word's marginal, found by a forward recursion in log
space over the word's lattice, plus that of the end. The vocabulary's own scores weigh the segmentations first; with them,
forward-backward passes over all counted words of the training texts give each piece its expected count, and the smoothed
counts give the piece probabilities that score. The vocabulary itself is never changed.

Plan: documents are cut once into blocks of at most ``BLOCK_BYTES`` of text. A block keeps its own word list with training
counts, and each document as word numbers of its block. Word lists meet in one aggregation by word (a frequent word is one row
a block), each distinct word's lattice is solved once, and the results join the word lists by word and go back to their blocks,
where they meet the documents. So what is shuffled is block vocabularies and word numbers, not words of documents. To the driver
come the totals and one expected count for each piece of the vocabulary, whose size bounds what is broadcast.

Probabilities add up to at most 1 over all texts: a hundredth of each step's mass is for the bytes of letters that the vocabulary
lacks, the rest for the pieces and the end.

Edge cases: null and empty texts are just the end; repeated rows count and are scored one by one; without training rows counts are
0 and the vocabulary's own scores stand; a word of over ``LONG`` letters is solved in stretches, with 16 bytes a letter besides (scoring
keeps one stretch only), whatever its length.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, record_batch, slices, tidy

BLOCK_BYTES = 24 << 20
#: Blocks whose words one partition of a shuffle may hold on average; where the session sets fewer partitions, there are more.
PARTITION_BLOCKS = 8
#: Weight of the vocabulary's own scores, in counts.
PRIOR_COUNTS = 1000.0
#: Passes of expected counts over the training words.
ROUNDS = 3
#: Part of the mass of each step that is for bytes of letters that are no piece.
BYTE_SHARE = 0.01
BYTE_COST = math.log(BYTE_SHARE / 256)
#: Letters of a word beyond which it is solved alone, in stretches of this many letters.
LONG, STRETCH = 512, 1 << 14
NEVER = -1e30
SPACE = "▁"
_FACTOR, _SLOT, _SHIFT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 46


def vocabulary(path: str) -> dict[str, float]:
    """Pieces and their log weights from the vocabulary's scores. Scores that fall by whole ranks (byte-pair merges) are read as
    the ranks of a Zipf distribution; others are log probabilities already."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = np.array([model.get_score(i) for i in usual])
    if (scores == np.round(scores)).all():
        scores = -np.log(scores.max() - scores + 10.0)
    scores = scores - scores.max() - np.log(np.exp(scores - scores.max()).sum())
    return dict(zip([model.id_to_piece(i) for i in usual], scores.tolist(), strict=True))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Lattice:
    """Solves the lattices of many words at once: words of one length share each step of the recursion."""

    def __init__(self, pieces: dict[str, float]):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.weights = np.array([*pieces.values(), NEVER])
        self.longest = max(map(len, pieces), default=1)
        # Pieces by a 64-bit hash of their letters: layers of slots, each piece in the first layer whose slot is free.
        self.keys = np.zeros(len(pieces) + 1, np.uint64)
        layers: list[np.ndarray] = []
        for p, i in self.number.items():
            h = 0
            for c in p:
                h = (h * _FACTOR + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            self.keys[i] = h
            slot = (h * _SLOT & 0xFFFFFFFFFFFFFFFF) >> _SHIFT
            for layer in layers:
                if layer[slot] == len(pieces):
                    break
            else:
                layers.append(layer := np.full(1 << (64 - _SHIFT), len(pieces), np.int32))
            layer[slot] = i
        self.layers = layers

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes; the last number: none."""
        slot = (hashes * np.uint64(_SLOT)) >> np.uint64(_SHIFT)
        found = np.full(hashes.shape, len(self.weights) - 1, np.int32)
        for layer in self.layers:
            x = layer[slot]
            np.copyto(found, x, where=self.keys[x] == hashes)
        return found

    def _edges(self, words: list[str], n: int) -> tuple[dict[tuple[int, int], np.ndarray], dict[tuple[int, int], np.ndarray]]:
        """Piece numbers and log weights of each stretch that some word has as a piece, and of each letter."""
        codes = _codes("".join(words)).reshape(len(words), n).T
        numbers, weights = {}, {}
        hashes, none = np.zeros((n + 1, len(words)), np.uint64), len(self.weights) - 1
        for length in range(1, min(n, self.longest) + 1):
            hashes = hashes[: n - length + 1] * np.uint64(_FACTOR) + codes[length - 1 :] + np.uint64(1)
            found = self._find(hashes)
            if length == 1:
                value = self.weights[found]
                bytes_of = 1 + (codes >= 0x80).astype(int) + (codes >= 0x800) + (codes >= 0x10000)
                value = np.where(found == none, bytes_of * BYTE_COST, value)
                used = range(n)
            else:
                used = np.flatnonzero((found != none).any(axis=1)).tolist()
                value = {i: self.weights[found[i]] for i in used}
            for i in used:
                numbers[i, i + length], weights[i, i + length] = found[i], value[i]
        return numbers, weights

    @staticmethod
    def _total(terms: list[np.ndarray]) -> np.ndarray:
        if len(terms) == 1:
            return terms[0]
        stack = np.stack(terms)
        top = stack.max(axis=0)
        return top + np.log(np.exp(stack - top).sum(axis=0))

    def _forward(self, weights: dict[tuple[int, int], np.ndarray], n: int, size: int) -> list[np.ndarray]:
        by_end: dict[int, list[int]] = defaultdict(list)
        for i, j in weights:
            by_end[j].append(i)
        alpha = [np.zeros(size)]
        for j in range(1, n + 1):
            alpha.append(self._total([alpha[i] + weights[i, j] for i in by_end[j]]))
        return alpha

    def _stretches(self, word: str, back: bool = False) -> Iterator[tuple[int, list[list[tuple[int, int, float]]]]]:
        """For stretches of a long word, in order (``back``: from the end): the first position, and for each position the edges (length, piece,
        log weight) that end there (``back``: that begin there)."""
        codes, n, none = _codes(word), len(word), len(self.weights) - 1
        places = range(0, n, STRETCH)
        for at in reversed(places) if back else places:
            stop = min(n, at + STRETCH)
            # Letters from which edges of this stretch begin or to which they go.
            low, high = (at, min(n, stop + self.longest - 1)) if back else (max(0, at - self.longest + 1), stop)
            own = codes[low:high]
            edges: list[list[tuple[int, int, float]]] = [[] for _ in range(stop - at)]
            hashes = np.zeros(len(own) + 1, np.uint64)
            for length in range(1, min(len(own), self.longest) + 1):
                hashes = hashes[: len(own) - length + 1] * np.uint64(_FACTOR) + own[length - 1 :] + np.uint64(1)
                found = self._find(hashes)
                value = self.weights[found]
                if length == 1:
                    bytes_of = 1 + (own >= 0x80).astype(int) + (own >= 0x800) + (own >= 0x10000)
                    value = np.where(found == none, bytes_of * BYTE_COST, value)
                    used = np.arange(len(own))
                else:
                    used = np.flatnonzero(found != none)
                place = low + used - at + (0 if back else length - 1)
                inside = (place >= 0) & (place < stop - at)
                for i, f, v in zip(place[inside].tolist(), found[used[inside]].tolist(), value[used[inside]].tolist(), strict=True):
                    edges[i].append((length, f, v))
            yield at, edges

    def _long_forward(self, word: str, keep: bool) -> tuple[float, np.ndarray]:
        """Log weight of all segmentations of a long word; ``keep``: and of all its beginnings."""
        every = np.zeros(len(word) + 1 if keep else 1)
        last = [0.0]  # of the positions before, the latest at the end
        for at, edges in self._stretches(word):
            for i, into in enumerate(edges):
                terms = [last[-length] + v for length, _, v in into]
                top = max(terms)
                last.append(top + math.log(sum(math.exp(t - top) for t in terms)) if len(terms) > 1 else top)
                if keep:
                    every[at + i + 1] = last[-1]
            del last[: -self.longest]
        return last[-1], every

    def _long_expected(self, word: str, count: float, out: np.ndarray) -> None:
        """Adds the expected uses of each piece in a long word that occurs ``count`` times."""
        total, alpha = self._long_forward(word, True)
        after = [0.0]  # of the positions behind, the nearest at the end
        for at, edges in self._stretches(word, back=True):
            for i in range(len(edges) - 1, -1, -1):
                terms = [after[-length] + v for length, _, v in edges[i]]
                begin = float(alpha[at + i]) - total
                for (_, piece, _), t in zip(edges[i], terms, strict=True):
                    out[piece] += count * math.exp(begin + t)
                top = max(terms)
                after.append(top + math.log(sum(math.exp(t - top) for t in terms)) if len(terms) > 1 else top)
            del after[: -self.longest]

    @staticmethod
    def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            n = int(sizes[group[0]]) if len(group) else 0
            step = max(1, (1 << 21) // max(1, n * min(n, 16)))  # bounds the edges held at once
            for at in range(0, len(group), step):
                yield n, group[at : at + step]

    def marginals(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's summed weight over all segmentations; words carry their leading mark."""
        out = np.zeros(len(words))
        for n, group in self._by_length(words):
            if n > LONG:
                out[group] = [self._long_forward(words[i], False)[0] for i in group.tolist()]
                continue
            _, weights = self._edges([words[i] for i in group.tolist()], n)
            out[group] = self._forward(weights, n, len(group))[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, over words that occur ``counts`` times."""
        out = np.zeros(len(self.weights))
        for n, group in self._by_length(words):
            if n > LONG:
                for i in group.tolist():
                    self._long_expected(words[i], float(counts[i]), out)
                continue
            numbers, weights = self._edges([words[i] for i in group.tolist()], n)
            alpha = self._forward(weights, n, len(group))
            by_start: dict[int, list[int]] = defaultdict(list)
            for i, j in weights:
                by_start[i].append(j)
            beta: list[np.ndarray] = [np.zeros(len(group))] * (n + 1)
            for i in range(n - 1, -1, -1):
                beta[i] = self._total([beta[j] + weights[i, j] for j in by_start[i]])
            for (i, j), found in numbers.items():
                share = np.exp(alpha[i] + weights[i, j] + beta[j] - alpha[n]) * counts[group]
                out += np.bincount(found, share, len(out))
        out[-1] = 0
        return out


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows of two kinds. Words: (block, at, word, n), n in training texts. Documents: (block, doc_id, held_out, numbers, ends)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        id_type = None

        def close(docs: list[tuple[pa.Scalar, bool, np.ndarray]], number: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
            block = (part << 32) + made
            counts = np.zeros(len(number), np.int64)
            for _, held, own in docs:
                if not held:
                    counts += np.bincount(own, minlength=len(number))
            by_use = np.argsort(-counts, kind="stable")  # small numbers for frequent words: these compress well
            place = np.empty_like(by_use)
            place[by_use] = np.arange(len(by_use))
            names = pa.array(list(number), pa.binary()).take(pa.array(by_use))
            for at in range(0, len(names), 50_000):
                n = min(50_000, len(names) - at)
                yield record_batch({"block": pa.array(np.full(n, block)), "at": pa.array(np.arange(at, at + n)), "word": names.slice(at, n), "n": pa.array(counts[by_use[at : at + n]]), "doc_id": pa.nulls(n, id_type), "held_out": pa.nulls(n, pa.bool_()), "numbers": pa.nulls(n, pa.binary())})
            for at in range(0, len(docs), 1000):
                some = docs[at : at + 1000]
                n = len(some)
                yield record_batch({"block": pa.array(np.full(n, block)), "at": pa.nulls(n, pa.int64()), "word": pa.nulls(n, pa.binary()), "n": pa.nulls(n, pa.int64()), "doc_id": pa.array([d[0].as_py() for d in some], id_type), "held_out": pa.array([d[1] for d in some], pa.bool_()), "numbers": pa.array([zstandard.compress(place[d[2]].astype("<u4").tobytes()) for d in some], pa.binary())})

        number: dict[bytes, int] = {}
        held: list[tuple[pa.Scalar, bool, np.ndarray]] = []
        size = 0
        for whole in batches:
            for batch in slices(whole):
                id_type = batch.column(0).type
                for doc_id, out, raw in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    own = (raw or b"").lower().split()
                    if held and size + len(raw or b"") > BLOCK_BYTES:
                        yield from close(held, number)
                        made, number, held, size = made + 1, {}, [], 0
                    size += len(raw or b"")
                    held.append((doc_id, out, np.array([number.setdefault(w, len(number)) for w in own], np.uint32)))
        if held:
            yield from close(held, number)

    return docs.mapInArrow(tidy(run), f"block bigint, at bigint, word binary, n bigint, doc_id {kind}, held_out boolean, numbers binary")


def _scored(texts: pa.Table, words: pa.Table, model: tuple[int, int, int, float]) -> pa.Table:
    """The documents of a block with the counts and marginals of its words."""
    total, distinct, ends, end_log = model
    at = words["at"].to_numpy()
    count, marginal = np.zeros(len(at), np.int64), np.zeros(len(at))
    count[at], marginal[at] = words["c"].to_numpy(), words["m"].to_numpy()
    floor = math.log10(total + distinct + 1)
    base = np.log10(count + 1.0) - floor
    n_tokens, n_known, base_score, score = [], [], [], []
    for data in texts["numbers"].to_pylist():
        own = np.frombuffer(zstandard.decompress(data), "<u4")
        n_tokens.append(len(own) + 1)
        n_known.append(int((count[own] > 0).sum()) + (ends > 0))
        base_score.append(float(base[own].sum()) + math.log10(ends + 1) - floor)
        score.append((float(marginal[own].sum()) + end_log) / math.log(10))
    n = len(n_tokens)
    return pa.table({"doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([total] * n, pa.int64()), "base_score": pa.array(base_score, pa.float64()), "score": pa.array(score, pa.float64())})


def _expected_counts(counted: DataFrame, weights: dict[str, float]) -> list:
    """(piece, n): expected uses of each piece over all counted words; one row for each piece of the vocabulary at most."""
    shared = counted.sparkSession.sparkContext.broadcast(weights)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        out = np.zeros(len(shared.value) + 1)
        for batch in batches:
            words = [SPACE + w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            out += lattice.expected(words, batch.column(1).to_numpy())
        used = np.flatnonzero(out)
        yield record_batch({"piece": pa.array(used), "n": pa.array(out[used])})

    return counted.where("c > 0").mapInArrow(tidy(expect), "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()


def lm_scores(docs: DataFrame, vocabulary_path: str, *, doc_id: str = "doc_id", text: str = "text", modulus: int = 7, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); learns from rows that are not held out."""
    spark = docs.sparkSession
    kept = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), modulus).alias("held_out"), F.col(text).alias("text"))
    blocks = materialize(_blocks(kept), "blocks")
    lists, texts = blocks.where("word IS NOT NULL").select("block", "at", "word", "n"), blocks.where("numbers IS NOT NULL").select("block", "doc_id", "held_out", "numbers")
    sizes = texts.agg(F.count_if(~F.col("held_out")).alias("ends"), F.count_distinct("block").alias("blocks")).first()
    parts = -(-sizes["blocks"] // PARTITION_BLOCKS)
    few = parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df, key: df.repartition(parts, key) if few else df  # noqa: E731  partitions grow with the data
    counted = materialize(spread(lists.select("word", "n"), "word").groupBy("word").agg(F.sum("n").alias("c")), "words")
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count_if(F.col("c") > 0).alias("distinct")).first()
    ends = sizes["ends"]
    total, distinct = sums["total"] + ends, sums["distinct"] + (ends > 0)

    prior = vocabulary(vocabulary_path)
    usual = 1 - BYTE_SHARE
    weights, mass = {p: w + math.log(usual) for p, w in prior.items()}, 1.0
    for _ in range(rounds):
        counts = PRIOR_COUNTS * np.exp(np.array(list(prior.values())))
        for row in _expected_counts(counted, weights):
            counts[row["piece"]] += row["n"]
        mass = (counts.sum() + ends + 1.0) / usual
        weights = dict(zip(prior, np.log(counts / mass).tolist(), strict=True))
    learned = spark.sparkContext.broadcast(weights)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(learned.value)
        for batch in batches:
            words = [SPACE + w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            yield record_batch({"word": batch.column(0), "c": batch.column(1), "m": pa.array(lattice.marginals(words))})

    solved = counted.mapInArrow(tidy(solve), "word binary, c bigint, m double")
    back = spread(lists.select("block", "at", "word"), "word").join(solved, "word").select(F.col("block").alias("home"), "at", "c", "m")
    model = (int(total), int(distinct), int(ends), math.log((ends + 1.0) / mass))
    kind = kept.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return spread(texts, "block").groupBy("block").cogroup(back.groupBy("home")).applyInArrow(lambda a, b: _scored(a, b, model), schema)


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
