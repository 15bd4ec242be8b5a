"""Document fingerprints by a randomised edit embedding.

A walk reads a text from its start: at each step it writes the character it stands on and then stays or moves on by one, as a random bit
of the step and the character says. All texts share the bits, so two texts are written alike until they differ, and walks
that an edit has parted meet again after a while: an edit distance of k becomes a Hamming distance of some k * k at most, mostly far
less. A text is written by ``WALKS`` walks; a walk ends with the text, after some two steps a character.

Bits are sampled from what the walks wrote: each of ``BITS`` slots has a random priority for each step of its walk and takes the step of the
highest priority before the walk's end, and of the character there one hashed bit. Two texts choose a step together with the
probability that the shorter walk has of the longer one, so the share of equal bits tells the share of equal steps in the
longer walk, whatever the lengths: ``likeness`` is 2 * equal - 1, at least 0. The steps that a slot can take in turn (its records) are as many as
the logarithm of the length.

The walk is computed by the step at which each character is left (the next set bit of its class of characters), for all
texts of a batch at once, in stretches of ``STRETCH`` characters; a walk can be stopped and taken on, so a text of any length takes a bounded
amount besides itself, and an edited text goes on from where the two texts part.

Plan of ``edited_fingerprints``, which meets each document with the next one: ranges of ids are cut at ids of a bounded, hashed sample (which
only balances the work), texts are dealt out once by range, and the first document of a range goes to the range before it as well. Of
``similar_fingerprints``: distinct fingerprints meet under bands of sampled bits and are verified by the Hamming distance of all bits.

Edge cases: null and empty texts have the fingerprint of no bits and are alike among themselves only; rows of one id are ordered by their texts; rows
without an id come before all others; a single row is its own next one; no rows give no rows. Rows of one id (or of none) are in one range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, record_batch, slices, table, tidy
from .simhash import block_shape_of, components_by_blocks

WALKS, BITS = 4, 512
#: Steps after which the random bits repeat, and classes of characters that have bits of their own.
PERIOD, CLASSES = 1 << 13, 64
SEED = 42
#: Characters of a text that are walked before bits are taken.
STRETCH = 1 << 20
#: Bytes of texts that are walked at once.
TOGETHER_BYTES = 8 << 20
#: Texts under which a walk goes on one by one: a step of few texts at once costs more.
FEW = 24
#: Sampled ids for each range.
SAMPLED = 40
#: Fingerprints at least so like are linked.
LIKENESS = 0.9
_RECORDS = 64
_NEVER = 1 << 60


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stays(seed: int) -> np.ndarray:
    """[walk, step, class]: steps that a walk which comes to a character of the class at a step takes to leave it."""
    bits = _mixed(np.arange(WALKS * PERIOD, dtype=np.uint64) + np.uint64(seed << 32)).reshape(WALKS, PERIOD)
    moves = (bits[:, :, None] >> np.arange(CLASSES, dtype=np.uint64)) & np.uint64(1) != 0
    at = np.where(moves, np.arange(PERIOD)[None, :, None], 3 * PERIOD)
    later = np.concatenate([at, at + PERIOD], axis=1)  # the bits repeat
    following = np.minimum.accumulate(later[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
    return (following - np.arange(PERIOD)[None, :, None] + 1).astype(np.uint8)


def _records(seed: int) -> np.ndarray:
    """[k, slot]: the steps at which a slot's highest priority so far comes up, in order; as many as any text can reach."""
    draws = _mixed(np.arange(BITS * _RECORDS * 2, dtype=np.uint64) + np.uint64((seed + 1) << 32)).reshape(2, _RECORDS, BITS)
    draws = (draws >> np.uint64(11)).astype(np.float64) / (1 << 53) + 1e-17
    steps = np.zeros((_RECORDS, BITS), np.int64)
    lowest = draws[0, 0]
    for k in range(1, _RECORDS):
        wait = np.log(draws[1, k]) / np.log1p(-np.minimum(lowest, 1 - 1e-16))
        steps[k] = np.minimum(steps[k - 1] + 1 + np.minimum(wait, _NEVER).astype(np.int64), _NEVER)
        lowest = lowest * draws[0, k]
    return steps


class State(NamedTuple):
    """Where the walks of each text are (steps done) and the bits so far."""

    steps: np.ndarray
    bits: np.ndarray


class Embedding:
    def __init__(self, seed: int = SEED):
        stays = _stays(seed)
        self.stays = stays.reshape(-1)
        self.own = [x.tobytes() for x in stays.reshape(WALKS, -1)]
        self.records = _records(seed)
        self.slot = np.arange(BITS, dtype=np.uint64) << np.uint64(40)
        self.per = BITS // WALKS
        self.every, self.firsts = np.arange(BITS), np.arange(WALKS + 1) * self.per

    def start(self, n: int) -> State:
        return State(np.zeros((n, WALKS), np.int64), np.zeros((n, BITS), bool))

    def advance(self, state: State, texts: list[np.ndarray]) -> State:
        """The state after these further characters (code points) of each text."""
        steps, bits = state.steps.copy(), state.bits.copy()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        for at in range(0, int(lengths.max(initial=0)), STRETCH):
            rows = np.flatnonzero(lengths > at)
            self._stretch(steps, bits, rows, [texts[i][at : at + STRETCH] for i in rows.tolist()])
        return State(steps, bits)

    def _stretch(self, steps: np.ndarray, bits: np.ndarray, rows: np.ndarray, texts: list[np.ndarray]) -> None:
        """Walks on, in place."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.concatenate(texts)
        classes = (_mixed(codes.astype(np.uint64)) >> np.uint64(58)).astype(np.int32)
        stops = np.cumsum(lengths)
        starts = stops - lengths
        begin = steps[rows]
        rounds = begin & ~np.int64(PERIOD - 1)  # whole periods: what follows counts from there, in 32 bits
        left = self._left(classes, starts, lengths, (begin - rounds).astype(np.int32))
        ends = left[:, stops - 1].T + rounds
        steps[rows] = ends
        reached = (self.records < ends.max()).any(axis=1).sum()  # records that no walk has come to are left out
        records = self.records[: max(1, int(reached))]
        written, place_of = [], []
        for i, (s, e) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
            taken = self._taken(records, ends[i])
            new = np.flatnonzero(taken >= np.repeat(begin[i], self.per))
            step = taken[new]
            parts = np.searchsorted(new, self.firsts).tolist()
            for w in range(WALKS):
                own = (step[parts[w] : parts[w + 1]] - rounds[i, w]).astype(np.int32)
                written.append(codes[s:e][np.searchsorted(left[w, s:e], own, "right")])
            place_of.append((new, step))
        slots, at = (np.concatenate(x) for x in zip(*place_of, strict=True))
        row = np.repeat(rows, [len(x) for x, _ in place_of])
        symbol = np.concatenate(written).astype(np.uint64) ^ (at.astype(np.uint64) << np.uint64(21))
        bits[row, slots] = _mixed(symbol + self.slot[slots]) & np.uint64(1) != 0

    def _taken(self, records: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The step that each slot takes of walks that end before these steps."""
        below = records.reshape(len(records), WALKS, self.per) < ends[:, None]
        k = below.sum(axis=0, dtype=np.uint8).reshape(-1)
        return records[np.maximum(k, 1) - 1, self.every]

    def _left(self, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """[walk, place]: the step before which each walk has left the character there."""
        left = np.empty((WALKS, len(classes)), np.int32)
        order = np.argsort(-lengths, kind="stable")
        start, length = starts[order], lengths[order]
        now = np.ascontiguousarray(begin[order].T)
        offset = (np.arange(WALKS, dtype=np.int32) * (PERIOD * CLASSES))[:, None]
        longest = int(length[FEW - 1]) if len(length) >= FEW else 0  # up to here at least ``FEW`` texts go on
        going = np.searchsorted(-length, -np.arange(longest), "left")
        for i, m in enumerate(going.tolist()):
            place = start[:m] + i
            own = now[:, :m]
            at = own & (PERIOD - 1)
            at <<= 6
            at += classes[place]
            at += offset
            own += self.stays.take(at)
            left[:, place] = own
        for r in range(int(np.searchsorted(-length, -longest, "left"))):
            s, e = int(start[r]) + longest, int(start[r] + length[r])
            rest = classes[s:e].tobytes()[::4]  # one byte each
            for w in range(WALKS):
                stays = self.own[w]
                walked = accumulate(rest, lambda j, c, stays=stays: j + stays[(j & (PERIOD - 1)) << 6 | c], initial=int(now[w, r]))
                left[w, s:e] = np.fromiter(walked, np.int32, e - s + 1)[1:]
        return left


def packed(bits: np.ndarray) -> np.ndarray:
    """Words of 64 bits, by row: the slots of all walks in turn, so that each word and each band samples every walk."""
    turns = bits.reshape(len(bits), WALKS, -1).transpose(0, 2, 1).reshape(len(bits), -1)
    return np.packbits(turns, axis=1, bitorder="little").view("<u8")


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """0 to 1, of rows of words."""
    return np.maximum(0.0, 1 - np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64) / (one.shape[1] * 32))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint(text: str | None, embedding: Embedding | None = None) -> str:
    embedding = embedding or Embedding()
    return packed(embedding.advance(embedding.start(1), [_code_points(text or "")]).bits)[0].tobytes().hex()


class Edited(NamedTuple):
    prints: np.ndarray
    edited: np.ndarray
    n_chars: np.ndarray
    texts: list[str]


def edited_prints(embedding: Embedding, texts: list[str]) -> Edited:
    """Fingerprints of all texts, and of all but the last one's edited text: its second half gives way to as much of the next text's start."""
    codes = [_code_points(t) for t in texts]
    n = np.fromiter(map(len, codes), np.int64, len(codes))
    half = n // 2
    cut = n - half
    parted = embedding.advance(embedding.start(len(texts)), [c[:k] for c, k in zip(codes, cut.tolist(), strict=True)])
    whole = embedding.advance(parted, [c[k:] for c, k in zip(codes, cut.tolist(), strict=True)])
    ends = half[:-1].tolist()
    edited = embedding.advance(State(parted.steps[:-1], parted.bits[:-1]), [c[:k] for c, k in zip(codes[1:], ends, strict=True)])
    made = [t[: len(t) - k] + z[:k] for t, z, k in zip(texts[:-1], texts[1:], ends, strict=True)]
    return Edited(packed(whole.bits), packed(edited.bits) if len(made) else np.empty((0, BITS // 64), np.uint64), n, made)


def _ranges(docs: DataFrame, n: int) -> tuple[list[int], int | None]:
    """First ids of all ranges but the first (ids of the table, so each is the first of its range), and the least id."""
    ids = docs.where("doc_id IS NOT NULL").select("doc_id")
    found = ids.agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).first()
    wanted = n * SAMPLED
    sample = ids
    if found["n"] > wanted:
        sample = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, 1.5 * wanted / found["n"]))))
    drawn = sorted({r[0] for r in sample.limit(2 * wanted).collect()} - {found["least"]})
    step = max(1, -(-len(drawn) // n))
    return drawn[step - 1 :: step], found["least"]


def _range_of(value: Column, firsts: list[int]) -> Column:
    """The number of range starts up to a value, by bisection."""
    if not firsts:
        return F.lit(0)
    starts = F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>")
    steps = [1 << k for k in range(len(firsts).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.coalesce(F.get(starts, at + s - 1) <= value, F.lit(False)), at + s).otherwise(at))


def edited_fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, print, edited_print, near_edited, near_next) of each row and its edited text; ids are integers. Prints are
    the bytes of the bits."""
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), kept.rdd.getNumPartitions())
    firsts, least = _ranges(kept, n)
    last = len(firsts)
    own = F.coalesce(_range_of(F.col("doc_id"), firsts), F.lit(0))
    # The first row of a range also ends the range before it; the first of all ends the last one.
    nulls = kept.where("doc_id IS NULL").limit(1).count()
    is_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)
    starts = F.coalesce(F.array_contains(F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>"), F.col("doc_id")), F.lit(False)) if firsts else F.lit(False)
    ends = F.when(is_first, F.lit(last)).when(starts, F.col("at") - 1)
    placed = kept.withColumn("at", own).withColumn("ends", ends)
    to = F.array_compact(F.array(F.struct(F.col("at"), F.lit(False).alias("after")), F.when(F.col("ends").isNotNull(), F.struct(F.col("ends").alias("at"), F.lit(True).alias("after")))))
    dealt = placed.select(F.explode(to).alias("to"), "doc_id", "text").select("to.at", "to.after", "doc_id", "text").repartitionById(last + 1, F.col("at"))
    return dealt.sortWithinPartitions("at", "after", F.asc_nulls_first("doc_id"), "text").mapInArrow(tidy(_edited), "doc_id bigint, n_chars bigint, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (at, after, doc_id, text) in order: each with the next one of its range."""
    embedding = Embedding()
    held: list[tuple[int, bool, int | None, str]] = []
    for whole in batches:
        for batch in slices(whole, TOGETHER_BYTES):
            texts = [(t or b"").decode("utf-8", "replace") for t in batch.column(3).cast(pa.binary()).to_pylist()]
            rows = held + list(zip(*(batch.column(i).to_pylist() for i in range(3)), texts, strict=True))
            held = rows[-1:]
            found = edited_prints(embedding, [r[3] for r in rows])
            place = np.array([i for i, r in enumerate(rows[:-1]) if not r[1]], np.int64)
            if not len(place):
                continue
            prints, edited = found.prints[place], found.edited[place]
            yield record_batch({
                "doc_id": pa.array([rows[i][2] for i in place.tolist()], pa.int64()),
                "n_chars": pa.array(found.n_chars[place]),
                "edited_sha256": pa.array([hashlib.sha256(found.texts[i].encode("utf-8", "surrogatepass")).hexdigest() for i in place.tolist()]),
                "print": pa.array([x.tobytes() for x in prints], pa.binary()),
                "edited_print": pa.array([x.tobytes() for x in edited], pa.binary()),
                "near_edited": pa.array(likeness(prints, edited)),
                "near_next": pa.array(likeness(prints, found.prints[place + 1])),
            })


def most_apart(bits: int, likely: float = LIKENESS) -> int:
    """Bits of a sample of ``bits`` that fingerprints so like differ in at most, with a slack of 4.5 deviations where it is not all of them."""
    share = (1 - likely) / 2
    return int(bits * share if bits == BITS else bits * share + 4.5 * np.sqrt(bits * share * (1 - share)))


def similar_fingerprints(prints: DataFrame, *, key: str = "doc_id", print_: str = "print", likely: float = LIKENESS) -> DataFrame:
    """``prints`` with ``component_id``: the least ``key`` that chains of fingerprints of a ``likeness`` of ``likely`` or more reach. Two such meet if they
    agree in one of the bands of sampled bits, which all but ``simhash.MISSED`` of the pairs at ``likely`` do; equal ones always meet."""
    distinct = prints.groupBy(F.col(print_).alias("print")).agg(F.min(key).alias("first")).withColumn("node", F.monotonically_increasing_id())
    distinct = materialize(distinct.select("print", "node", "first", F.lit(b"").alias("few"), F.lit(1).cast("long").alias("size")), "distinct")
    blocks, width = block_shape_of(distinct.count(), (1 - likely) / 2)
    if blocks * width > BITS:
        raise ValueError(f"{blocks} bands of {width} bits are more than {BITS} bits: ask for more bits or a higher likeness")
    most = most_apart(BITS, likely)

    def alike(pairs: DataFrame) -> DataFrame:
        sides = distinct.select("node", "print")
        both = pairs.join(sides.toDF("a", "x"), "a").join(sides.toDF("b", "y"), "b").select("a", "b", "x", "y")

        def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
                near = pa.array(np.flatnonzero(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most))
                return record_batch({"a": batch.column(0).take(near), "b": batch.column(1).take(near)})

            return each

        return materialize(map_batches(both, make, "a bigint, b bigint"), "alike")

    roots = components_by_blocks(
        distinct, blocks, width, bits=BITS, bits_apart=lambda bits: most_apart(bits, likely), similarity=None, alike=alike,
        sketched=lambda members: members.select("node", "print", "size", F.lit(b"").alias("sketch")),
    )
    rooted = distinct.join(roots, "node", "left").select("print", "first", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = materialize(rooted.join(lowest, "root").select("print", "component_id"), "components")
    return prints.join(found.withColumnRenamed("print", "__print"), F.col(print_) == F.col("__print")).drop("__print")


def op11(spark, sf_dir: str) -> DataFrame:
    prints = materialize(edited_fingerprints(table(spark, sf_dir, "documents")), "prints")
    found = similar_fingerprints(prints)
    return found.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("print")).alias("fingerprint"), F.lower(F.hex("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next", "component_id")
