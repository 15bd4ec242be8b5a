"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints: the majority bit over the XXH64 hashes of a text's word shingles, repeats included. Two fingerprints that differ in
at most 3 of 64 bits agree in at least 3 of 6 blocks, so each distinct fingerprint is sent out under each of the 20 choices of 3
blocks (about 32 bits a key, so a key's chance company stays small for billions of fingerprints). Equal fingerprints are one row
before that; rows of a key meet in one task, are verified by Hamming distance, and the task passes on a spanning forest of the
links among them, not the links: connectivity is all that components need, and no link between different fingerprints is lost.

Hot groups: exact copies collapse into their fingerprint. Many near copies that share a key stay distinct fingerprints of 8
bytes; a task resolves a key by a search that removes what it has reached (each step is one vectorised comparison), and keys
with more than ``SPLIT`` fingerprints are first divided, over tasks and inside of them, by a further pigeonhole over the bits outside
the key, in pieces of which close pairs must share one. No fingerprint or link of all documents reaches the driver.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows and equal ids are judged
row by row (they share the fingerprint, so the component); rows with a null id get a component like others, whose id ignores nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_batches, materialize, record_batch, tidy
from .components import connected_components

DISTANCE = 3
SEED = 42
#: Bit ranges of the 6 blocks.
BLOCKS = ((0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64))
SPLIT = 20_000
#: One of so many fingerprints is looked at to find the keys of more than ``SPLIT``.
SAMPLED = 64
BROADCAST_IDS = 1_000_000


def shingle_hashes(raw: bytes | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words of the text with A-Z lower-cased, joined by spaces; of all words if there are fewer."""
    own = (raw or b"").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    if len(own) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(own), SEED)], np.uint64)
    line = memoryview(b" ".join(own))
    stops = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(own) - size + 1
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops[size - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(shingle_hashes(raw, shingle)) for raw in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            return record_batch({"doc_id": batch.column(0), "fp": pa.array(found.view(np.int64))})

        return each

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(kept, make, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _mask(low: int, high: int) -> int:
    return (1 << high) - (1 << low)


#: Masks of the 20 choices of 3 blocks.
CHOICES = [sum(_mask(*BLOCKS[i]) for i in c) for c in combinations(range(6), 3)]


def forest(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links (indices) of a spanning forest of the fingerprints within ``distance`` of each other."""
    left = np.arange(len(fps))
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= distance
            if near.any():
                more = left[near].tolist()
                yield from ((at, x) for x in more)
                reached += more
                left = left[~near]


def _key_links(fps: np.ndarray, mask: int, distance: int) -> Iterator[tuple[int, int]]:
    """Links among the fingerprints of one key; a large key is divided by pieces of the bits outside of its mask."""
    if len(fps) <= SPLIT:
        yield from ((int(fps[a]), int(fps[b])) for a, b in forest(fps, distance))
        return
    free = [b for b in range(64) if not mask >> b & 1]
    if len(free) < 2 * (distance + 1):  # equal in nearly all bits: few distinct values can be left
        yield from ((int(fps[a]), int(fps[b])) for a, b in forest(fps, distance))
        return
    for piece in (free[i :: distance + 1] for i in range(distance + 1)):
        bits = np.uint64(sum(1 << b for b in piece))
        part = fps & bits
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                yield from _key_links(fps[group], mask | int(bits), distance)


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (choice, key, piece, part, fp) in this order; yields the links of each group of equal first four."""
    rest: tuple[np.ndarray, ...] | None = None

    def changes(rows: tuple[np.ndarray, ...]) -> np.ndarray:
        return np.flatnonzero(np.logical_or.reduce([np.diff(x) != 0 for x in rows[:4]])) + 1

    def close(choice: np.ndarray, key: np.ndarray, piece: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        change = changes((choice, key, piece, part))
        starts, stops = np.concatenate([[0], change]), np.concatenate([change, [len(key)]])
        some = stops - starts > 1
        a: list[int] = []
        b: list[int] = []
        pair = stops - starts == 2  # most groups are chance pairs: all of them at once
        x, y = fp[starts[pair]], fp[starts[pair] + 1]
        near = np.bitwise_count(x ^ y) <= distance
        a += x[near].tolist()
        b += y[near].tolist()
        for s, e in zip(starts[some & ~pair].tolist(), stops[some & ~pair].tolist(), strict=True):
            mask = CHOICES[int(choice[s])] | (PIECES[int(choice[s])][int(piece[s])] if piece[s] >= 0 else 0)
            for p, q in _key_links(fp[s:e], mask, distance):
                a.append(p)
                b.append(q)
        if not a:
            return None
        return record_batch({"a": pa.array(np.array(a, np.uint64).view(np.int64)), "b": pa.array(np.array(b, np.uint64).view(np.int64))})

    for batch in batches:
        if not batch.num_rows:
            continue
        now = (*(batch.column(i).to_numpy() for i in range(4)), batch.column(4).to_numpy().view(np.uint64))
        if rest is not None:
            now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
        cut = int(changes(now)[-1:].sum())
        rest = tuple(x[cut:] for x in now)
        if cut and (out := close(*(x[:cut] for x in now))) is not None:
            yield out
    if rest is not None and (out := close(*rest)) is not None:
        yield out


def _free_pieces(mask: int) -> list[int]:
    """Masks of the four pieces of the bits outside of a key: two fingerprints of the key that differ in 3 bits at most agree in one."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << b for b in free[i::4]) for i in range(4)]


PIECES = [_free_pieces(m) for m in CHOICES]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints of ``fps.fp`` that chains of links within ``distance`` connect.

    Keys of which a sample tells that they have more than ``SPLIT`` fingerprints are dealt out over tasks by the pieces of their other bits;
    the sample only balances the work, as either way no close pair is apart."""
    if not 0 <= distance <= 3:
        raise ValueError("the 6 blocks guarantee pairs that differ in at most 3 bits")
    keys = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(CHOICES)))
    spread = fps.select("fp").distinct().select("fp", F.explode(keys).alias("k")).select("k.choice", "k.key", "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sampled = spread.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0).groupBy("choice", "key").count()
    hot = materialize(sampled.where(F.col("count") > max(1, SPLIT // SAMPLED)).select("choice", "key", F.lit(True).alias("hot")), "hot_keys", 0)
    many = hot.count()
    if many:
        spread = spread.join(F.broadcast(hot) if many <= BROADCAST_IDS else hot, ["choice", "key"], "left")
        pieces = F.array(*(F.lit(_signed(m)) for own in PIECES for m in own))
        piece = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(-1)))).alias("piece")
        part = F.when(F.col("piece") >= 0, F.col("fp").bitwiseAND(F.element_at(pieces, F.col("choice") * 4 + F.greatest(F.col("piece"), F.lit(0)) + 1))).otherwise(F.lit(0).cast("long"))
        spread = spread.select("choice", "key", piece, "fp").select("choice", "key", "piece", part.alias("part"), "fp")
        dealt = spread.repartition(n, "choice", "key", "piece", "part").sortWithinPartitions("choice", "key", "piece", "part", "fp")
    else:
        dealt = spread.repartition(n, "choice", "key").sortWithinPartitions("choice", "key", "fp")
        dealt = dealt.select("choice", "key", F.lit(-1).alias("piece"), F.lit(0).cast("long").alias("part"), "fp")
    return dealt.mapInArrow(tidy(lambda batches: _links(batches, distance)), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that chains of links within ``distance`` reach."""
    prints = materialize(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(fingerprint_links(distinct, distance))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    members = materialize(grouped.join(lowest, "root").select(F.col("fp"), "component_id"), "components")
    return prints.join(members, "fp")


# --- A lower similarity than blocks of 64 bits can guarantee: blocks of a wider fingerprint ---

#: Bits of a block at least; there are more once a block's value would have over ``MATES`` texts by chance.
BLOCK, MATES = 14, 512
#: The chance that two sets at the stated similarity agree in no block.
MISSED = 1 / 2000
#: Words of 64 bits that go with each key, for the Hamming check.
CHECKED = 4
#: Sets of so few shingles may differ in more bits than larger ones at one similarity: they are also sent out whole and without each one
#: shingle, under negative keys, and need no Hamming check among themselves.
FEW = 9
#: Keys up to this size are compared whole; of larger ones those outside of the largest component with all others, in up to so many comparisons.
TOGETHER, COMPARED = 2_048, 1 << 28
#: Keys with up to so many close pairs of two components send them out; the members of others are compared round by round.
PAIRS = 10
#: Blocks by which groups of copies are linked before all blocks are looked at, and how many neighbours under a key a text is compared with there.
EARLY, NEIGHBOURS = (3, 9), 32
#: Members of a key that one task compares.
PIECE = 5_000
#: Hashes of a shingle set that a member of a large group is compared by.
SKETCH = 1024
_COMPARED = 1 << 20
#: A set of shingles and the comparison of two weigh as much as so many rows of numbers.
_SET_ROWS, _PAIR_ROWS = 200, 50


def differing(similarity: float) -> float:
    """The share of bits in which fingerprints of large sets of this Jaccard similarity differ, at most (sets of equal size)."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def most_differing(similarity: float, bits: int) -> int:
    """Bits that such fingerprints differ in, plus 4.5 deviations. Sets of more than ``FEW`` shingles differ in no more than 0.005 of the bits more
    than large ones."""
    share = differing(similarity) + 0.005
    return int(bits * share + 4.5 * np.sqrt(bits * share * (1 - share)))


def block_shape(n: int, similarity: float) -> tuple[int, int]:
    """(blocks, bits of a block) for ``n`` texts: so many that all but ``MISSED`` of the pairs at the similarity agree in one."""
    return block_shape_of(n, differing(similarity))


def block_shape_of(n: int, share: float) -> tuple[int, int]:
    """The same for pairs that differ in this share of the bits."""
    width = max(BLOCK, int(np.ceil(np.log2(max(n, 1) / MATES))))
    agree = (1 - share) ** width
    return max(1, int(np.ceil(np.log(MISSED) / np.log1p(-min(agree, 1 - 1e-9))))), width


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """The fingerprint of the hashes, and ``words`` - 1 more of other hashes mixed from each of them. Ties go to the bit of the first hash: were
    they zeros, unrelated small sets would agree too often."""
    ones = np.zeros(64 * words, np.int64)
    if len(hashes) and len(hashes) % 2 == 0:
        hashes = np.concatenate([hashes, hashes[:1]])
    seeds = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):
        own = hashes[at : at + 255]
        mixed = own[:, None] + seeds
        mixed ^= mixed >> np.uint64(30)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(27)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        mixed[:, 0] = own
        ones += np.unpackbits(mixed.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def block_keys(prints: np.ndarray, blocks: int | range, width: int) -> np.ndarray:
    """The key of each block (columns) of each fingerprint (rows of words): two that differ in fewer bits than there are blocks share one."""
    blocks = range(blocks) if isinstance(blocks, int) else blocks
    keys = np.empty((len(prints), len(blocks)), np.int64)
    for at, i in enumerate(blocks):
        word, shift = divmod(i * width, 64)
        value = prints[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | prints[:, word + 1] << np.uint64(64 - shift)
        keys[:, at] = (value & np.uint64((1 << width) - 1)) | np.uint64(i << width)
    return keys


def few_keys(hashes: np.ndarray, similarity: float) -> bytes:
    """Keys of a set of up to ``FEW`` shingles: of the whole set, and without each one where that is as similar."""
    n = len(hashes)
    if not 0 < n <= FEW:
        return b""
    parts = [hashes] + ([np.delete(hashes, i) for i in range(n)] if n > 1 and n - 1 >= similarity * n - 1e-9 else [])
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), SEED) | 1 << 63 for x in parts], np.uint64).tobytes()


def _keys(rooted: DataFrame, blocks: range, width: int) -> DataFrame:
    """(key, node, root, size, c0, ..) for each of the blocks of each fingerprint, and for each key of a small set: the words go with it for the Hamming
    check. A root that is the node itself is null: rows of nodes that have no link compress well."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            few = batch.column(1).to_pylist()
            keys = np.concatenate([block_keys(prints, blocks, width).ravel(), np.frombuffer(b"".join(few), np.int64)])
            of = np.arange(batch.num_rows)
            of = np.concatenate([np.repeat(of, len(blocks)), np.repeat(of, [len(x) // 8 for x in few])])
            checks = {f"c{i}": pa.array(prints[of, i].view(np.int64)) for i in range(CHECKED)}
            return record_batch({"key": pa.array(keys), "node": batch.column(2).take(pa.array(of)), "root": batch.column(3).take(pa.array(of)), "size": batch.column(4).take(pa.array(of)), **checks})

        return each

    words = ", ".join(f"c{i} bigint" for i in range(CHECKED))
    return map_batches(rooted.select("print", "few", "node", F.nullif("root", "node").alias("root"), "size"), make, f"key bigint, node bigint, root bigint, size bigint, {words}")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows in order of ``key`` (and ``piece``, if there are any): tables of whole groups, with where the groups start and stop."""
    rest: pa.Table | None = None

    def changes(rows: pa.Table) -> np.ndarray:
        new = np.diff(rows["key"].to_numpy()) != 0
        if "piece" in rows.column_names:
            new |= np.diff(rows["piece"].to_numpy()) != 0
        return np.flatnonzero(new) + 1

    def bounds(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        starts = np.concatenate([[0], changes(rows)])
        return rows, starts, np.concatenate([starts[1:], [rows.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        cut = int(changes(now)[-1:].sum())
        rest = now.slice(cut)
        if cut:
            yield bounds(now.slice(0, cut))
    if rest is not None:
        yield bounds(rest)


def _members(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Keys, nodes, roots, sizes and words of rows of ``_keys``."""
    roots = pc.coalesce(rows["root"], rows["node"])
    return rows["key"].to_numpy(), rows["node"].to_numpy(), roots.to_numpy(), rows["size"].to_numpy(), [rows[f"c{i}"].to_numpy().view(np.uint64) for i in range(CHECKED)]


def _met_before(key: np.ndarray, one: list[np.ndarray], other: list[np.ndarray], width: int) -> np.ndarray:
    """Whether each pair under a key agrees in an earlier block, as far as these words tell: it has met there."""
    met = np.zeros(len(key), bool)
    for i in range(64 * CHECKED // width):
        word, shift = divmod(i * width, 64)
        x, y = one[word] >> np.uint64(shift), other[word] >> np.uint64(shift)
        if shift + width > 64:
            x, y = (v | w[word + 1] << np.uint64(64 - shift) for v, w in ((x, one), (y, other)))
        met |= ((x ^ y) & np.uint64((1 << width) - 1) == 0) & (key >> width > i)
    return met


def _neighbours(batches: Iterator[pa.RecordBatch], most: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows of ``_keys`` in order of keys and words: for each the nearest one of another root, if near and of a size of ``least`` of the other at least, of the ``NEIGHBOURS`` before it and
    the key's first one, as a pair (a, b)."""
    for rows, starts, stops in _groups(batches):
        key, node, root, own_size, checks = _members(rows)
        sizes = stops - starts
        start = np.repeat(starts, sizes)
        best, mate = np.full(len(key), 64 * CHECKED + 1), np.full(len(key), -1)

        def look(at: np.ndarray, other: np.ndarray) -> None:
            differ = sum(np.bitwise_count(x[at] ^ x[other]).astype(np.int64) for x in checks)
            alike = np.minimum(own_size[at], own_size[other]) >= least * np.maximum(own_size[at], own_size[other]) - 1e-9
            nearer = ((differ <= most) | (key[at] < 0)) & alike & (root[at] != root[other]) & (differ < best[at])
            best[at[nearer]], mate[at[nearer]] = differ[nearer], other[nearer]

        at = np.arange(len(key))
        for step in range(1, NEIGHBOURS + 1):
            at = at[at - step >= start[at]]
            look(at, at - step)
        at = np.flatnonzero(np.arange(len(key)) - start > NEIGHBOURS)
        look(at, start[at])
        found = np.flatnonzero(mate >= 0)
        if len(found):
            x, y = node[found], node[mate[found]]
            yield record_batch({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})


def _mates(batches: Iterator[pa.RecordBatch], most: int, least: float, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_keys`` in order of keys: the pairs (a, b) of two roots that differ in ``most`` of these bits at most, have sizes that are near (``least``) and have not met
    under an earlier key, with a null key. Of keys with many of them the key with the members (a) of such pairs; of very large keys that have many members outside of their largest root, the key with all its members."""
    for rows, starts, stops in _groups(batches):
        key, node, root, own_size, checks = _members(rows)
        sizes = stops - starts
        group, stop = np.repeat(np.arange(len(sizes)), sizes), np.repeat(stops, sizes)
        left = np.zeros(len(key), bool)
        a, b, d = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def near(one: np.ndarray, other: np.ndarray) -> None:
            alike = np.minimum(own_size[one], own_size[other]) >= least * np.maximum(own_size[one], own_size[other]) - 1e-9
            apart = np.flatnonzero((root[one] != root[other]) & alike)
            one, other = one[apart], other[apart]
            differ = sum(np.bitwise_count(x[one] ^ x[other]).astype(np.int64) for x in checks)
            close = np.flatnonzero((differ <= most) | (key[one] < 0))
            one, other, differ = one[close], other[close], differ[close]
            new = ~_met_before(key[one], [x[one] for x in checks], [x[other] for x in checks], width)
            a.append(one[new])
            b.append(other[new])
            d.append(differ[new])

        at, step = np.flatnonzero(sizes[group] <= TOGETHER), 1
        while len(at := at[at + step < stop[at]]):  # each row with the one ``step`` places on in its group
            near(at, at + step)
            step += 1
        for g in np.flatnonzero(sizes > TOGETHER).tolist():
            s, e = int(starts[g]), int(stops[g])
            names, of, counts = np.unique(root[s:e], return_inverse=True, return_counts=True)
            outside = s + np.flatnonzero(of != counts.argmax())
            if len(outside) * (e - s) > COMPARED:
                left[s:e] = True
                continue
            inside = s + np.flatnonzero(of == counts.argmax())
            for i, x in enumerate(outside.tolist()):  # those outside with each other once, and with all inside
                for others in (inside, outside[i + 1 :]):
                    near(np.full(len(others), x), others)
        x, y, differ = np.concatenate(a), np.concatenate(b), np.concatenate(d)
        few = np.bincount(group[x], minlength=len(sizes))[group[x]] <= PAIRS
        left[x[~few]] = left[y[~few]] = True
        x, y = node[x[few]], node[y[few]]
        n, more = len(x), int(left.sum())
        if n + more:
            yield record_batch({
                "key": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(key[left])]),
                "a": pa.array(np.concatenate([np.minimum(x, y), node[left]])),
                "b": pa.concat_arrays([pa.array(np.maximum(x, y)), pa.nulls(more, pa.int64())]),
            })


class _Sketches:
    """The shingle sets of the members of a group, each by its smallest ``SKETCH`` hashes; sets of no more are whole, and most are."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes]):
        self.sizes = sizes
        lengths = np.fromiter((len(x) // 4 for x in sketches), np.int64, len(sketches))
        self.stops = np.cumsum(lengths)
        self.starts = self.stops - lengths
        self.flat = np.frombuffer(b"".join(sketches), np.uint32)
        self.names, self.of = np.unique(self.flat, return_inverse=True)
        self.mark = np.zeros(len(self.names), bool)
        self.whole = lengths == sizes

    def alike(self, one: int, others: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of the others that may be ``similarity`` alike or more, and their estimates: exact, but for equal 32-bit hashes, where both are whole."""
        small, large = np.minimum(self.sizes[one], self.sizes[others]), np.maximum(self.sizes[one], self.sizes[others])
        others = others[small >= similarity * large]
        both = self.whole[others] & self.whole[one]
        exact, rest = others[both], others[~both]
        found = np.zeros(len(exact))
        if len(exact):
            own = self.of[self.starts[one] : self.stops[one]]
            self.mark[own] = True
            counts = self.stops[exact] - self.starts[exact]
            places = np.arange(counts.sum()) + np.repeat(self.starts[exact] - (np.cumsum(counts) - counts), counts)
            shared = np.add.reduceat(self.mark[self.of[places]], np.cumsum(counts) - counts, dtype=np.int64) if (counts > 0).all() else np.zeros(len(exact), np.int64)
            self.mark[own] = False
            found = shared / np.maximum(self.sizes[one] + self.sizes[exact] - shared, 1)
        guessed = np.array([self._guess(one, x) for x in rest.tolist()])
        slack = 4 * np.sqrt(similarity * (1 - similarity) / SKETCH)
        near, maybe = found >= similarity - 1e-9, guessed >= similarity - slack
        return np.concatenate([exact[near], rest[maybe]]), np.concatenate([found[near], guessed[maybe]])

    def _guess(self, a: int, b: int) -> float:
        x, y = (self.flat[self.starts[i] : self.stops[i]] for i in (a, b))
        most = min(v[-1] for v, i in ((x, a), (y, b)) if not self.whole[i])
        x, y = x[x <= most], y[y <= most]
        shared = len(np.intersect1d(x, y, assume_unique=False))
        return shared / max(len(x) + len(y) - shared, 1)


def _nearest(batches: Iterator[pa.RecordBatch], most: int, bits_apart: int, similarity: float | None) -> Iterator[pa.RecordBatch]:
    """Rows (key, piece, node, root, asks, print, size, sketch) in order of keys and pieces: pairs (a, b) of each asking member and the ``most``
    that are likest to it of those which have another root, a fingerprint near enough and, by their sketches, may be ``similarity`` alike (None: the
    fingerprint alone decides). Their key is null but where
    others were left of the same roots, which need no other round if the pair is a link; the key with null ends, once, if some were
    left of other roots. Where ``asks`` is null, all ask but the largest part: pairs with it are found from their other end."""
    for rows, starts, stops in _groups(batches):
        node, root = rows["node"].to_numpy(), rows["root"].to_numpy()
        for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
            ids, roots = node[s:e], root[s:e]
            names, of, counts = np.unique(roots, return_inverse=True, return_counts=True)
            if len(names) == 1:
                continue
            part = rows.slice(s, e - s)
            prints = np.frombuffer(b"".join(part["print"].to_pylist()), np.uint64).reshape(e - s, -1)
            bits = 64 * prints.shape[1]
            sizes = part["size"].to_numpy()
            sketches = _Sketches(sizes, part["sketch"].to_pylist())
            asking = np.flatnonzero(of != counts.argmax() if part["asks"].null_count else part["asks"].to_numpy())
            step, left = max(1, _COMPARED // prints.size), False
            for at in range(0, len(asking), step):
                own = asking[at : at + step]
                differ = np.bitwise_count(prints[own][:, None, :] ^ prints[None, :, :]).sum(axis=2, dtype=np.int32)
                differ[roots[own][:, None] == roots[None, :]] = bits + 1
                a: list[np.ndarray] = []
                b: list[np.ndarray] = []
                depends: list[np.ndarray] = []
                for i, row in zip(own.tolist(), differ, strict=True):
                    tiny = (sizes <= FEW) & (sizes[i] <= FEW) & (row <= bits) & (similarity is not None)
                    near = np.flatnonzero((row <= bits_apart) | tiny)
                    likeness = -row[near]
                    if similarity is not None:
                        near, likeness = sketches.alike(i, near, similarity)
                    near = near[np.argsort(-likeness, kind="stable")]
                    left = left or not np.isin(of[near[most:]], of[near[:most]]).all()
                    b.append(ids[near[:most]])
                    a.append(np.full(len(b[-1]), ids[i]))
                    depends.append(np.full(len(b[-1]), len(near) > most))
                x, y = np.concatenate(a), np.concatenate(b)
                if len(x):
                    keys = pa.array(np.full(len(x), part["key"][0].as_py(), np.int64), mask=~np.concatenate(depends))
                    yield record_batch({"key": keys, "a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})
            if left:
                yield record_batch({"key": part["key"].slice(0, 1).combine_chunks(), "a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64())})


def _pieces(rooted: DataFrame, alone: bool) -> DataFrame:
    """(key, piece, node, root, asks, print, size, sketch): the members of keys of more than ``PIECE`` dealt out over pieces. ``alone``: the pieces are to find
    links of their own only, which leaves few parts of a large group; else members outside of a key's largest part ask in every piece,
    so that no pair of two parts is missed."""
    of = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("size"), F.max_by("root", F.struct("n", "root")).alias("main"))
    of = of.where(F.col("size") > PIECE).select("key", F.ceil(F.col("size") / PIECE).cast("int").alias("pieces"), "main")
    sized = rooted.join(of, "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own = F.pmod(F.xxhash64("node", "key"), F.col("pieces")).cast("int")
    none = F.lit(None).cast("boolean")
    if alone:
        return sized.select("key", own.alias("piece"), "node", "root", none.alias("asks"), "print", "size", "sketch")
    dealt = sized.select("key", own.alias("piece"), "node", "root", F.when(F.col("pieces") > 1, False).alias("asks"), "print", "size", "sketch")
    asking = sized.where((F.col("pieces") > 1) & (F.col("root") != F.col("main"))).select("key", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "node", "root", F.lit(True).alias("asks"), "print", "size", "sketch")
    return dealt.unionByName(asking)


def _shingle_sets(wanted: DataFrame, kept: DataFrame, shingle: int, most: int | None = None) -> DataFrame:
    """(node, hashes) of rows (node, digest, first): the 64-bit hashes of its shingle set, in order; ``most``: the smallest ones, by their upper 32 bits."""
    ids = wanted.select(F.col("first").alias("doc_id")).distinct()
    side = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids

    def shingled() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(shingle_hashes(raw, shingle)) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            held = [x.tobytes() if most is None else (x[:most] >> np.uint64(32)).astype(np.uint32).tobytes() for x in sets]
            return record_batch({"digest": pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), "size": pa.array(map(len, sets), pa.int64()), "hashes": pa.array(held, pa.binary())})

        return each

    read = map_batches(kept.join(side, "doc_id", "left_semi").select("doc_id", "text"), shingled, "digest binary, size bigint, hashes binary")
    return read.join(wanted.select("node", "digest"), "digest").groupBy("node").agg(F.first("size").alias("size"), F.first("hashes").alias("hashes"))


def _sketched(members: DataFrame, kept: DataFrame, shingle: int) -> DataFrame:
    """(node, print, size, sketch) of members of large groups."""
    members = materialize(members.select("node", "digest", "first", "print"), "members")
    sets = _shingle_sets(members, kept, shingle, SKETCH).withColumnRenamed("hashes", "sketch")
    return members.select("node", "print").join(sets, "node")


def _alike(pairs: DataFrame, distinct: DataFrame, kept: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the (written) pairs (a, b) of nodes of ``distinct`` whose whole shingle sets have the Jaccard similarity or more, written: of
    those that pass the Hamming check of all bits the sets are read."""

    def checked() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 4))
            m, n = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            near = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most_differing(similarity, 64 * x.shape[1])
            near = (near | (np.maximum(m, n) <= FEW)) & (np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-9)
            at = pa.array(np.flatnonzero(near))
            return record_batch({"a": batch.column(0).take(at), "b": batch.column(1).take(at)})

        return each

    prints = distinct.select("node", "print", "size")
    both = pairs.join(prints.toDF("a", "x", "m"), "a").join(prints.toDF("b", "y", "n"), "b").select("a", "b", "x", "m", "y", "n")
    pairs = materialize(map_batches(both, checked, "a bigint, b bigint"), "checked", pairs.count())
    n = pairs.count()
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(distinct.select("node", "digest", "first"), "node"), "compared", 2 * n)
    count = wanted.count()

    def compared() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            near = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if min(len(x), len(y)) / max(len(x), len(y), 1) < similarity:
                    continue
                both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
                shared = int((both[1:] == both[:-1]).sum())
                near[i] = shared / max(len(both) - shared, 1) >= similarity
            at = pa.array(np.flatnonzero(near))
            return record_batch({"a": batch.column(0).take(at), "b": batch.column(1).take(at)})

        return each

    sets = materialize(_shingle_sets(wanted, kept, shingle).select("node", "hashes"), "sets", _SET_ROWS * count)
    first, second = sets.toDF("a", "x"), sets.toDF("b", "y")
    met = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")
    found = materialize(map_batches(met, compared, "a bigint, b bigint"), "alike", _PAIR_ROWS * n)
    discard(wanted, sets)
    return found


def components_by_blocks(nodes: DataFrame, blocks: int, width: int, *, bits: int, bits_apart: Callable[[int], int], alike: Callable[[DataFrame], DataFrame], sketched: Callable[[DataFrame], DataFrame], similarity: float | None) -> DataFrame:
    """(node, root) of all nodes of the written table ``nodes(node, print, few, size, ..)`` that have a link: pairs of fingerprints of ``bits`` bits that agree in
    a block (or a key of ``few``), differ in ``bits_apart(bits)`` bits at most, and pass ``alike``, which gives the links of a written table of pairs.

    Groups of copies are linked first, by a few blocks in which each looks at its neighbours only. What all blocks are then asked for is pairs of
    two components, so a group costs rows for what is not linked yet, whatever its size. Of keys with many such pairs the members go through
    rounds: each sends its nearest few of other components, until no pair of two components is left."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = bits_apart(64 * CHECKED)
    roots: DataFrame | None = None
    done: DataFrame | None = None

    def rooted() -> DataFrame:
        if roots is None:
            return nodes.withColumn("root", F.col("node"))
        return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def link(pairs: DataFrame, most_rows: int | None = None) -> DataFrame:
        """Verifies pairs that have not been so yet, and connects those that are links, which it returns."""
        nonlocal roots, done
        pairs = pairs.distinct()
        pairs = materialize(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs", most_rows)
        done = pairs if done is None else done.unionByName(pairs)
        links = alike(pairs) if pairs.take(1) else pairs
        if links.take(1):  # what was linked before is a star by now
            before = links if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)
            roots = connected_components(before)
        return links

    first = 0
    for last in EARLY:
        if last < blocks:
            dealt = _keys(rooted(), range(first, last), width).repartition(n, "key").sortWithinPartitions("key", "c0", "c1", "node")
            link(dealt.mapInArrow(tidy(lambda batches: _neighbours(batches, near, similarity or 0.0)), "a bigint, b bigint"))
        first = last
    dealt = _keys(rooted(), range(blocks), width).repartition(n, "key").sortWithinPartitions("key", "node")
    mates = materialize(dealt.mapInArrow(tidy(lambda batches: _mates(batches, near, similarity or 0.0, width)), "key bigint, a bigint, b bigint"), "mates")
    link(mates.where("key IS NULL").select("a", "b"))
    large = mates.where("key IS NOT NULL").select("key", F.col("a").alias("node"))
    members_count = large.count()
    none = nodes.select("node", F.col("node").alias("root")).limit(0)
    if not members_count:
        return none if roots is None else roots
    split = bool(large.groupBy("key").count().where(F.col("count") > PIECE).take(1))
    alone, most = split, 1
    sketches = materialize(sketched(large.select("node").distinct().join(nodes, "node")), "sketches")
    while members_count:
        linked = large.withColumn("root", F.col("node")) if roots is None else large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        linked = materialize(linked, "roots", members_count)
        open_keys = linked.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        members = linked.join(open_keys, "key", "left_semi").join(sketches, "node")
        if split:
            members = materialize(members, "rooted")
            pieces = _pieces(members, alone)
        else:
            pieces = members.select("key", F.lit(0).alias("piece"), "node", "root", F.lit(None).cast("boolean").alias("asks"), "print", "size", "sketch")
        dealt = pieces.repartition(n, "key", "piece").sortWithinPartitions("key", "piece", "node")
        found = dealt.mapInArrow(tidy(lambda batches, most=most: _nearest(batches, most, bits_apart(bits), similarity)), "key bigint, a bigint, b bigint")
        found = materialize(found, "nearest")
        discard(linked)
        links = link(found.where("a <> b").select("a", "b"), found.count())
        if not alone:
            left = found.where("key IS NOT NULL").join(links, ["a", "b"], "left_anti")
            large = materialize(large.join(left.select("key").distinct(), "key", "left_semi"), "large", members_count)
            most *= 16
        members_count, alone = large.count(), False
        if split:
            discard(members)
    return none if roots is None else roots


def shingle_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, digest, root, component_id) of each row with an id: the digest of its shingle set; the group that chains of sets with a
    Jaccard similarity of ``similarity`` or more connect; the smallest id in the group. Written."""
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")

    blocks, width = block_shape(kept.count(), similarity)
    words = max(CHECKED, -(-blocks * width // 64))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            digests, prints, sizes, few = [], [], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                hashes = np.unique(shingle_hashes(raw, shingle))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                prints.append(wide_fingerprint(hashes, words).tobytes())
                sizes.append(len(hashes))
                few.append(few_keys(hashes, similarity))
            return record_batch({"doc_id": batch.column(0), "digest": pa.array(digests, pa.binary()), "print": pa.array(prints, pa.binary()), "size": pa.array(sizes, pa.int64()), "few": pa.array(few, pa.binary())})

        return each

    prints = materialize(map_batches(kept, make, "doc_id bigint, digest binary, print binary, size bigint, few binary"), "fingerprints")
    # Numbers of the rows of a written table: they stay what they are.
    distinct = materialize(prints.groupBy("digest", "print", "size", "few").agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    roots = components_by_blocks(
        distinct, blocks, width, bits=64 * words, bits_apart=lambda bits: most_differing(similarity, bits), similarity=similarity,
        alike=lambda pairs: _alike(pairs, distinct, kept, shingle, similarity), sketched=lambda members: _sketched(members, kept, shingle),
    )
    rooted = distinct.join(roots, "node", "left").select("digest", "first", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = rooted.select("digest", "root").join(lowest, "root")
    return materialize(prints.select("doc_id", "digest").join(members, "digest").select("doc_id", "digest", "root", "component_id"), "groups")


def similar_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) by chains of documents whose shingle sets have a Jaccard similarity of ``similarity`` or more; ids are integers.

    The method is that of the module, on a wider fingerprint: the majority bits over 64-bit hashes of the set's shingles, as many words
    of them as its blocks need. Texts that agree in a block are candidates. Two fingerprints that differ in fewer bits than there are
    blocks agree in one for sure; at a similarity of 0.8 some 15 of 100 bits differ, and the number of blocks (72 of 14 bits for up to 8
    million texts) is such that a pair there agrees in one with a probability of 0.9995, at 0.85 of 0.99998 and above of more. Beyond that
    blocks get a bit wider each time the texts double, which takes 1.18 times as many. Small sets may differ in more bits: those of up to ``FEW``
    shingles also meet where they are equal but for one shingle. Candidates must pass a Hamming check of 128 bits and one of all bits; then every
    link is verified on the whole shingle sets (64-bit hashes), so none is under ``similarity``.

    Copies are linked first by ``EARLY`` blocks, in which each text looks at its neighbours only; from then on only pairs of two components count.
    Keys of more than ``PAIRS`` such pairs go through rounds: each member sends its nearest few of other components, which are verified and connected, and again sixteen times as many until no pair of two components is left: groups, however large, cost rows in proportion. There a
    candidate must pass a Hamming check of all bits, and then one by the whole sets of up to ``SKETCH`` shingles, or by an estimate with a slack of
    four deviations for longer ones. A key of more than ``PIECE`` texts is dealt out over tasks, and those outside of its largest component
    meet every piece of it. Equal sets (exact copies) are one row before that;
    rows with a null id are left out; rows of one id with unlike texts are judged each by its text."""
    return shingle_groups(docs, doc_id=doc_id, text=text, shingle=shingle, similarity=similarity).select("doc_id", "component_id")


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs``, all columns, without the rows of a group of similar texts other than one of the smallest id (of several rows of that id,
    the one with the smallest hash). Rows of one id whose texts are unlike are documents of their own, each kept or not by its own
    group. A row with a null id is kept. All texts without words are one group."""
    groups = shingle_groups(docs, doc_id=doc_id, text=text, shingle=shingle, similarity=similarity)
    stays = F.col("doc_id") == F.col("component_id")
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(stays).alias("stay"))
    ids = materialize(ids.where("stay = 0 OR n > 1"), "judged_ids")
    number = F.col(doc_id).cast("long")
    gone = ids.where("stay = 0").select(F.col("doc_id").alias("__gone"))
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, number == F.col("__gone"), "left_anti")
    again = ids.where("stay > 0").select(F.col("doc_id").alias("__again"))
    if not again.take(1):
        return left
    # Rows of repeated ids: each by its own text, and one row of each group.
    once = left.join(again, number == F.col("__again"), "left_anti")
    place = docs.columns.index(text)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            digests = [xxhash.xxh3_128_digest(np.unique(shingle_hashes(raw, shingle)).tobytes()) for raw in batch.column(place).cast(pa.binary()).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, "__digest"])

        return each

    rows = left.join(again, number == F.col("__again"), "left_semi")
    schema = T.StructType([*rows.schema.fields, T.StructField("__digest", T.BinaryType())])
    kept = groups.where(stays).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("root").alias("__root")).distinct()
    met = map_batches(rows, make, schema).join(kept, "__digest")
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    best = met.where(F.col("__id") == number).groupBy("__id", "__root").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias("__row"))
    return once.unionByName(best.select("__row.*"))


def op6(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
