"""Exact repeated-substring removal by a distributed sort of suffixes.

A byte goes if some ``LENGTH``-byte string that covers it also starts in a document with a smaller id. Suffixes are sorted where the
text itself says so: every window of ``LENGTH`` bytes elects the position in it whose ``GRAM``-byte gram hashes lowest. Equal windows
elect equal positions, so windows can only be equal if the suffixes at their elected positions share a gram. A suffix stands for the
run of windows that elected it; its key is the text from the position to the run's end, then the text before it back to the
run's start, so equal keys are equal runs and keys with equal grams are neighbours in the order.

1. Documents are dealt into runs by a hash of the id (one shuffle of the texts, which all three readers reuse). Each run sends the
   hashes of its grams to hash buckets, which answer with one bit each: does the gram occur in another document? Most suffixes
   of natural text end here; none that matters does.
2. Each run sorts its remaining suffixes and coalesces equal keys: only the smallest id's copy is sent on, the others are decided.
   Sorted keys are front-coded (shared prefix with the one before, rest) and exchanged by range of their first bytes.
3. Each range merges its runs with a loser tree over (key, known common prefix with the last output): a longer known prefix wins
   unseen, and only equal ones compare bytes, from there on. Neighbours that share a gram are settled: of equal keys the smallest
   id keeps its windows; keys that differ are compared window by window.
4. Decisions return to the runs, which cut the bytes.

Runs hold about ``RUN_BYTES`` of text or less, so memory follows a run (or one longer text). A hot passage is one key in each run;
copies are decided where they lie. A gram's neighbours in a range are its distinct contexts, held while that gram is settled.

Edge cases: null texts are empty; texts under ``LENGTH`` bytes keep everything; equal ids (repeated rows) never cut each other; a
null id counts as larger than all others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1
RUN_BYTES = 24 << 20
CHUNK_BYTES = 2 << 20
SAMPLE_DOCS, SAMPLE_HEADS = 2000, 64
_LAST = np.iinfo(np.int64).max
_MULTIPLE = np.uint64(1)


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    h = (a ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += b
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _elect(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elected positions of the windows inside documents, with the first and last window start that elected each."""
    if len(data) < LENGTH:
        return (np.empty(0, np.int64),) * 3
    words = _words(data)
    key = _mix(words[: len(data) - GRAM + 1], words[8:], 0)
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(len(key), dtype=np.uint64)  # of equal hashes the leftmost
    best, reach = key, 1
    while reach * 2 <= SPAN:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    n = len(data) - LENGTH + 1
    best = np.minimum(best[:n], best[SPAN - reach : SPAN - reach + n])
    inside = np.ones(n, bool)
    for e in ends.tolist():
        inside[max(0, e - LENGTH + 1) : e] = False
    at = np.flatnonzero(inside)
    owner = (best[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return owner[first], at[first], at[last]


class Run:
    """The documents of a run in order of their ids, as one buffer, and the suffixes that their windows elect."""

    def __init__(self, table: pa.Table):
        ids = table["doc_id"].combine_chunks().cast(pa.int64())
        number = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
        texts = [x or b"" for x in table["text"].cast(pa.binary()).combine_chunks().to_pylist()]
        by_id = number.tolist()
        # Rows come in any order, another one each time they are read: equal ids are put in order of their texts.
        order = sorted(range(len(texts)), key=lambda i: (by_id[i], texts[i]))
        self.ids, self.number = ids.take(pa.array(order, pa.int64())), number[order]
        texts = [texts[i] for i in order]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.bytes = b"".join(texts)
        self.data = np.frombuffer(self.bytes, np.uint8)
        parts = []
        first = 0
        while first < len(texts):  # a chunk of whole documents at a time
            stop = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + CHUNK_BYTES, "right")))
            a, b = int(self.starts[first]), int(self.ends[stop - 1])
            parts.append([x + a for x in _elect(self.data[a:b], self.ends[first:stop] - a)])
            first = stop
        self.at, self.low, self.high = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(3))
        self.doc = np.searchsorted(self.ends, self.at, "right")

    def hashes(self) -> np.ndarray:
        """48 bits of each suffix's gram; two grams that share them only keep a suffix that could have been left out."""
        if not len(self.at):
            return np.empty(0, np.uint64)
        words = _words(self.data)
        return _mix(words[self.at], words[self.at + 8], 0x5851F42D4C957F2D) >> np.uint64(16) | _MULTIPLE

    def key(self, i: int) -> bytes:
        at, low, high = int(self.at[i]), int(self.low[i]), int(self.high[i])
        return self.bytes[at : high + LENGTH] + self.bytes[low:at] + bytes((high + LENGTH - at,))


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted 48-bit numbers in 6 planes of bytes, highest last: the high planes hardly change, so they compress."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view("<u8").ravel()


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _gram_hashes(table: pa.Table, buckets: list[int]) -> pa.Table:
    """(bucket, run, hashes): a run's distinct gram hashes, sorted; the lowest bit is set if two of its documents have the gram."""
    run = Run(table)
    hashes = run.hashes()
    order = np.argsort(hashes, kind="stable")
    hashes, number = hashes[order], run.number[run.doc[order]]
    same = hashes[1:] == hashes[:-1]
    first = np.concatenate([[True], ~same])[: len(hashes)]
    multiple = np.zeros(len(hashes), bool)
    multiple[1:] = same & (number[1:] != number[:-1])
    group = np.cumsum(first) - 1
    some = np.zeros(int(first.sum()), bool)
    some[group[multiple]] = True
    distinct = np.where(some, hashes[first], hashes[first] & ~_MULTIPLE)
    cuts = np.searchsorted(_bucket_of(distinct, len(buckets)), np.arange(len(buckets) + 1))
    used = [b for b in range(len(buckets)) if cuts[b + 1] > cuts[b]]
    return pa.table({
        "bucket": pa.array([buckets[b] for b in used], pa.int64()), "place": pa.array(used, pa.int64()), "run": pa.array([table["run"][0].as_py()] * len(used), pa.int64()),
        "hashes": pa.array([_packed(distinct[cuts[b] : cuts[b + 1]]) for b in used], pa.binary()),
    })


def _repeated(table: pa.Table) -> pa.Table:
    """(run, place, bits): for each hash that a run sent to this bucket, whether two documents have it."""
    every = [_unpacked(x) for x in table["hashes"].to_pylist()]
    joined = np.sort(np.concatenate(every))
    bare = joined | _MULTIPLE
    twice = np.concatenate([bare[1:][bare[1:] == bare[:-1]], joined[(joined & _MULTIPLE) > 0]])
    twice = np.unique(twice)
    bits = []
    for own in every:
        slot = np.minimum(np.searchsorted(twice, own | _MULTIPLE), max(0, len(twice) - 1))
        bits.append(np.packbits(twice[slot] == (own | _MULTIPLE) if len(twice) else np.zeros(len(own), bool)).tobytes())
    return pa.table({"home": table["run"], "place": table["place"], "bits": pa.array(bits, pa.binary())})


def _survivors(run: Run, masks: pa.Table, buckets: int) -> np.ndarray:
    """Suffixes whose gram two documents have."""
    hashes = run.hashes()
    distinct = np.unique(hashes)
    cuts = np.searchsorted(_bucket_of(distinct, buckets), np.arange(buckets + 1))
    keep = np.zeros(len(distinct), bool)
    for place, bits in zip(masks["place"].to_pylist(), masks["bits"].to_pylist(), strict=True):
        a, b = int(cuts[place]), int(cuts[place + 1])
        keep[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return np.flatnonzero(keep[np.searchsorted(distinct, hashes)])


def _common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    while a[known : known + 8] == b[known : known + 8]:
        known += 8
    while a[known] == b[known]:
        known += 1
    return known


def front_coded(keys: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared prefix lengths, lengths of the rests and the rests of sorted keys under 256 bytes."""
    shared, rests, last = bytearray(), [], b""
    for k in keys:
        n = _common(last, k)
        shared.append(n)
        rests.append(k[n:])
        last = k
    return bytes(shared), bytes(map(len, rests)), b"".join(rests)


def _sorted_runs(table: pa.Table, masks: pa.Table, buckets: int, splitters: list[int], ranges: list[int]) -> pa.Table:
    """A run's suffixes by range, front-coded, and what the run decides alone (place -1)."""
    out = {n: [] for n in ("range", "place", "run", "shared", "sizes", "rests", "docs", "suffixes", "whole", "alias")}
    if table.num_rows:
        run = Run(table)
        left = _survivors(run, masks, buckets).tolist()
        keys = list(map(run.key, left))
        number = run.number[run.doc[np.array(left, np.int64)]].tolist() if left else []
        name = table["run"][0].as_py()
        whole, alias = [], []
        mine: list[int] = []
        for i in sorted(range(len(keys)), key=keys.__getitem__):  # stable: smaller ids first
            if mine and keys[i] == keys[mine[-1]]:
                if number[i] > number[mine[-1]]:
                    whole.append(left[i])
                else:
                    alias.append((left[i], left[mine[-1]]))
            else:
                mine.append(i)

        def add(range_: int, place: int, own: list[int]) -> None:
            parts = (*front_coded([keys[i] for i in own]), np.array([number[i] for i in own], "<i8").tobytes(), np.array([left[i] for i in own], "<u4").tobytes())
            row = (range_, place, name, *map(zstandard.compress, parts), b"", b"")
            for column, x in zip(out.values(), row, strict=True):
                column.append(x)

        heads = np.array([int.from_bytes(keys[i][:8], "big") for i in mine], np.uint64)
        cuts = [0, *np.searchsorted(heads, np.array(splitters, np.uint64)).tolist(), len(mine)]
        for place, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                add(ranges[place], place, mine[a:b])
        if whole or alias:
            for column, x in zip(out.values(), (ranges[name % len(ranges)], -1, name, b"", b"", b"", b"", b"", np.array(whole, "<u4").tobytes(), np.array(alias, "<u4").tobytes()), strict=True):
                column.append(x)
    kinds = [pa.int64()] * 3 + [pa.binary()] * 7
    return pa.table({n: pa.array(x, k) for (n, x), k in zip(out.items(), kinds, strict=True)})


class LoserTree:
    """Merges front-coded runs. Each run's head carries the length of its common prefix with the last output; a head with the
    longer one is smaller, unseen; equal ones compare bytes from there, and the loser keeps what they have in common."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.runs, self.n = runs, max(1, len(runs))
        self.known, self.heads = [-1] * self.n, [b""] * self.n
        for i in range(len(runs)):
            self._advance(i)
            self.known[i] = min(self.known[i], 0)
        self.losers = [-1] * self.n
        for i in range(self.n):
            self._play(i)

    def _advance(self, i: int) -> None:
        """The next head of a run, known as its run's common prefix; -1 at its end."""
        self.known[i], self.heads[i] = next(self.runs[i], (-1, b""))

    def _play(self, i: int) -> None:
        """Runs ``i`` up the tree, leaving losers; stops at a free node while the tree is built."""
        known, heads, losers = self.known, self.heads, self.losers
        node = (i + self.n) // 2
        while node:
            other = losers[node]
            if other < 0:
                losers[node] = i
                return
            a, b = known[i], known[other]
            if a == b:
                if a >= 0:
                    x, y = heads[i], heads[other]
                    c = _common(x, y, a)
                    if c == len(x) and c == len(y):
                        lost = i > other
                    else:
                        lost = c == len(y) or c < len(x) and y[c] < x[c]
                    if lost:
                        known[i], losers[node], i = c, i, other
                    else:
                        known[other] = c
            elif a < b:
                losers[node], i = i, other
            node //= 2
        losers[0] = i

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """(common prefix with the last one, run, key) in order."""
        if not self.runs:
            return
        while True:
            i = self.losers[0]
            if self.known[i] < 0:
                return
            yield self.known[i], i, self.heads[i]
            self._advance(i)
            self._play(i)


def _decode(shared: bytes, sizes: bytes, rests: bytes) -> Iterator[tuple[int, bytes]]:
    at, last = 0, b""
    for n, size in zip(shared, sizes, strict=True):
        last = last[:n] + rests[at : at + size]
        at += size
        yield n, last


def _windows(key: bytes) -> tuple[bytes, int, int]:
    """A key's stretch of text, how much of it is before the elected position, and its number of windows."""
    right = key[-1]
    before = len(key) - 1 - right
    return key[right:-1] + key[:right], before, len(key) - 1 - LENGTH + 1


def _settle(classes: list[tuple[bytes, int, int, int]], marks: list[dict[int, int]]) -> None:
    """Compares the windows of keys that share a gram; (key, smallest id, run, suffix) each."""
    parts = [(*_windows(k), doc, run, suffix) for k, doc, run, suffix in classes]
    for offset in range(SPAN):
        least: dict[bytes, int] = {}
        held = []
        for text, before, n, doc, run, suffix in parts:
            at = before - offset
            if 0 <= at < n:
                w = text[at : at + LENGTH]
                if doc < least.setdefault(w, doc):
                    least[w] = doc
                held.append((w, at, doc, run, suffix))
        if len(least) < len(held):
            for w, at, doc, run, suffix in held:
                if least[w] < doc:
                    marks[run][suffix] = marks[run].get(suffix, 0) | 1 << at


def _merged(table: pa.Table) -> pa.Table:
    """(run, suffixes, bits, whole, alias): windows to cut (bit j: the j-th window) by suffix; whole suffixes; equal suffixes of one document."""
    rows = table.to_pylist()
    own = [r for r in rows if r["place"] >= 0]
    for r in own:
        r |= {n: zstandard.decompress(r[n]) for n in ("shared", "sizes", "rests", "docs", "suffixes")}
    docs, suffixes = [np.frombuffer(r["docs"], "<i8") for r in own], [np.frombuffer(r["suffixes"], "<u4") for r in own]
    marks: list[dict[int, int]] = [{} for _ in own]
    whole: list[list[int]] = [[] for _ in own]
    done = [0] * len(own)
    group: list[tuple[bytes, int, int, int]] = []  # distinct keys with one gram, each at its smallest id

    for known, i, key in LoserTree([_decode(r["shared"], r["sizes"], r["rests"]) for r in own]):
        doc, suffix = int(docs[i][done[i]]), int(suffixes[i][done[i]])
        done[i] += 1
        if known < GRAM:
            if len(group) > 1:
                _settle(group, marks)
            group = [(key, doc, i, suffix)]
        elif known == len(key) == len(group[-1][0]):
            _, other, run, theirs = group[-1]
            if doc < other:
                whole[run].append(theirs)
                group[-1] = (key, doc, i, suffix)
            elif doc > other:
                whole[i].append(suffix)
            else:  # equal ids are in one run; only null ids meet here
                group.append((key, doc, i, suffix))
        else:
            group.append((key, doc, i, suffix))
    if len(group) > 1:
        _settle(group, marks)
    out = {"home": [], "suffixes": [], "bits": [], "whole": [], "alias": []}
    for r, m, w in zip(own, marks, whole, strict=True):
        if m or w:
            for column, x in zip(out.values(), (r["run"], np.fromiter(m, "<u4", len(m)).tobytes(), np.fromiter(m.values(), "<u8", len(m)).tobytes(), np.array(w, "<u4").tobytes(), b""), strict=True):
                column.append(x)
    for r in rows:
        if r["place"] < 0:
            for column, x in zip(out.values(), (r["run"], b"", b"", r["whole"], r["alias"]), strict=True):
                column.append(x)
    return pa.table({n: pa.array(x, k) for (n, x), k in zip(out.items(), [pa.int64()] + [pa.binary()] * 4, strict=True)})


def _cut(table: pa.Table, decisions: pa.Table, keep_text: bool) -> pa.Table:
    """The documents of a run without the bytes that go."""
    run = Run(table)
    change = np.zeros(len(run.data) + 1, np.int32)
    bits = np.zeros(len(run.at), np.uint64)
    full = np.zeros(len(run.at), bool)
    alias = []
    for r in decisions.to_pylist():
        bits[np.frombuffer(r["suffixes"], "<u4")] |= np.frombuffer(r["bits"], "<u8")
        full[np.frombuffer(r["whole"], "<u4")] = True
        alias.append(np.frombuffer(r["alias"], "<u4").reshape(-1, 2))
    for pair in alias:
        bits[pair[:, 0]] = bits[pair[:, 1]]
        full[pair[:, 0]] = full[pair[:, 1]]
    np.add.at(change, run.low[full], 1)
    np.add.at(change, run.high[full] + LENGTH, -1)
    some = np.flatnonzero(~full & (bits > 0))
    for j in range(SPAN):
        at = run.low[some[(bits[some] >> np.uint64(j)) & np.uint64(1) > 0]] + j
        np.add.at(change, at, 1)
        np.add.at(change, at + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    removed, spans, digests, texts = [], [], [], []
    for a, b in zip(run.starts.tolist(), run.ends.tolist(), strict=True):
        own = gone[a:b]
        n = int(np.count_nonzero(own))
        left = run.data[a:b][~own].tobytes() if n else run.bytes[a:b]
        removed.append(n)
        spans.append(int(np.count_nonzero(own[1:] & ~own[:-1])) + int(own[0]) if n else 0)
        digests.append(hashlib.sha256(left).hexdigest())
        texts.append(left if keep_text else None)
    return pa.table({"doc_id": run.ids, "n_bytes": pa.array(run.ends - run.starts), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(texts, pa.binary())})


def _even_keys(spark: SparkSession, parts: int, each: int = 1) -> list[int]:
    """Keys of which every one of ``parts`` hash partitions gets ``each``, so that none is empty and none is dealt double."""
    if parts * each > 100_000:  # many a partition: even enough
        return list(range(parts * each))
    found: dict[int, list[int]] = {i: [] for i in range(parts)}
    start, step = 0, max(1000, 8 * parts * each)
    while any(len(x) < each for x in found.values()):
        for r in spark.range(start, start + step).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p")).collect():
            if len(found[r["p"]]) < each:
                found[r["p"]].append(r["id"])
        start += step
    return sorted(k for x in found.values() for k in x)


def _sample_heads(docs: DataFrame, rows: int) -> list[int]:
    """The first 8 bytes of some suffixes of a bounded sample of documents, sorted."""
    share = int(min(1.0, SAMPLE_DOCS / max(1, rows)) * (1 << 24))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                text = text or b""
                at = _elect(np.frombuffer(text, np.uint8), np.array([len(text)]))[0]
                found += [int.from_bytes(text[a : a + 8], "big") - (1 << 63) for a in at[:: max(1, len(at) // SAMPLE_HEADS)].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["head"])

    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 24)) < share).select("text")
    return sorted(r["head"] + (1 << 63) for r in drawn.mapInArrow(heads, "head bigint").collect())


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): what is left of each text, as bytes (null without ``keep_text``). Ids are integers."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size["bytes"] / RUN_BYTES))  # runs, buckets and ranges grow with the data
    each = max(1, math.ceil(size["bytes"] / (parts * RUN_BYTES)))
    keys = _even_keys(spark, parts, each)
    buckets = ranges = _even_keys(spark, parts)
    heads = _sample_heads(rows, size["rows"])
    splitters = [heads[len(heads) * i // len(ranges)] for i in range(1, len(ranges))] if heads else []
    ranges = ranges[: len(splitters) + 1]

    run: Column = F.pmod(F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("text")), F.lit(len(keys)))  # rows without an id are dealt out
    if keys != list(range(len(keys))):
        run = F.element_at(F.array(*map(F.lit, keys)), (run + 1).cast("int"))
    dealt = rows.select(run.cast("long").alias("run"), "doc_id", "text").repartition(parts, "run")
    n = len(buckets)
    hashes = dealt.groupBy("run").applyInArrow(lambda t: _gram_hashes(t, buckets), "bucket bigint, place bigint, run bigint, hashes binary")
    masks = hashes.groupBy("bucket").applyInArrow(_repeated, "home bigint, place bigint, bits binary")
    entries = dealt.groupBy("run").cogroup(masks.groupBy("home")).applyInArrow(
        lambda t, m: _sorted_runs(t, m, n, splitters, ranges), "range bigint, place bigint, run bigint, shared binary, sizes binary, rests binary, docs binary, suffixes binary, whole binary, alias binary"
    )
    decisions = entries.groupBy("range").applyInArrow(_merged, "home bigint, suffixes binary, bits binary, whole binary, alias binary")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return dealt.groupBy("run").cogroup(decisions.groupBy("home")).applyInArrow(lambda t, d: _cut(t, d, keep_text), schema)


def op5(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False).drop("kept")
