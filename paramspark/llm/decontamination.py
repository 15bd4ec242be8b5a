"""Benchmark decontamination by winnowing.

Texts become words; benchmark items and documents keep the minimum hash of each ``window - k + 1`` consecutive k-grams (the
rightmost of equal ones). A shared span of ``window`` words holds one whole such group, so both sides keep the same k-gram in
it: every shared span of at least ``window`` words meets in the join of fingerprints. Each hit is then extended word by word to
the left and right, and counts if the shared run reaches ``window`` words. Items shorter than a window are looked up whole.

An item that keeps one k-gram at over ``REPEATS`` places (a phrase said again and again) would meet a document that repeats it too in
every pair of places. There the hit is extended by the windows around it, each looked up among the item's windows around that k-gram, and
windows that follow each other are one run: work in proportion to the document, the same words hit.

The item side is a bounded block of the benchmark: blocks are cut by their bytes and hold at most ``block_bytes`` of item text (one
larger item is a block of its own). One block at a time is broadcast to the tasks that read documents, and documents meet every
block; with more than one, what a block found is written before the next one is read, so the driver holds one block, not the
benchmark. Nothing is grouped by document, k-gram or item, so hot passages are only more rows of the scan; memory follows one
block and one Arrow batch.

Edge cases: null and empty texts have no words; items without words or id have no windows; items with equal ids count as one;
repeated documents are judged one by one; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, record_batch, rewrite_batches

WINDOW, K = 8, 4
BLOCK_BYTES = 32 << 20
#: Places of one k-gram in one item beyond which hits are extended by windows instead of place by place.
REPEATS = 32
#: Lower-cases A-Z and turns what is not a letter, digit or non-ASCII byte into a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_TABLE).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of word numbers; a gram with an unknown word (0) gets the largest value."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
        known &= part > 0
    return np.where(known, np.minimum(h, _NONE - np.uint64(1)), _NONE)


def winnow(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions kept: of each ``span`` consecutive hashes the smallest, of equal ones the rightmost."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, span):
        part = hashes[j : j + n]
        better = part <= best
        best[better] = part[better]
        at[better] = np.arange(j, j + n)[better]
    kept = np.unique(at)
    return kept[hashes[kept] != _NONE]


class ItemIndex:
    """The fingerprints of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        self.number: dict[bytes, int] = {}
        self.names: list[str] = []
        self.ids: list[np.ndarray] = []
        prints: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        for name, raw in items:
            if not (own := words(raw)) or name is None:
                continue
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in own], np.int32)
            item = len(self.names)
            self.names.append(name)
            self.ids.append(ids)
            if len(ids) < window:
                self.short[len(ids)][ids.tobytes()].append(item)
                continue
            hashes = gram_hashes(ids, k)
            for at in winnow(hashes, window - k + 1).tolist():
                prints[int(hashes[at])].append((item, at))
        self.hashes = np.array(sorted(prints), np.uint64)
        self.places = [prints[h] for h in self.hashes.tolist()]
        self.repeated = np.zeros(len(self.hashes), bool)
        around: dict[bytes, set[int]] = defaultdict(set)
        for slot, places in enumerate(self.places):
            if len(places) <= REPEATS:
                continue
            often = {item for item, n in Counter(item for item, _ in places).items() if n > REPEATS}
            if not often:
                continue
            self.repeated[slot] = True
            for item, at in places:
                if item in often:
                    own = self.ids[item]
                    for start in range(max(0, at - window + k), min(at, len(own) - window) + 1):
                        around[own[start : start + window].tobytes()].add(item)
            self.places[slot] = [(item, at) for item, at in places if item not in often]
        self.around = {w: sorted(x) for w, x in around.items()}
        self.short = {m: dict(x) for m, x in self.short.items()}
        self.short_hashes = {m: np.unique([gram_hashes(np.frombuffer(b, np.int32), m)[0] for b in x]) for m, x in self.short.items()}

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) of maximal shared runs in word numbers; runs of several documents must be kept apart by zeros."""
        found: list[tuple[int, int, int]] = []
        if len(self.hashes):
            hashes = gram_hashes(ids, self.k)
            kept = winnow(hashes, self.window - self.k + 1)
            slot = np.minimum(np.searchsorted(self.hashes, hashes[kept]), len(self.hashes) - 1)
            same = self.hashes[slot] == hashes[kept]
            reach: dict[tuple[int, int], int] = {}  # how far a diagonal of an item has been extended already
            for at, s in zip(kept[same].tolist(), slot[same].tolist(), strict=True):
                for item, q in self.places[s]:
                    if at < reach.get((item, at - q), -1):
                        continue
                    start, end = self._extend(ids, self.ids[item], at, q)
                    reach[item, at - q] = max(end, at + 1)
                    if end - start >= self.window:
                        found.append((item, start, end))
            found += self._runs(ids, kept[same & self.repeated[slot]])
        for m, table in self.short.items():
            hashes = gram_hashes(ids, m)
            for at in np.flatnonzero(np.isin(hashes, self.short_hashes[m])).tolist():
                found += [(item, at, at + m) for item in table.get(ids[at : at + m].astype(np.int32).tobytes(), ())]
        return found

    def _runs(self, ids: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) of runs of windows that hold a kept k-gram at ``at`` and that an item has around a k-gram it repeats."""
        found: list[tuple[int, int, int]] = []
        starts = np.unique(at[:, None] - np.arange(self.window - self.k + 1))
        last: dict[int, tuple[int, int]] = {}
        for start in starts[(starts >= 0) & (starts <= len(ids) - self.window)].tolist():
            for item in self.around.get(ids[start : start + self.window].tobytes(), ()):
                first, end = last.get(item, (start, start))
                if start > end:
                    found.append((item, first, end))
                    first = start
                last[item] = first, start + self.window
        return found + [(item, first, end) for item, (first, end) in last.items()]

    @staticmethod
    def _extend(ids: np.ndarray, item: np.ndarray, at: int, q: int) -> tuple[int, int]:
        left = min(at, q)
        back = ids[at - left : at][::-1] != item[q - left : q][::-1]
        start = at - (int(back.argmax()) if back.any() else left)
        right = min(len(ids) - at, len(item) - q)
        ahead = ids[at : at + right] != item[q : q + right]
        return start, at + (int(ahead.argmax()) if ahead.any() else right)


def _cut_blocks(items: DataFrame, block_bytes: int) -> DataFrame | None:
    """(item_id, text, block), written: no block holds more than ``block_bytes`` of text, but for one of a single item. None if one block will do."""
    if (items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) <= block_bytes:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            own = []
            for size in batch.column(1).cast(pa.binary()).to_pylist():
                size = len(size or b"")
                if held and held + size > block_bytes:
                    block, held = block + 1, 0
                held += size
                own.append(block)
            yield record_batch({"item_id": batch.column(0), "text": batch.column(1), "block": pa.array(own, pa.int64())})

    return materialize(items.coalesce(64).mapInArrow(run, "item_id string, text binary, block bigint"), "benchmark")


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[bool, list[tuple[str, bytes | None]]]]:
    """The items of one block after another; the flag: there are more."""
    cut = _cut_blocks(items, block_bytes)
    if cut is None:
        yield False, [tuple(r) for r in items.collect()]
        return
    numbers = sorted(r["block"] for r in cut.select("block").distinct().collect())
    for b in numbers:
        yield True, [(r["item_id"], r["text"]) for r in cut.where(F.col("block") == b).collect()]


def _scan(docs: DataFrame, items: list[tuple[str, bytes | None]], window: int, k: int, extra: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        index = ItemIndex(shared.value, window, k)
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, starts, sizes = _numbered(batch.column(1).cast(pa.binary()).to_pylist(), index)
            hits: list[list[dict]] = [[] for _ in sizes]
            for item, start, end in index.hits(ids):
                doc = int(np.searchsorted(starts, start, "right")) - 1
                hits[doc].append({"item_id": index.names[item], "start": start - int(starts[doc]), "end": end - int(starts[doc])})
            return record_batch({"doc_id": batch.column(0), "n_words": pa.array(sizes), "hits": pa.array(hits, kind)} | ({"row": batch.column(2)} if extra else {}))

        return each

    kept = docs.select("doc_id", "text", *([extra] if extra else []))
    return map_batches(kept, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, hits array<struct<item_id:string,start:bigint,end:bigint>>" + (", row bigint" if extra else ""))


def shared_spans(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, hits): the shared runs (item_id, start, end) in words of the document, of at least ``window`` words or a whole short item;
    around a k-gram that an item repeats over ``REPEATS`` times, the stretches that the item's windows cover."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    every = None
    for several, block in _blocks(items, block_bytes):
        if not several:
            return _scan(docs, block, window, k, "")
        if every is None:
            docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
        found = materialize(_scan(docs, block, window, k, "row"), "spans")
        every = found if every is None else every.unionByName(found)
    return every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits")).drop("row")


def _numbered(raws: list[bytes | None], index: ItemIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of several texts, a 0 after each; where each begins; their sizes."""
    own = [words(raw) for raw in raws]
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    ids = np.zeros(starts[-1], np.int32)
    for w, at in zip(own, starts.tolist(), strict=False):
        ids[at : at + len(w)] = list(map(index.number.get, w, repeat(0)))
    return ids, starts, sizes


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, all columns, without the documents that hold a run of ``window`` words of any benchmark item. Items of fewer words are left out:
    a phrase of a few words is no evidence of a leak."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("binary").alias("text")).where("text IS NOT NULL")
    place = docs.columns.index(text)
    for several, block in _blocks(items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast([(name or "", raw) for name, raw in block if len(words(raw)) >= window])

        def make(shared=shared) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
            index = ItemIndex(shared.value, window, k)

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                ids, starts, sizes = _numbered(batch.column(place).cast(pa.binary()).to_pylist(), index)
                clean = np.ones(len(sizes), bool)
                for _, start, _ in index.hits(ids):
                    clean[int(np.searchsorted(starts, start, "right")) - 1] = False
                return batch.filter(pa.array(clean))

            return each

        docs = rewrite_batches(docs, make)
        if several:
            docs = materialize(docs, "clean")
    return docs


def covered_words(hits):
    """Words inside any run of a column of hits."""
    runs = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("s"), h["end"].alias("e"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), r["e"] - F.greatest(r["s"], a["to"]))).alias("n"), F.greatest(a["to"], r["e"]).alias("to"))
    return F.aggregate(runs, zero, step, lambda a: a["n"])


def contaminated(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated)."""
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return shared_spans(docs, benchmark, **options).select("doc_id", "n_words", covered_words(F.col("hits")).alias("n_hit"), items.alias("items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.size("items") >= least_items).alias("contaminated")
    )


def op10(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contaminated(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bn AS (
  SELECT item_id, least(len(w), 8) AS m, array_to_string(list_slice(w, i, i + least(len(w), 8) - 1), ' ') AS g
  FROM bw, unnest(generate_series(1, len(w) - least(len(w), 8) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT m FROM bn
), dn AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM dw, sizes, unnest(generate_series(1, len(w) - m + 1)) AS u(i)
), hit AS (
  SELECT DISTINCT doc_id, item_id, dn.m, i FROM dn JOIN bn ON dn.m = bn.m AND dn.g = bn.g
), n AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(generate_series(0, m - 1)) AS o(k) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
