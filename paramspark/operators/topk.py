"""Top-K items by scalar product, exactly, with length, coordinate or incremental pruning, as a join of queries and buckets of items.

Index: items are numbered by falling length and cut into buckets of at most ``BUCKET_ITEMS``. Seeds: the ``SEED_ITEMS`` longest items, whose
number is fixed, give each query a K-th score to start from. Since no product exceeds the product of both lengths, a query has
nothing to find in buckets whose longest item is too short for that score; as lengths fall, those left are the first few, and the query becomes a row
for each. These meet the items of the bucket, at most ``PART_QUERIES`` or so at a time, and inside a bucket the search goes on in steps of
``bucket`` items and blocks of queries, with a bound that removes items before the products that are left are taken as a matrix. Every strategy gives the same rows as brute
force; only the number of products differs. The driver sees the seeds and the greatest length of each of at most
``MAX_BUCKETS`` buckets; a hot bucket (the first one, which all queries ask) is dealt out by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from ..plans.storage import materialize

BUCKET_ITEMS, MAX_BUCKETS = 16_384, 100_000
SEED_ITEMS = 1024
PART_QUERIES = 16_384
#: Products that a search takes at once.
BLOCK = 1 << 20


class Strategy(NamedTuple):
    """``kind``: length, coord, incr, lc or li. ``focus``: coordinates of incr and li; ``ratio``: length spread from which lc and li prune by length."""

    kind: str
    focus: int = 0
    ratio: float = 0.0


def parse_strategy(text: str) -> Strategy:
    """``length``, ``coord``, ``incr:N``, ``lc:RATIO`` or ``li:N:RATIO``."""
    kind, *rest = text.strip().lower().split(":")
    try:
        if kind in ("length", "coord") and not rest:
            return Strategy(kind)
        if kind == "incr" and len(rest) == 1:
            return Strategy(kind, focus=int(rest[0]))
        if kind == "lc" and len(rest) == 1:
            return Strategy(kind, ratio=float(rest[0]))
        if kind == "li" and len(rest) == 2:
            return Strategy(kind, int(rest[0]), float(rest[1]))
    except ValueError:
        pass
    raise ValueError(f"not a pruning strategy: {text!r}")


class Items:
    """Items by falling length, with their directions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bucket: int = 100):
        lengths = np.sqrt((vectors**2).sum(axis=1))
        order = np.lexsort((ids, -lengths))
        self.ids, self.vectors, self.lengths, self.bucket = ids[order], vectors[order], lengths[order], bucket
        self.unit = self.vectors / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
        self.products = 0

    def _candidates(self, q: np.ndarray, size: float, at: slice, theta: float, strategy: Strategy) -> np.ndarray:
        """Items of a bucket whose product with ``q`` may reach ``theta``."""
        lengths, kind = self.lengths[at], strategy.kind
        if not np.isfinite(theta) or size == 0:
            return np.ones(len(lengths), bool)
        if kind in ("lc", "li"):
            kind = "length" if lengths[0] > lengths[-1] * strategy.ratio else {"lc": "coord", "li": "incr"}[kind]
        slack = 1e-9 * (1 + abs(theta))
        if kind == "length":  # |p||q| bounds the product
            return lengths * size >= theta - slack
        if kind == "coord":  # the angle that theta allows bounds how far one coordinate of the directions can be apart
            least = theta / (lengths[0] * size) if lengths[0] > 0 else np.inf
            if least <= 0:
                return np.ones(len(lengths), bool)
            if least > 1 + 1e-9:
                return np.zeros(len(lengths), bool)
            f = int(np.argmax(q**2))
            angle, own = np.arccos(min(1.0, least)), np.arccos(np.clip(q[f] / size, -1, 1))
            low = np.cos(min(np.pi, own + angle))
            high = np.cos(max(0.0, own - angle))
            x = self.unit[at, f]
            return (x >= low - 1e-9) & (x <= high + 1e-9) | (lengths == 0)
        focus = np.argsort(-(q**2), kind="stable")[: strategy.focus]  # incr: what is unseen adds at most the product of its lengths
        seen = self.vectors[at][:, focus] @ q[focus]
        rest = np.sqrt(np.maximum(0, lengths**2 - (self.vectors[at][:, focus] ** 2).sum(axis=1)) * max(0.0, size**2 - float((q[focus] ** 2).sum())))
        return seen + rest >= theta - slack

    def top(self, q: np.ndarray, k: int, strategy: Strategy, skip: frozenset = frozenset(), least: float = -np.inf, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best items outside of ``skip`` that reach ``least``, by falling score, then id; with a ``slack`` also of those that
        are no more than that below the k-th."""
        size = float(np.sqrt((q**2).sum()))
        ids, scores = np.empty(0, self.ids.dtype), np.empty(0)
        for start in range(0, len(self.ids), self.bucket):
            at = slice(start, start + self.bucket)
            theta = max(least, scores[k - 1] if len(scores) >= k else -np.inf) - slack
            if self.lengths[start] * size < theta - 1e-9 * (1 + abs(theta)):
                break
            keep = np.flatnonzero(self._candidates(q, size, at, theta, strategy)) + start
            if skip:
                keep = keep[~np.isin(self.ids[keep], list(skip))]
            self.products += len(keep)
            every = np.concatenate([scores, (self.vectors[keep] * q).sum(axis=1)])
            names = np.concatenate([ids, self.ids[keep]])
            order = np.lexsort((names, -every))
            ids, scores = names[order], every[order]
            if len(scores) > k:
                n = max(k, int(np.searchsorted(-scores, slack - scores[k - 1], "right"))) if slack else k
                ids, scores = ids[:n], scores[:n]
        enough = scores >= least - slack
        return ids[enough], scores[enough]

    def _open(self, queries: np.ndarray, sizes: np.ndarray, at: slice, theta: np.ndarray, strategy: Strategy) -> np.ndarray:
        """``_candidates`` of many queries: a row for each."""
        lengths, kind = self.lengths[at], strategy.kind
        if kind in ("lc", "li"):
            kind = "length" if lengths[0] > lengths[-1] * strategy.ratio else {"lc": "coord", "li": "incr"}[kind]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(theta), theta, 0)))
        every = ~np.isfinite(theta) | (sizes == 0)
        if kind == "length":
            keep = lengths * sizes[:, None] >= (theta - slack)[:, None]
        elif kind == "coord":
            least = theta / np.where(every | (lengths[0] == 0), 1.0, lengths[0] * sizes)
            least = np.where(lengths[0] > 0, least, np.inf)
            every |= least <= 0
            f = np.argmax(queries**2, axis=1)
            angle = np.arccos(np.clip(np.where(every, 1.0, least), -1, 1))
            own = np.arccos(np.clip(queries[np.arange(len(queries)), f] / np.where(sizes > 0, sizes, 1.0), -1, 1))
            low, high = np.cos(np.minimum(np.pi, own + angle)) - 1e-9, np.cos(np.maximum(0.0, own - angle)) + 1e-9
            x = np.ascontiguousarray(self.unit[at].T)[f]
            keep = (x >= low[:, None]) & (x <= high[:, None]) | (lengths == 0)
            keep[~every & (least > 1 + 1e-9)] = False
        elif strategy.focus >= queries.shape[1]:  # incr that sees all coordinates has the product itself
            return np.ones((len(queries), len(lengths)), bool)
        else:
            focus = np.argsort(-(queries**2), axis=1, kind="stable")[:, : strategy.focus]
            columns, seen, part = np.ascontiguousarray(self.vectors[at].T), np.zeros((len(queries), len(lengths))), np.zeros((len(queries), len(lengths)))
            values = np.take_along_axis(queries, focus, axis=1)
            for j in range(focus.shape[1]):
                x = columns[focus[:, j]]
                seen += x * values[:, j : j + 1]
                part += x * x
            rest = np.sqrt(np.maximum(0, lengths**2 - part) * np.maximum(0.0, sizes**2 - (values**2).sum(axis=1))[:, None])
            keep = seen + rest >= (theta - slack)[:, None]
        return keep | every[:, None]

    def top_many(self, queries: np.ndarray, k: int, strategy: Strategy, skips: tuple[np.ndarray, np.ndarray] | None = None, least: np.ndarray | None = None, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``top`` of many queries by matrix products: (row of the query, id, score), by row, falling score and id. ``skips``: rows in order, and the
        id that each leaves out. An id occurs once."""
        n, out = len(self.ids), []
        least = np.full(len(queries), -np.inf) if least is None else least
        sizes = np.sqrt((queries**2).sum(axis=1))
        by_id = np.argsort(self.ids, kind="stable")
        names = self.ids[by_id]
        # Queries that need the same number of items are together, so that a block ends where its items are too short.
        order = np.argsort(-(least - slack) / np.where(sizes > 0, sizes, 1.0), kind="stable")
        step = max(1, BLOCK // max(1, n))
        wide = strategy.kind in ("incr", "li") and strategy.focus >= queries.shape[1]  # no coordinate is left to bound
        many = max(self.bucket, 2048) if wide else self.bucket
        for first in range(0, len(queries) if n else 0, step):
            rows = np.sort(order[first : first + step])
            q, size, theta = queries[rows], sizes[rows], least[rows] - slack
            needed = np.min(np.where(np.isfinite(theta) & (size > 0), (theta - 1e-9 * (1 + np.abs(np.where(np.isfinite(theta), theta, 0)))) / np.where(size > 0, size, 1.0), -np.inf))
            stop = max(1, int(np.searchsorted(-self.lengths, -needed, "right")))
            scores = np.full((len(rows), stop), -np.inf)
            if stop < n and (self.lengths[:1] * size.max() < theta.min()).all():
                continue
            for start in range(0, stop, many):
                at = slice(start, min(stop, start + many))
                keep = self._open(q, size, at, theta, strategy)
                found = int(np.count_nonzero(keep))
                self.products += found
                if 8 * found > keep.size:
                    scores[:, at] = np.where(keep, q @ self.vectors[at].T, -np.inf)
                elif found:
                    i, j = np.nonzero(keep)
                    scores[i, j + start] = np.einsum("ij,ij->i", q[i], self.vectors[at][j])
            if skips is not None and len(skips[0]):
                a, b = np.searchsorted(skips[0], rows, "left"), np.searchsorted(skips[0], rows, "right")
                own = np.repeat(np.arange(len(rows)), b - a)
                which = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(len(own))
                wanted = skips[1][which]
                place = np.minimum(np.searchsorted(names, wanted), n - 1)
                hit = (names[place] == wanted) & (by_id[place] < stop)
                scores[own[hit], by_id[place[hit]]] = -np.inf
            margin = slack + 1e-9 * (1 + np.abs(np.where(np.isfinite(theta), theta, 0)))
            if stop > k:
                kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if np.count_nonzero(scores >= theta[:, None]) > 4 * k * len(rows) else np.full(len(rows), -np.inf)
                theta = np.maximum(theta, kth - margin)
            i, j = np.nonzero((scores >= (theta - 1e-9 * (1 + np.abs(np.where(np.isfinite(theta), theta, 0))))[:, None]) & (scores > -np.inf))
            out.append((rows[i], self.ids[j], (self.vectors[j] * q[i]).sum(axis=1)))
        if not out:
            return np.empty(0, int), self.ids[:0], np.empty(0)
        row, ids, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        sort = np.lexsort((ids, -scores, row))
        row, ids, scores = row[sort], ids[sort], scores[sort]
        start = np.searchsorted(row, row, "left")
        place = np.arange(len(row)) - start
        last = scores[np.minimum(start + k - 1, np.searchsorted(row, row, "right") - 1)]
        good = (scores >= least[row] - slack) & ((place < k) | ((scores >= last - slack) if slack else False))
        return row[good], ids[good], scores[good]


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if len(column) == 0:
        return np.empty((0, 0))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    if flat.null_count:
        return np.array(column.to_pylist(), float).reshape(len(column), -1)
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _skipped(column: pa.ChunkedArray | pa.Array, ids: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
    """(row, id) of lists of ids, in order of the rows; nulls, and ids that an item cannot have, are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows, flat = column.value_parent_indices() if hasattr(column, "value_parent_indices") else pa.compute.list_parent_indices(column), column.flatten()
    there = flat.is_valid()
    flat, rows = flat.filter(there), rows.filter(there)
    return rows.to_numpy(zero_copy_only=False), flat.to_numpy(zero_copy_only=False)


def length_index(items: DataFrame) -> DataFrame:
    """(bucket, id, vec, len) of items (id, vec), written: buckets of equal numbers of items by falling length, of equal length by id."""
    size = F.sqrt(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    placed = numbered(items.where("vec IS NOT NULL").select("id", F.col("vec").cast("array<double>").alias("vec"), size.alias("len")), [F.desc("len"), F.col("id")], "number")
    per = max(BUCKET_ITEMS, math.ceil(items.count() / MAX_BUCKETS))
    return materialize(placed.select("number", F.expr(f"number div {per}").alias("bucket"), "id", "vec", "len"), "item_index")


def top_items(queries: DataFrame, items: DataFrame, *, k: int, strategy: str = "coord", bucket: int = 100, digits: int = 6) -> DataFrame:
    """(query, rank, item, score) for queries (id, vec[, skip]) over items (id, vec); a null query vector gives no rows. ``skip``: items left out.

    Scores are rounded to ``digits`` before they are ranked, so equal ones are ranked by item."""
    plan, slack = parse_strategy(strategy), 10.0**-digits
    has_skip = "skip" in queries.columns
    asked = queries.where("vec IS NOT NULL").select(F.col("id").alias("query"), F.col("vec").cast("array<double>").alias("vec"), *(["skip"] if has_skip else []))
    query_type, item_type = asked.schema["query"].dataType.simpleString(), items.schema["id"].dataType.simpleString()
    index = length_index(items)
    longest = -np.array([r["n"] for r in index.groupBy("bucket").agg(F.max("len").alias("n")).orderBy("bucket").collect()])
    seeds = index.where(F.col("number") < SEED_ITEMS).select("id", "vec").toArrow()
    shared = queries.sparkSession.sparkContext.broadcast((seeds["id"].to_numpy(), _vectors(seeds["vec"]), longest))
    skips = lambda rows: _skipped(rows["skip"], seeds["id"].type) if has_skip else None

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """With the number of buckets that each query asks, and the score that it has to reach there."""
        ids, vectors, falling = shared.value
        known = Items(ids, vectors, bucket)
        for rows in batches:
            queries = _vectors(rows["vec"])
            at, _, scores = known.top_many(queries, k, plan, skips(rows)) if rows.num_rows else (np.empty(0, int), None, np.empty(0))
            ends = np.searchsorted(at, np.arange(rows.num_rows), "left") + k - 1
            full = np.bincount(at, minlength=rows.num_rows) >= k
            least = np.where(full, scores[np.minimum(ends, max(0, len(scores) - 1))] if len(scores) else -np.inf, -np.inf)
            sizes = np.sqrt((queries**2).sum(axis=1))
            sure = full & (sizes > 0)
            needed = np.where(sure, (np.where(sure, least, 0.0) - slack) / np.where(sizes > 0, sizes, 1.0), -np.inf)
            reach = np.where(sure, needed - 1e-9 * (1 + np.abs(np.where(sure, needed, 0.0))), -np.inf)
            depth = np.where(sure, np.searchsorted(falling, -reach, "right"), len(falling))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(least, pa.float64()), pa.array(depth.astype(np.int32), pa.int32())], [*rows.schema.names, "least", "depth"])

    skip_type = f", skip {asked.schema['skip'].dataType.simpleString()}" if has_skip else ""
    asked = materialize(asked.mapInArrow(seeded, f"query {query_type}, vec array<double>{skip_type}, least double, depth int"), "asked")
    parts = max(1, math.ceil(asked.count() / PART_QUERIES))
    rows = asked.where("depth > 0").withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts))).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth") - F.lit(1).cast("long"))))
    met = rows.select("bucket", "part").distinct().join(index.select("bucket", "id", F.col("vec").alias("item_vec")), "bucket").withColumnsRenamed({"bucket": "of_bucket", "part": "of_part"})

    def search(own: pa.Table, others: pa.Table) -> pa.Table:
        known = Items(others["id"].to_numpy(), _vectors(others["item_vec"]), bucket)
        at, ids, scores = known.top_many(_vectors(own["vec"]), k, plan, skips(own), own["least"].to_numpy(), slack) if own.num_rows and others.num_rows else (np.empty(0, int), known.ids[:0], np.empty(0))
        return pa.table({"query": own["query"].take(pa.array(at)), "item": pa.array(ids, others["id"].type), "score": pa.array(np.round(scores, digits) + 0.0, pa.float64())})

    every = rows.groupBy("bucket", "part").cogroup(met.groupBy("of_bucket", "of_part")).applyInArrow(search, f"query {query_type}, item {item_type}, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "item", "score")


def recent_items(events: DataFrame, *, user: str, item: str, order: str, memory: int) -> DataFrame:
    """Events with ``recent``: the distinct items of the user's last ``memory`` events before each (-1: all; 0: none)."""
    rows = (Window.unboundedPreceding, -1) if memory < 0 else (-max(1, memory), -1)
    window = Window.partitionBy(user).orderBy(order).rowsBetween(*rows)
    if memory == 0:
        return events.withColumn("recent", F.filter(F.array(F.col(item)), lambda x: F.lit(False)))
    return events.withColumn("recent", F.array_sort(F.array_distinct(F.collect_list(item).over(window))))


def merge_top(parts: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of partial lists (query, item, score), each item at its best."""
    best = parts.groupBy("query", "item").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
