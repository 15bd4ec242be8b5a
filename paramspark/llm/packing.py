"""Mixture-controlled packing by deficit round-robin over source queues.

Every document becomes token ids plus an end id and joins the queue of its source. Each window of ``size`` tokens serves all
queues in turn: a queue's deficit grows by its quantum (its target share of what the window serves), the whole tokens of the deficit,
rounded, are served, and the rest, at most half a token, is carried to the next window. The quantum of a window is the one step of
a common clock that makes the served tokens fill it: after the clock's time T a queue of weight w has served round(T * w) tokens. So the
state before any window is a function of the window's number alone: any partition knows the window and place of each of its tokens
without any other partition's work, and deficits carry across windows and partitions. A queue that runs dry stops counting, and
the others share its part in their proportions. Sources without a target come after the others. Without targets the shares are
those of the sources' tokens.

Three steps: documents are tokenised once and written to the shared folder with their place among the tokens of their source in
their partition; sums by (partition, source) give each partition's first place in each queue; the pieces follow row by row. Only
totals by source reach the driver (``MAX_SOURCES`` bounds them, 32 bytes each; more sources are an error, to be folded into fewer before).
Nothing is grouped by source, so a hot source is more rows.

Edge cases: null and empty texts hold just the end id; very long texts, long blank runs included, are encoded whole; a null source
is the queue of the empty name; repeated rows are packed one by one; no rows give no pieces; only the last window can be short.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_batches, materialize, record_batch, slices, tidy

SIZE = 2048
MAX_SOURCES = 100_000
#: Numbers of a table of windows by sources that is held at once.
_CELLS = 1 << 18
BROADCAST_ROWS = 200_000
END_ID = 1
# Fixed value: the split pattern of byte-level BPE with 50,257 ids.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on whose classes all Unicode versions agree; a text with others goes to the tokenizers library itself.
_UNUSUAL = re.compile(r"[^\x20-\x7e\t\n\r\xa1-ɏ–—‘-‟…€]")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level BPE writes bytes: printable bytes as themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of the tokenizers library for a byte-level BPE file; plain texts go through tiktoken with the same vocabulary, which is faster."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.width = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"

    def ids(self, text: str) -> np.ndarray:
        if _UNUSUAL.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.width)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.width)
        except ValueError:  # its pattern takes no blank run of some hundred thousand characters
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.width)


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, source, n, ids, wide, part, place): ids as little-endian bytes of 2 (wide: 4) each; place counts tokens of the source before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, done = ByteBpe(tokenizer), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], bpe.width)
        for whole in batches:
            for batch in slices(whole):
                ids, n, places = [], [], []
                for source, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    own = np.concatenate([bpe.ids(text or ""), end])
                    ids.append(own.tobytes())
                    n.append(len(own))
                    places.append(done[source])
                    done[source] += len(own)
                size = len(ids)
                yield record_batch({"doc_id": batch.column(0), "source": batch.column(1), "n": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary()), "wide": pa.array([bpe.width == "<u4"] * size), "part": pa.array([part] * size, pa.int64()), "place": pa.array(places, pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"doc_id {kind}, source string, n bigint, ids binary, wide boolean, part bigint, place bigint")


class Schedule:
    """Which tokens of which queue each window gets."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None, size: int = SIZE):
        self.sources, self.size = sorted(totals), size
        self.number = {s: i for i, s in enumerate(self.sources)}
        self.totals = np.array([totals[s] for s in self.sources], np.int64)
        self.total = int(self.totals.sum())
        self.windows = -(-self.total // size)
        weights = np.array([float((targets or totals).get(s, 0)) for s in self.sources])
        weights = np.where(self.totals > 0, weights, 0)
        aimed = weights > 0
        weights[~aimed] = self.totals[~aimed]  # sources without a target share what is left
        self.weights = np.where(weights > 0, weights, 1.0)
        for part in (aimed, ~aimed):
            self.weights[part] /= max(self.weights[part].sum(), 1e-300)
        # Clock times at which queues begin and end.
        self.begins = np.zeros(len(self.sources))
        self.begins[~aimed] = (self.totals[aimed] / self.weights[aimed]).max(initial=0.0)
        ends = self.begins + self.totals / self.weights
        # Tokens served by the clock, were they divisible: piecewise linear.
        self.times = np.unique(np.concatenate([self.begins, ends]))
        slope = np.zeros(len(self.times))
        np.add.at(slope, np.searchsorted(self.times, self.begins), self.weights)
        np.add.at(slope, np.searchsorted(self.times, ends), -self.weights)
        self.fluid = np.concatenate([[0.0], np.cumsum(np.cumsum(slope)[:-1] * np.diff(self.times))])

    def _served(self, times: np.ndarray) -> np.ndarray:
        """Tokens of each queue (columns) that the clock has served by each time (rows)."""
        return np.clip(np.floor((times[:, None] - self.begins) * self.weights + 0.5), 0, self.totals).astype(np.int64)

    def before(self, windows: np.ndarray) -> np.ndarray:
        """Tokens of each queue served before each window: the state that deficits carry."""
        wanted = np.minimum(windows * self.size, self.total)
        slack = len(self.sources) / 2 + 1
        low, high = (np.interp(wanted + x, self.fluid, self.times) for x in (-slack, slack))
        low, high = low - 1 - 1e-9 * low, high + 1 + 1e-9 * high
        below, above = self._served(low), self._served(high)
        active = np.flatnonzero((wanted > 0) & (wanted < self.total))
        while len(active):  # bisection, until one token or no time is between
            middle = low[active] + (high[active] - low[active]) / 2
            moved = (middle > low[active]) & (middle < high[active]) & ((above[active] - below[active]).sum(axis=1) > 1)
            active, middle = active[moved], middle[moved]
            now = self._served(middle)
            under = now.sum(axis=1) < wanted[active]
            low[active[under]], below[active[under]] = middle[under], now[under]
            high[active[~under]], above[active[~under]] = middle[~under], now[~under]
        # Tokens of one moment go to the queues in turn.
        more = above - below
        ahead = np.cumsum(more, axis=1) - more
        found = below + np.clip((wanted - below.sum(axis=1))[:, None] - ahead, 0, more)
        found[wanted <= 0] = 0
        found[wanted >= self.total] = self.totals
        return found

    def _about(self, source: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The window of the token at a place of a queue, or one close to it."""
        times = self.begins[source] + (place + 0.5) / self.weights[source]
        return np.interp(times, self.times, self.fluid).astype(np.int64) // self.size

    def pieces(self, source: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, window, offset in it, length), in order, for ``n`` tokens of a queue from ``place`` on, of each row."""
        margin = 1 + (len(self.sources) + 1) // self.size + 1
        first = np.maximum(self._about(source, place) - margin, 0)
        last = np.minimum(self._about(source, place + n - 1) + margin, self.windows - 1)
        spans = last - first + 1
        rare = spans > n * (2 * margin + 1)  # most of these windows hold none of the queue's tokens
        spans[rare] = 0
        row = np.repeat(np.arange(len(source)), spans)
        window = np.arange(len(row)) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(first, spans)
        if rare.any():
            one = np.repeat(np.flatnonzero(rare), n[rare])
            token = np.arange(len(one)) - np.repeat(np.cumsum(n[rare]) - n[rare], n[rare]) + place[one]
            near = self._about(source[one], token)[:, None] + np.arange(-margin, margin + 1)
            pairs = np.stack([np.repeat(one, 2 * margin + 1), near.clip(0, self.windows - 1).ravel()])
            row, window = np.unique(np.concatenate([[row, window], pairs], axis=1), axis=1)
        offset, length = np.zeros_like(window), np.zeros_like(window)
        names, of = np.unique(window, return_inverse=True)
        order, step = np.argsort(of, kind="stable"), max(1, _CELLS // max(1, len(self.sources)))
        for at in range(0, len(names), step):
            some = names[at : at + step]
            edges, place_of = np.unique(np.concatenate([some, some + 1]), return_inverse=True)
            state = self.before(edges)
            own = order[np.searchsorted(of[order], at) : np.searchsorted(of[order], at + step)]
            s = source[row[own]]
            i, j = place_of[of[own] - at], place_of[len(some) + of[own] - at]
            start, stop = np.maximum(state[i, s], place[row[own]]), np.minimum(state[j, s], place[row[own]] + n[row[own]])
            ahead = np.cumsum(state, axis=1) - state
            offset[own] = ahead[j, s] - ahead[i, s] + start - state[i, s]
            length[own] = np.maximum(stop - start, 0)
        kept = length > 0
        row, length = row[kept], length[kept]
        if not np.array_equal(np.bincount(row, length, len(n)).astype(np.int64), n):
            raise AssertionError("a token has no window")
        return row, window[kept], offset[kept], length


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", targets: dict[str, float] | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of each piece; ids are little-endian unsigned 32-bit numbers."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    tokens = materialize(tokenise(rows, tokenizer, end_id), "tokens")
    sums = tokens.groupBy("part", "source").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = materialize(sums.withColumn("first", before), "queues")
    totals = firsts.groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"a schedule holds at most {MAX_SOURCES} sources")
    shared = docs.sparkSession.sparkContext.broadcast(Schedule({r["source"]: r["n"] for r in totals}, targets, size))
    small = firsts.count() <= BROADCAST_ROWS
    firsts = firsts.select("part", "source", "first")
    placed = tokens.join(F.broadcast(firsts) if small else firsts, ["part", "source"]).select("doc_id", "source", (F.col("first") + F.col("place")).alias("place"), "ids", "wide")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        schedule = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            source, place, data, wide = (batch.column(i).to_pylist() for i in range(1, 5))
            own = [x if w else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, w in zip(data, wide, strict=True)]
            n = np.fromiter((len(x) // 4 for x in own), np.int64, len(own))
            number = np.fromiter((schedule.number[s] for s in source), np.int64, len(own))
            row, window, offset, length = schedule.pieces(number, np.array(place, np.int64), n)
            start = np.cumsum(length) - length
            start -= (np.cumsum(n) - n)[row]
            ids = [own[r][4 * s : 4 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            return record_batch({"doc_id": batch.column(0).take(pa.array(row)), "start": pa.array(start), "length": pa.array(length), "ids": pa.array(ids, pa.binary()), "doc_tokens": pa.array(n[row]), "sequence_id": pa.array(window), "offset": pa.array(offset)})

        return each

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(placed, make, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def op7(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
