"""Co-occurrence sketches: for each word (and time slot) a summary of the documents that hold it, and predictors of words that
share documents.

Builders are one grouped aggregation, so the map side combines before the shuffle. Hashes are taken once a document, before its
words are exploded. The MinHash predictor joins an inverted index of signatures, with any number of queries. Additive sketches are searched by
``bounded_pairs``, which leaves a word out of a product where the lengths of the two sketches show that it cannot be among the best. The Bloom
predictor meets each query's sketch with all sketches: there queries are a stated, small set of words, whose number is checked before they are
broadcast, as tables of flags where these are small. Other sides are broadcast up to ``BROADCAST_BYTES`` only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bloom_math import estimate_column
from ..functions.hashing import family, pack_bits
from ..functions.vectors import round_half_up
from ..plans.storage import materialize

MAX_QUERIES = 10_000
#: What a side of a join may hold to be broadcast.
BROADCAST_BYTES = 32 << 20


def _keys(slot: bool) -> list[str]:
    return ["word", "slot"] if slot else ["word"]


def _by_word(docs: DataFrame, hashes: Column, slot: bool, distinct: bool) -> DataFrame:
    """(word[, slot], doc_id, h): a row for each (distinct) word of each document."""
    words = F.array_distinct("words") if distinct else F.col("words")
    hashed = docs.select("doc_id", words.alias("words"), hashes.alias("h"), *(["slot"] if slot else []))
    return hashed.select(F.explode("words").alias("word"), *(["slot"] if slot else []), "doc_id", "h")


def bloom_build(docs: DataFrame, *, num_bits: int, num_hashes: int, slot: bool = False, hashes: str = "portable") -> DataFrame:
    """(word[, slot], bits): the sorted set of bits of the documents (doc_id, words[, slot]) that hold the word."""
    bits = F.transform(family(F.col("doc_id"), num_hashes, hashes), lambda h: F.pmod(h, F.lit(num_bits)).cast("int"))
    rows = _by_word(docs, bits, slot, distinct=True)
    # A set for each hash, not one over exploded bits: a quarter of the rows, and the map side still bounds a hot word to its bits.
    sets = rows.groupBy(*_keys(slot)).agg(*(F.collect_set(F.get("h", F.lit(i))).alias(f"s{i}") for i in range(num_hashes)))
    return sets.select(*_keys(slot), F.array_sort(F.array_distinct(F.concat(*(f"s{i}" for i in range(num_hashes))))).alias("bits"))


def _ties(docs: DataFrame, num_hashes: int, hashes: str) -> bool:
    """Whether two documents have an equal hash at the same place; reads the ids alone."""
    each = docs.select("doc_id", F.posexplode(family(F.col("doc_id"), num_hashes, hashes)).alias("i", "h"))
    return not each.groupBy("i", "h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").isEmpty()


def _signatures(rows: DataFrame, keys: list[str], num_hashes: int, ties: bool) -> DataFrame:
    """(keys, signature) of rows (keys, doc_id, h). Only without ``ties`` the hash alone says which document is least: a pair of longs is
    aggregated by hashing, where one of structs makes Spark sort all rows before the map side combines them."""
    h = lambda i: F.get("h", F.lit(i))
    least = [F.min_by("doc_id", F.struct(h(i).alias("h"), "doc_id") if ties else h(i)).alias(f"m{i}") for i in range(num_hashes)]
    return rows.groupBy(*keys).agg(*least).select(*keys, F.array(*(F.col(f"m{i}") for i in range(num_hashes))).alias("signature"))


def minhash_build(docs: DataFrame, *, num_hashes: int, slot: bool = False, hashes: str = "portable") -> DataFrame:
    """(word[, slot], signature): for each hash the document that attains the minimum; of equal ones the smallest id."""
    rows = _by_word(docs, family(F.col("doc_id"), num_hashes, hashes), slot, distinct=True)
    return _signatures(rows, _keys(slot), num_hashes, _ties(docs, num_hashes, hashes))


def minhash_build_rehashed(docs: DataFrame, *, num_hashes: int, hashes: str = "portable") -> DataFrame:
    """The same signatures from (word, document) pairs alone: ids are hashed where they are combined, so rows stay small."""
    pairs = docs.select(F.explode(F.array_distinct("words")).alias("word"), "doc_id").withColumn("h", family(F.col("doc_id"), num_hashes, hashes))
    return _signatures(pairs, ["word"], num_hashes, _ties(docs, num_hashes, hashes))


def tow_build(docs: DataFrame, *, num_hashes: int, slot: bool = False, hashes: str = "portable") -> DataFrame:
    """(word[, slot], sums): sums of +1/-1 by hash bit over the documents; a word that repeats in one counts again."""
    signs = pack_bits(family(F.col("doc_id"), (num_hashes + 31) // 32, hashes), num_hashes)
    rows = _by_word(docs, signs, slot, distinct=False)
    sums = rows.groupBy(*_keys(slot)).agg(*(F.sum(F.get("h", F.lit(i))).alias(f"s{i}") for i in range(num_hashes)))
    return sums.select(*_keys(slot), F.array(*(F.col(f"s{i}") for i in range(num_hashes))).alias("sums"))


def word_count(docs: DataFrame) -> DataFrame:
    """(word, n), repeats included."""
    return docs.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def sketch_merge(a: DataFrame, b: DataFrame, values: str, keys: list[str]) -> DataFrame:
    """Element-wise sum of additive sketches of the same shape."""
    return a.unionByName(b).select(*keys, F.posexplode(values).alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias(values))


def _against_all(model: DataFrame, queries: DataFrame, values: str, slot: bool) -> DataFrame:
    """Each query with its own sketch ``q`` beside each sketch of the model, of the same slot."""
    words = queries.select(F.col("word").alias("query"))
    if (n := words.count()) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} query words at once, got {n}: pass them in blocks")
    own = F.broadcast(words).join(model, F.col("query") == F.col("word"), "inner" if slot else "left").select("query", *(["slot"] if slot else []), F.col(values).alias("q"))
    return model.join(F.broadcast(own), "slot") if slot else model.crossJoin(F.broadcast(own))


def top_k(scored: DataFrame, k: int | None, *, by: list[str], score: str = "score", item: str = "word", item_desc: bool = True) -> DataFrame:
    """The ``k`` best rows of each group with their ``rank``; equal scores by item."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.desc(item) if item_desc else F.asc(item))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def bloom_predict(model: DataFrame, queries: DataFrame, *, num_bits: int, num_hashes: int, k: int, slot: bool = False) -> DataFrame:
    """(query[, slot], rank, word, score): words by estimated number of shared documents. Slotted: within each slot that has the query.

    The bits of the queries are broadcast as tables of flags, in which each word's bits are looked up. Where these tables would be over ``BROADCAST_BYTES``, bits in
    common are counted by a join on the bit."""
    model = materialize(model, "model")  # read twice at least
    at = ["slot"] if slot else []
    names = [r[0] for r in queries.select("word").limit(MAX_QUERIES + 1).collect()]
    if len(names) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} query words at once: pass them in blocks")
    asked = queries.select(F.col("word").alias("query"))
    own = model.join(_small(asked.distinct(), 64), F.col("query") == F.col("word")).select("query", *at, "bits")
    most = BROADCAST_BYTES // (4 * num_bits)
    if len(names) <= most and (not slot or own.limit(most + 1).count() <= most):
        counted = _counted(model, own, names, num_bits, slot)
    else:
        counted = _counted_by_join(model, own, queries, slot)
    both = F.col("n") + F.col("nq") - F.col("c")
    e = lambda x: estimate_column(num_bits, num_hashes, x)
    scored = counted.select("query", *_keys(slot), F.round(e(F.col("n")) + e(F.col("nq")) - e(both), 6).alias("score"))
    return top_k(scored, k, by=["query", *at]).select("query", *at, "rank", "word", "score")


def _counted(model: DataFrame, own: DataFrame, names: list[str], num_bits: int, slot: bool) -> DataFrame:
    """(query, word[, slot], n, nq, c) of each query and word (of a slot that has both): the numbers of their bits and of those in common."""
    found = {}
    for batch in own.toArrow().to_batches():
        for i, query in enumerate(batch.column("query").to_pylist()):
            flags = np.zeros(num_bits, bool)
            flags[batch.column("bits")[i].values.to_numpy()] = True
            found[query, batch.column("slot")[i].as_py() if slot else None] = flags
    sets = {}
    for (query, s), flags in found.items():
        if slot:
            sets.setdefault(s, []).extend([(query, flags)] * names.count(query))
    every = [(name, found.get((name, None), np.zeros(num_bits, bool))) for name in names]
    held = model.sparkSession.sparkContext.broadcast(sets if slot else {None: every})

    def count(batches):
        for batch in batches:
            lists = batch.column("bits")
            bits, n = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            slots = np.array(batch.column("slot").to_pylist(), object) if slot else None
            for s, flagged in held.value.items():
                some = np.flatnonzero(slots == s) if slot else np.arange(len(n))
                if not len(some):
                    continue
                for query, flags in flagged:
                    c = np.bincount(row[flags[bits]], minlength=len(n))[some]
                    made = {"query": pa.array([query] * len(some), pa.string()), "word": batch.column("word").take(pa.array(some))}
                    if slot:
                        made["slot"] = batch.column("slot").take(pa.array(some))
                    yield pa.RecordBatch.from_pydict(made | {"n": n[some], "nq": np.full(len(some), flags.sum(), np.int64), "c": c.astype(np.int64)})

    kind = f", slot {model.schema['slot'].dataType.simpleString()}" if slot else ""
    return model.select(*_keys(slot), "bits").mapInArrow(count, f"query string, word string{kind}, n long, nq long, c long")


def _counted_by_join(model: DataFrame, own: DataFrame, queries: DataFrame, slot: bool) -> DataFrame:
    """``_counted`` for any number of queries."""
    at = ["slot"] if slot else []
    sizes = model.select(*_keys(slot), F.size("bits").alias("n"))
    pairs = _against_all(sizes, queries, "n", slot).select("query", *_keys(slot), "n", F.coalesce("q", F.lit(0)).alias("nq"))
    asked = own.select("query", *at, F.explode("bits").alias("bit"))
    met = model.select(*_keys(slot), F.explode("bits").alias("bit")).join(_small(asked, 64), ["bit", *at])
    common = met.groupBy("query", *_keys(slot)).agg(F.count("*").alias("c"))
    return pairs.join(common, ["query", *_keys(slot)], "left").withColumn("c", F.coalesce("c", F.lit(0)))


def _fits(df: DataFrame, row_bytes: int) -> bool:
    """Whether the rows of ``df``, of about ``row_bytes`` each, are few enough to be broadcast."""
    return df.limit(BROADCAST_BYTES // row_bytes + 1).count() * row_bytes <= BROADCAST_BYTES


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, to be broadcast where its rows are few enough; else it is joined by a shuffle."""
    return F.broadcast(df) if _fits(df, row_bytes) else df


def _unless_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``_small``, but else by a sorted join for certain: Spark goes by compressed bytes, of which sketches take a tenth of what they take in the driver."""
    return F.broadcast(df) if _fits(df, row_bytes) else df.hint("merge")


def minhash_postings(model: DataFrame) -> DataFrame:
    """(i, doc, word): the inverted index of signatures."""
    return model.select("word", F.posexplode("signature").alias("i", "doc")).select("i", "doc", "word")


def minhash_predict(model: DataFrame, counts: DataFrame, queries: DataFrame, *, num_hashes: int, k: int | None = None, matched_only: bool = False) -> DataFrame:
    """(query, rank, word, score): estimated number of shared documents from the similarity and the words' counts (word, n).

    Words meet a query where they have the same document at the same place of the signature: a join of the inverted index with the queries' own
    postings, however many queries there are. Words that share none have the score 0; they are listed for at most ``MAX_QUERIES`` queries, and left out with
    ``matched_only``."""
    model, counts = materialize(model, "model"), materialize(counts, "counts")
    asked = queries.select(F.col("word").alias("query")).distinct()
    postings = minhash_postings(model)
    own = _small(postings.join(_small(asked, 64), F.col("word") == F.col("query")).select("i", "doc", "query"), 64)
    same = postings.join(own, ["i", "doc"]).groupBy("query", "word").agg(F.count("*").alias("same"))
    if not matched_only:
        names = [r[0] for r in asked.limit(MAX_QUERIES + 1).collect()]
        if len(names) > MAX_QUERIES:
            raise ValueError(f"all words are listed for at most {MAX_QUERIES} query words at once")
        every = model.select("word", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("query"))
        same = every.join(same, ["query", "word"], "left").select("query", "word", F.coalesce("same", F.lit(0)).alias("same"))
    similar = same.select("query", "word", (F.col("same") / F.lit(num_hashes)).alias("j"))
    own_counts = _small(counts.join(_small(asked, 64), F.col("word") == F.col("query")).select("query", F.col("n").alias("nq")), 64)
    known = similar.join(counts, "word").join(own_counts, "query", "left")
    score = round_half_up(F.col("j") * (F.col("n") + F.coalesce("nq", F.lit(0))) / (F.col("j") + 1))
    return top_k(known.select("query", "word", score.alias("score")), k, by=["query"]).select("query", "rank", "word", "score")


def _parts(num_hashes: int, num_means: int) -> list[tuple[int, int]]:
    """Slices (start, stop) of a sketch; the last may be shorter."""
    size = num_hashes // num_means
    return [(at, min(at + size, num_hashes)) for at in range(0, num_hashes, size)]


def _median(values: list[Column]) -> Column:
    n = len(values)
    if n == 1:
        return values[0]
    if n == 4:  # as most callers have it: compiled, where a sort of an array is not
        a, b, c, d = values
        return (F.greatest(F.least(a, b), F.least(c, d)) + F.least(F.greatest(a, b), F.greatest(c, d))) / 2
    ordered = F.array_sort(F.array(*values))
    middle = F.get(ordered, F.lit(n // 2))
    return middle if n % 2 else (middle + F.get(ordered, F.lit(n // 2 - 1))) / 2


def median_of_means(a: Column, b: Column, num_hashes: int, num_means: int) -> Column:
    """Median over slices of the mean product of two additive sketches."""
    means = []
    for at, stop in _parts(num_hashes, num_means):
        total = F.lit(0).cast("long")
        for i in range(at, stop):
            total = total + F.get(a, F.lit(i)) * F.get(b, F.lit(i))
        means.append(total / F.lit(stop - at))
    return _median(means)


def dot(a: Column, b: Column, size: int | None = None) -> Column:
    """Product of two additive sketches; places that one of them lacks count as zero. With a known ``size``, the most places that a sketch has, an unrolled sum,
    which compiles, else a fold."""
    if size is not None:
        total = F.lit(0).cast("long")
        for i in range(size):
            total = total + F.coalesce(F.get(a, F.lit(i)) * F.get(b, F.lit(i)), F.lit(0))
        return total
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))


#: Places of a sketch up to which a product is written out.
UNROLLED = 64
#: How many of a slot's longest sketches give a query its first scores.
SEEDS = 256
#: Tasks that a (slot, bucket) of words is dealt out over where the queries are too many to be broadcast.
SALTS = 16
#: Words and queries of a cell, about, where slices of sketches are multiplied as matrices, and products that are taken at once.
CELL_WORDS, CELL_QUERIES, BLOCK = 65_536, 32_768, 1 << 18
#: Pairs of queries and words from which matrices are used.
MANY_PAIRS = 1 << 26


def _lengths(values: Column, parts: list[tuple[int, int]] | None) -> Column:
    """Length of each slice of a sketch (of the whole one: no ``parts``)."""
    some = [F.slice(values, at + 1, stop - at) for at, stop in parts] if parts else [values]
    return F.array(*(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)) for x in some))


def _most(a: Column, b: Column, parts: list[tuple[int, int]] | None) -> Column:
    """What the score of two sketches with slices of these lengths is at most, with room for the rounding of doubles: a product of slices is at most that of
    their lengths, and a median of values that are all at most others is at most the median of those."""
    sizes = [stop - at for at, stop in parts] if parts else [1]
    return _median([F.get(a, F.lit(i)) * F.get(b, F.lit(i)) / n for i, n in enumerate(sizes)]) * (1 + 1e-9) + 1e-6


def _middle(values: np.ndarray) -> np.ndarray:
    """``_median`` over the first axis; may overwrite ``values``."""
    if len(values) == 4:
        a, b, c, d = values
        low, high = np.minimum(a, b), np.minimum(c, d)
        np.maximum(a, b, out=a), np.maximum(c, d, out=c)
        np.maximum(low, high, out=low), np.minimum(a, c, out=a)
        return np.add(low, a, out=low) / values.dtype.type(2)
    values.sort(axis=0)
    n = len(values)
    return values[n // 2] if n % 2 else (values[n // 2] + values[n // 2 - 1]) / values.dtype.type(2)


def _sums(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(flat), -1)


def _best_of_cell(own: np.ndarray, words: np.ndarray, least: np.ndarray, k: int, parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, word, score) as places: of each row of ``own`` the best rows of ``words``, earlier ones first where scores are equal, that reach ``least``. More than ``k`` are
    given only where scores differ by less than what rounding to six digits may make equal.

    Matrices of single precision, with room for their error, leave pairs out; those that are left are multiplied as whole numbers."""
    sizes = np.array([stop - at for at, stop in parts], float)
    norms = lambda x: np.stack([np.sqrt((x[:, at:stop].astype(float) ** 2).sum(axis=1)) for at, stop in parts], axis=1)
    far, q, w = norms(words), (own / np.repeat(sizes, sizes.astype(int))).astype(np.float32), np.ascontiguousarray(words.T.astype(np.float32))
    near = norms(own)
    if len(words) and len(own) and (near.max(axis=0) * far.max(axis=0)).max() >= 2.0**62:
        raise OverflowError("products of these sketches do not fit in a long")
    room = (near * (far.max(axis=0) if len(far) else 0.0) / sizes).max(axis=1) * 1e-5 + 2e-6
    out, theta = [], least.copy()
    wide = min(len(words), 4096)
    step = max(1, BLOCK // max(1, wide))
    means = np.empty((len(parts), 0, 0), np.float32)
    for first in range(0, len(own) if wide else 0, step):
        rows = slice(first, min(first + step, len(own)))
        kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        for start in range(0, len(words), wide):
            at = slice(start, min(start + wide, len(words)))
            if means.shape[1:] != (shape := (rows.stop - first, at.stop - start)):
                means = np.empty((len(parts), *shape), np.float32)
            for mean, (a, b) in zip(means, parts, strict=True):
                np.matmul(q[rows, a:b], w[a:b, at], out=mean)
            about = _middle(means)
            if np.count_nonzero(about >= (theta[rows] - room[rows])[:, None]) > 4 * k * len(about) and about.shape[1] > k:
                kth = -np.partition(-about, k - 1, axis=1)[:, k - 1]
                theta[rows] = np.maximum(theta[rows], kth - 2 * room[rows])
            i, j = np.nonzero(about >= (theta[rows] - room[rows])[:, None])
            if not len(i):
                continue
            i, j = i + first, j + start
            score = _middle(np.stack([np.einsum("ij,ij->i", own[i, a:b], words[j, a:b]) / n for (a, b), n in zip(parts, sizes, strict=True)]))
            row, word, score = (np.concatenate(x) for x in zip(kept, (i, j, score), strict=True))
            order = np.lexsort((word, -score, row))
            row, word, score = row[order], word[order], score[order]
            head = np.searchsorted(row, row, "left")
            end = np.searchsorted(row, row, "right")
            full = end - head >= k
            kth = np.where(full, score[np.minimum(head + k - 1, len(row) - 1)], -np.inf)
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (score[1:] != score[:-1])
            place = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
            good = (score >= np.maximum(kth, least[row]) - 1e-6) & (place < k)
            np.maximum.at(theta, row[full], kth[full] - 1e-6)
            kept = [row[good], word[good], score[good]]
        out.append(kept)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _by_matrices(asked: DataFrame, words: DataFrame, keys: list[str], *, k: int, parts: list[tuple[int, int]]) -> DataFrame:
    """(query, slot, word, score): what may be among the ``k`` best of each query of ``asked`` (query, slot, q, least) and cell; ``words`` (word, sums) are in the same cells ``keys``."""
    kind = asked.schema["slot"].dataType.simpleString()

    def search(own: pa.Table, others: pa.Table) -> pa.Table:
        others = others.take(pc.sort_indices(others, sort_keys=[("word", "descending")])) if others.num_rows else others
        if own.num_rows and others.num_rows:
            least = own["least"].to_numpy().astype(float)
            i, j, score = _best_of_cell(_sums(own["q"]), _sums(others["sums"]), np.where(np.isnan(least), -np.inf, least), k, parts)
        else:
            i, j, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        i, j = pa.array(i), pa.array(j)
        return pa.table({"query": own["query"].take(i), "slot": own["slot"].take(i), "word": others["word"].take(j), "score": score})

    found = asked.select(*keys, "query", *([] if "slot" in keys else ["slot"]), "q", "least").groupBy(*keys).cogroup(words.select(*keys, "word", "sums").groupBy(*keys))
    return found.applyInArrow(search, f"query string, slot {kind}, word string, score double").withColumn("score", F.round("score", 6))


def bounded_pairs(model: DataFrame, own: DataFrame, *, k: int, parts: list[tuple[int, int]] | None, score) -> DataFrame:
    """(query, slot, word, score): for each query of ``own`` (query, slot, q: its sketch) the words of ``model`` (word, slot, sums) that may be among its
    ``k`` best of the slot, and so these for certain. ``score`` is a function of two sketches, ``parts`` the slices that it takes a median of.

    The scores of the slot's ``SEEDS`` longest sketches give each query a k-th score to beat. Words are in buckets of like length, whose longest
    slices are few rows; a query goes to the buckets that may hold a better score, and meets a word there only if the word's own lengths may give one. It is an
    equality join of slot and bucket. With fewer than ``k`` words in a slot all are met. Where this may be over ``MANY_PAIRS`` pairs and ``parts`` are given, words and queries of a
    slot and bucket are cells instead, in which slices are multiplied as matrices and only what is among the best of a cell comes out."""
    lengths = model.select("word", "slot", "sums", _lengths(F.col("sums"), parts).alias("lengths"))
    bucket = F.coalesce(F.floor(2 * F.log2(F.array_max("lengths"))), F.lit(-1)).cast("int")
    model = materialize(lengths.withColumn("bucket", bucket), "lengths")
    own = own.select("query", "slot", "q", _lengths(F.col("q"), parts).alias("ql"))
    longest = Window.partitionBy("slot").orderBy(F.desc(F.array_max("lengths")), "word")
    seeds = materialize(model.withColumn("place", F.row_number().over(longest)).where(F.col("place") <= max(SEEDS, 4 * k)).select("slot", "word", "sums"), "seeds")
    bytes_ = 96 + 8 * (parts[-1][1] if parts else 64) + 8 * (len(parts) if parts else 1)
    many = False
    if parts:
        own = materialize(own, "own")
        by_slot = model.groupBy("slot").agg(F.count("*").alias("words")).join(own.groupBy("slot").agg(F.count("*").alias("n")), "slot")
        many = (by_slot.agg(F.sum(F.col("words").cast("double") * F.col("n"))).first()[0] or 0) > MANY_PAIRS
    if many:
        dealt = materialize(_dealt(own.groupBy("slot").agg(F.count("*").alias("n")), "n", CELL_QUERIES, "slot"), "dealt")
        some = own.join(_unless_small(dealt, 128), "slot").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts"))).withColumn("least", F.lit(None).cast("double"))
        each = seeds.join(_unless_small(dealt, 128), "slot").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        first = _by_matrices(some, each, ["slot", "part"], k=k, parts=parts)
    else:
        first = own.join(_unless_small(seeds.select("slot", F.col("sums").alias("s")), bytes_), "slot").select("query", "slot", score(F.col("s"), F.col("q")).alias("score"))
    least = first.groupBy("query", "slot").agg(F.get(F.sort_array(F.collect_list("score"), False), F.lit(k - 1)).alias("least"))
    slices = range(len(parts) if parts else 1)
    caps = model.groupBy("slot", "bucket").agg(*(F.max(F.get("lengths", F.lit(i))).alias(f"m{i}") for i in slices), F.count("*").alias("words"))
    caps = materialize(caps.select("slot", "bucket", "words", F.array(*(f"m{i}" for i in slices)).alias("caps")), "caps")
    open_ = lambda lengths: F.col("least").isNull() | (_most(F.col(lengths), F.col("ql"), parts) >= F.col("least"))
    met = own.join(least.hint("merge"), ["query", "slot"]).join(_unless_small(caps.drop("words"), 128), "slot")
    asked = materialize(met.where(open_("caps")).drop("caps"), "asked")
    keys = ["slot", "bucket"]
    if many:
        sizes = _dealt(asked.groupBy(*keys).agg(F.count("*").alias("n")), "n", CELL_QUERIES, *keys).join(_dealt(caps, "words", CELL_WORDS, *keys).withColumnRenamed("parts", "word_parts"), keys)
        sizes = materialize(sizes, "sizes")
        each = lambda name, n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(name)
        some = asked.join(_unless_small(sizes, 128), keys).select("*", F.pmod(F.xxhash64("query"), F.col("parts")).alias("part"), each("word_part", "word_parts"))
        words = model.join(_unless_small(sizes, 128), keys).select("*", F.pmod(F.xxhash64("word"), F.col("word_parts")).alias("word_part"), each("part", "parts"))
        return _by_matrices(some, words, [*keys, "part", "word_part"], k=k, parts=parts)
    if _fits(asked, bytes_):
        met = model.join(F.broadcast(asked), keys)
    elif _fits(words := materialize(model.join(_unless_small(asked.select(*keys).distinct(), 64), keys, "left_semi"), "words"), bytes_):
        met = asked.join(F.broadcast(words), keys)
    else:
        dealt = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = words.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")).join(dealt.hint("merge"), [*keys, "salt"])
    return met.where(open_("lengths")).select("query", "slot", "word", score(F.col("sums"), F.col("q")).alias("score"))


def _dealt(sizes: DataFrame, rows: str, most: int, *keys: str) -> DataFrame:
    """(keys, parts): over how many parts of ``most`` the ``rows`` of each key are dealt out."""
    return sizes.select(*keys, F.ceil(F.col(rows) / F.lit(most)).cast("long").alias("parts"))


def _search(model: DataFrame, queries: DataFrame, *, k: int, parts: list[tuple[int, int]] | None, score, slot: bool) -> DataFrame:
    """The ``k`` best words of each of the (distinct) query words; a word that the model lacks has the score 0 with every word, and without slots the last
    ``k`` words in order are its best."""
    at = ["slot"] if slot else []
    copy = getattr(model, "_shared_path", None) is None
    model = model.select("word", (F.col("slot") if slot else F.lit(0)).alias("slot"), "sums")
    model = materialize(model, "model") if copy else model
    asked = queries.select(F.col("word").alias("query")).distinct()
    if (n := asked.limit(MAX_QUERIES + 1).count()) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} query words at once: pass them in blocks")
    own = model.join(F.broadcast(asked), F.col("query") == F.col("word")).select("query", "slot", F.col("sums").alias("q"))
    best = top_k(bounded_pairs(model, own, k=k, parts=parts, score=score), k, by=["query", "slot"]).select("query", *at, "rank", "word", "score")
    if slot or not n:
        return best
    last = [r[0] for r in model.select("word").orderBy(F.desc("word")).limit(k).collect()]
    unknown = asked.join(own, "query", "left_anti")
    if not last or unknown.isEmpty():
        return best
    listed = unknown.select("query", F.posexplode(F.array(*map(F.lit, last))).alias("place", "word"))
    zero = F.lit(0).cast(best.schema["score"].dataType)
    return best.unionByName(listed.select("query", (F.col("place") + 1).alias("rank"), "word", zero.alias("score")))


def tow_score(num_hashes: int, num_means: int):
    """The predictor's score of two sketches."""
    return lambda a, b: F.round(median_of_means(a, b, num_hashes, num_means), 6)


def tow_predict(model: DataFrame, queries: DataFrame, *, num_hashes: int, num_means: int, k: int, slot: bool = False) -> DataFrame:
    """(query[, slot], rank, word, score): words by estimated number of shared occurrences."""
    return _search(model, queries, k=k, parts=_parts(num_hashes, num_means), score=tow_score(num_hashes, num_means), slot=slot)


def tow_answers(model: DataFrame, asked: DataFrame, *, num_hashes: int, num_means: int, k: int) -> DataFrame:
    """(query, slot, rank, word, score) for queries (word, slot) that each ask in one slot of a slotted model; a word that its slot lacks has no answer."""
    own = asked.distinct().join(model, ["word", "slot"]).select(F.col("word").alias("query"), "slot", F.col("sums").alias("q"))
    found = bounded_pairs(model, own, k=k, parts=_parts(num_hashes, num_means), score=tow_score(num_hashes, num_means))
    return top_k(found, k, by=["query", "slot"]).select("query", "slot", "rank", "word", "score")


def additive_top(model: DataFrame, queries: DataFrame, *, k: int = 100) -> DataFrame:
    """(query, rank, word, score): words by dot product of additive sketches."""
    model = materialize(model.select("word", "sums"), "sums")
    size = model.select(F.max(F.size("sums"))).first()[0]
    return _search(model, queries, k=k, parts=None, score=lambda a, b: dot(a, b, size if (size or 0) <= UNROLLED else None), slot=False)


def cooccurrence_exact(docs: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query, rank, word, score): words by exact number of shared documents."""
    words = queries.select(F.col("word").alias("query"))
    pairs = docs.select("doc_id", F.explode(F.array_distinct("words")).alias("word"))
    holding = pairs.join(_small(words, 64), F.col("word") == F.col("query")).select("doc_id", "query")
    met = pairs.join(holding, "doc_id").groupBy("query", "word").agg(F.count("*").alias("score"))
    return top_k(met, k, by=["query"]).select("query", "rank", "word", "score")
