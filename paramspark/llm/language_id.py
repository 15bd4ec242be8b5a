"""Language ID by rank-order profiles.

A profile is the ranked list of a language's most frequent letter n-grams (1 to 3 letters, words set off by a space). A
document's own most frequent n-grams are compared with each profile by the out-of-place distance: the sum of rank differences,
with a fixed largest value for n-grams that the profile lacks. The nearest profile wins; equal distances go to the language
that sorts first.

Profiles are fitted on a sample of labelled rows, at most about ``sample_per_lang`` rows a language, drawn by a hash of the id
(a documented bound, so fitting does not grow with the corpus). What reaches the driver is
``profile_size`` n-grams for each of at most ``MAX_LANGS`` languages.
Prediction reads every whole text once, row by row; nothing is shuffled.

Edge cases: null texts and texts without a letter give ``und`` and score 0, and so does every text if nothing was learned;
repeated rows get equal results; rows with a null id or lang are not learned from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, map_batches, record_batch, slices

PROFILE_SIZE = 300
SAMPLE_PER_LANG = 4000
MAX_LANGS = 5000

_BMP = np.array([c if chr(c).isalpha() else 0 for c in range(0x10000)], np.uint32)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, runs of anything else as one 0, with a 0 at both ends; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() >= 0x10000:
        wide = np.flatnonzero(codes >= 0x10000)
        out = _BMP[np.minimum(codes, 0xFFFF)]
        out[wide] = [c if chr(c).isalpha() else 0 for c in codes[wide].tolist()]
    else:
        out = _BMP[codes]
    if not out.any():
        return np.empty(0, np.uint32)
    out = np.concatenate([[0], out, [0]]).astype(np.uint64)
    return out[np.concatenate([[True], (out[1:] | out[:-1]) > 0])]


def ngrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams as numbers (20 bits a letter and the length on top), sorted, with their counts."""
    b = np.uint64(20)
    two = (codes[:-1] << b) | codes[1:]
    three = (two[:-1] << b) | codes[2:]
    return np.unique(np.concatenate([codes[codes > 0], two | np.uint64(1 << 60), three | np.uint64(1 << 61)]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent n-grams in order of falling count; ties by number."""
    if len(grams) > most:
        floor = np.partition(counts, len(counts) - most)[len(counts) - most]
        above = np.flatnonzero(counts > floor)
        take = np.concatenate([above, np.flatnonzero(counts == floor)[: most - len(above)]])
        grams, counts = grams[take], counts[take]
    return grams[np.lexsort((grams, -counts))]


def fit_profiles(labelled: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", profile_size: int = PROFILE_SIZE, sample_per_lang: int = SAMPLE_PER_LANG) -> dict[str, list[int]]:
    """Ranked n-grams by language, from a bounded sample of the rows that have a text and a language."""
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = [tuple(r) for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()]
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"profiles of at most {MAX_LANGS} languages can be learned")
    share = F.broadcast(labelled.sparkSession.createDataFrame([(name, sample_per_lang / n) for name, n in sizes], "lang string, share double"))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    sample = rows.join(share, "lang").where(drawn).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = {}
        for batch in batches:
            for part in slices(batch):
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if len(codes := letters(text)):
                        totals.setdefault(name, Counter()).update(dict(zip(*(x.tolist() for x in ngrams(codes)), strict=True)))
        for name, total in totals.items():
            yield record_batch({"lang": pa.array([name] * len(total)), "gram": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    counts = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for row in counts.withColumn("rank", order).where(F.col("rank") <= profile_size).orderBy("lang", "rank").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Profiles:
    """The profiles as one table: a row of ranks for each language over all their n-grams."""

    def __init__(self, profiles: dict[str, list[int]], profile_size: int):
        self.langs, self.size = sorted(profiles), profile_size
        self.vocabulary = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.ranks = np.full((len(self.langs), len(self.vocabulary) + 1), -1, np.int64)
        for i, name in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.vocabulary, np.array(profiles[name], np.uint64))] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not len(codes := letters(text)):
            return "und", 0.0
        own = ranked(*ngrams(codes), self.size)
        slot = np.searchsorted(self.vocabulary, own)
        known = slot < len(self.vocabulary)
        known[known] = self.vocabulary[slot[known]] == own[known]
        theirs = self.ranks[:, np.where(known, slot, len(self.vocabulary))]
        distance = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * len(own))


def identify(docs: DataFrame, profiles: dict[str, list[int]], *, doc_id: str = "doc_id", text: str = "text", profile_size: int = PROFILE_SIZE) -> DataFrame:
    """(doc_id, lang_pred, score) of every text."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        known = Profiles(profiles, profile_size)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [known.predict(text) for text in batch.column(1).to_pylist()]
            return record_batch({"doc_id": batch.column(0), "lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())})

        return each

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(kept, make, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = fit_profiles(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4)))
    return identify(docs, profiles).select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")
