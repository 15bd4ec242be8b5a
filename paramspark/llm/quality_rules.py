"""Quality rules: a threshold table compiled into one Spark projection, evaluated without user functions.

``measures`` gives the counts of one text as column expressions: higher-order functions over the text's own words and lines, so
a row never leaves its task and nothing is shuffled; a hot source or a group of copies is rows like any other. ``Threshold``
rows say which ratio must lie where; ``compile_thresholds`` turns them into the verdict.

Repeated windows: each 3-word window is hashed to 64 bits, (hash, position) pairs are sorted, and windows next to an equal hash
are repeated; the union of their positions is counted from the gaps. That is n log n in the words of a text.

Edge cases: a null or empty text has no words and fails; ties and repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
# Common function words of the four languages.
STOP_WORDS = ["a", "and", "de", "der", "die", "du", "el", "en", "et", "for", "in", "is", "la", "las", "le", "les", "los", "of", "on", "que", "the", "to", "un", "und"]


class Threshold(NamedTuple):
    """``least <= numerator / denominator <= most``; a bound of None is open. A denominator of 0 passes."""

    numerator: str
    denominator: str | None
    least: float | None
    most: float | None


#: The method's own table: length, symbol, stop-word and line ratios.
THRESHOLDS = [
    Threshold("word_chars", "n_words", 2, 14),
    Threshold("n_words", None, 50, None),
    Threshold("n_symbols", "n_words", None, 0.1),
    Threshold("n_stop_words", "n_words", 0.03, None),
    Threshold("n_dup_lines", "n_lines", None, 0.4),
    Threshold("n_upper_chars", "word_chars", None, 0.5),
    Threshold("n_mark_lines", "n_lines", None, 0.5),
]


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body`` as a variable."""
    return F.transform(F.array(value), body)[0]


def _with_repeats(words: Column) -> Column:
    window = F.struct
    pairs = F.transform(words, lambda w, i: window(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def covered(order: Column) -> Column:
        n = F.size(order)
        at = F.filter(F.transform(order, lambda p, j: F.when((p["h"] == F.get(order, j - 1)["h"]) | (p["h"] == F.get(order, j + 1)["h"]), p["i"])), lambda x: x.isNotNull())
        gaps = lambda s: F.aggregate(s, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("end")), lambda a, x: F.struct((a["n"] + x + 3 - F.greatest(x, a["end"])).alias("n"), (x + 3).alias("end")), lambda a: a["n"])
        return F.when(n > 0, gaps(F.sort_array(at))).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > 3, _let(F.sort_array(F.slice(pairs, 1, F.greatest(F.size(words) - 2, F.lit(0)))), covered)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts that thresholds refer to."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    words = F.array_remove(F.split("__text", SPACE + "+"), "")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _with_repeats(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    def by_line(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: F.regexp_count(y, F.lit(SYMBOLS)) > 2)).cast("long").alias("n_mark_lines"),
        )

    return base.select(
        "doc_id",
        _let(words, counts).alias("__w"),
        _let(lines, by_line).alias("__l"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("__text", F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_upper_chars"),
    ).select("doc_id", "__w.*", "__l.*", "n_symbols", "n_upper_chars")


def compile_thresholds(table: Sequence[Threshold]) -> Column:
    passes = F.lit(True)
    for t in table:
        value = F.col(t.numerator).cast("double")
        part = F.col(t.denominator).cast("double") if t.denominator else F.lit(1.0)
        bounds = [value >= t.least * part] * (t.least is not None) + [value <= t.most * part] * (t.most is not None)
        for fits in bounds:
            passes = passes & ((part == 0) | fits)
    return passes


def quality_rules(docs: DataFrame, thresholds: Sequence[Threshold] = THRESHOLDS, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All measures with base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, doc_id=doc_id, text=text).withColumn("base_failed", failed).withColumn("kept", ~failed & compile_thresholds(thresholds))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), win AS (
  SELECT doc_id, i, w[i] || chr(9) || w[i+1] || chr(9) || w[i+2] AS g FROM s, unnest(generate_series(1, len(w) - 2)) AS u(i)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, unnest([0, 1, 2]) AS o(k) GROUP BY doc_id
), m AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop,
    length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper,
    len(list_filter(lines, lambda x: length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) > 2)) AS n_mark
  FROM s LEFT JOIN rep r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND (n_words = 0 OR (word_chars >= 2 * n_words AND word_chars <= 14 * n_words)) AND n_words >= 50
    AND (n_words = 0 OR n_symbols <= 0.1::DOUBLE * n_words) AND (n_words = 0 OR n_stop >= 0.03::DOUBLE * n_words)
    AND (n_lines = 0 OR n_dup_lines <= 0.4::DOUBLE * n_lines) AND (word_chars = 0 OR n_upper <= 0.5::DOUBLE * word_chars)
    AND (n_lines = 0 OR n_mark <= 0.5::DOUBLE * n_lines) AS kept
FROM m
"""
