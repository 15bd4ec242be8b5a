"""Filter interaction audit by Walsh-Hadamard sums.

Five filters give each document a mask of the filters that it fails. How an order of the filters behaves depends only on how
many documents have each of the 32 masks, by part and label. Those cells are not counted as such: for each set S of filters the
sum of (-1)^|mask and S| over the documents is aggregated, 32 signed parity sums for each part and label, in one partial
aggregation whose rows are one for each part, label and task. The transform is its own inverse but for a factor of 32, so
the cells follow exactly, in whole numbers. From the cells of a part come all 120 orders, step by step, and the Shapley values
in closed form: of the documents with a mask of k failures each failing filter is first in 120 / k orders.

Plan: one scan measures the texts inside the JVM and writes a few bytes for each document (id, part, mask of the four filters that
look at the text alone, digest of the text). Copies are found by an aggregation of the digests, which has a row for
each text, and only texts that occur twice or more, with the smallest id of each, meet the documents again. The written tables are
plain sides of that join, so adaptive execution splits a digest or a label that is hot. Nothing is grouped by part but the
partial sums, so a hot part is more rows. The orders are a list of 120 short strings in the plan.

Edge cases: a null text is an empty one; a null part is the part ''; rows without an id are copies of none and none is a copy of them;
rows that share an id are documents of their own, neither of a smaller id than the other; a document has a label if any of its rows in the
labels has it; labels without an id or without a document count nowhere; no documents give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

SPACE = r"[\x20\x09-\x0D]+"
#: Failure conditions on ``words`` (an array) and ``text``.
TEXT_FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda words, text: F.size(words) < 50,
    "B": lambda words, text: 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
    "C": lambda words, text: 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
    "D": lambda words, text: text.rlike(r"[#$%&*|]"),
}
#: The filter that fails documents whose text is that of a smaller id.
COPY_FILTER = "E"
LABELS = ("all", "good", "toxic")


def _sum(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def measured(docs: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]] = TEXT_FILTERS, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask, digest): bit i of the mask is set if the text fails the i-th filter."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", SPACE), "")
    bits = lambda w: _sum([F.when(fails(w, F.col("text")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())])
    # A variable of a one-row transform: the words are split once.
    return base.select("doc_id", "part", F.transform(F.array(words), bits)[0].alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def masks(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]] = TEXT_FILTERS, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic) of each document; the highest bit of the mask is that of ``COPY_FILTER``."""
    rows = materialize(measured(docs, filters, doc_id=doc_id, text=text, part=part), "measured")
    own = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = materialize(own.where("first < last").select("digest", "first"), "first_copies")
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marks = materialize(marks.where("good OR toxic"), "marks")
    copied = rows.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(F.col("first") < F.col("doc_id"), 1 << len(filters)).otherwise(0)).alias("mask"))
    marked = copied.join(marks, "doc_id", "left")
    return marked.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def parity_sums(masked: DataFrame, n: int) -> DataFrame:
    """(part, label, sums): for each set S of the ``n`` filters the sum of (-1)^|mask and S| over the documents of a label. Each document has the label
    'all', so a part has that row."""
    labels = F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic"))
    rows = masked.select("part", "mask", F.explode(F.array_compact(labels)).alias("label"))
    sign = lambda s: F.lit(1).cast("long") - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)
    sums = rows.groupBy("part", "label").agg(*(F.sum(sign(s)).alias(f"s{s}") for s in range(1 << n)))
    return sums.select("part", "label", F.array(*(f"s{s}" for s in range(1 << n))).alias("sums"))


def cells(sums: DataFrame, n: int) -> DataFrame:
    """(part, all, good, toxic): the number of documents with each mask, from the parity sums, by the inverse transform."""
    odd = lambda m, s: F.bit_count(m.bitwiseAND(s)) % 2 == 1
    signed = lambda m: F.transform("sums", lambda w, s: F.when(odd(m, s), -w).otherwise(w))
    total = lambda m: F.aggregate(signed(m), F.lit(0).cast("long"), lambda a, x: a + x)
    count = F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda m: F.shiftright(total(m), n))
    one = sums.select("part", "label", count.alias("cells"))
    none = F.array_repeat(F.lit(0).cast("long"), 1 << n)
    return one.groupBy("part").agg(*(F.coalesce(F.first(F.when(F.col("label") == x, F.col("cells")), ignorenulls=True), none).alias(x) for x in LABELS))


def _count(of: str, keep: Callable[[Column], Column], weight: Callable[[Column], Column] = lambda m: F.lit(1)) -> Column:
    kept = F.transform(of, lambda x, m: F.when(keep(m), x * weight(m)).otherwise(0))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x)


def orders(counted: DataFrame, names: str) -> DataFrame:
    """A row for each part, order of the filters and step: what the step keeps and removes, and what that costs."""
    n = len(names)
    every = F.array(*(F.lit("".join(p)) for p in permutations(names)))
    steps = counted.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit_of = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), letter) - 1)
    place = F.sequence(F.lit(1), F.lit(n))
    before = F.aggregate(place, F.lit(0), lambda a, i: a + F.when(i < F.col("step"), bit_of(F.substring("filter_order", i, F.lit(1)))).otherwise(0))
    steps = steps.withColumn("own", bit_of(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", before)
    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    left = lambda m: m.bitwiseAND(F.col("before")) == 0
    removed = lambda m: fails(m) & left(m)
    share = lambda m: F.lit(factorial(n)) / F.bit_count(m)
    return steps.select(
        "part", "filter_order", "step",
        _count("all", lambda m: left(m) & ~fails(m)).alias("kept"),
        _count("all", removed).alias("removed"),
        _count("all", lambda m: fails(m) & ~left(m)).alias("redundant"),
        _count("all", lambda m: m == F.col("own")).alias("unique_fails"),
        _count("good", removed).alias("good_lost"),
        _count("toxic", removed).alias("toxic_lost"),
        _count("all", fails, lambda m: share(m).cast("long")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]] = TEXT_FILTERS, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of the filters and of ``COPY_FILTER``.
    The Shapley value of a filter is what it removes, summed over all orders."""
    names = "".join(filters) + COPY_FILTER
    masked = masks(docs, labels, filters, doc_id=doc_id, text=text, part=part)
    return orders(cells(parity_sums(masked, len(names)), len(names)), names)


def op12(spark, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The definitions as they stand: every document goes through every order.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), lab AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT row_number() OVER () AS r, d.part, coalesce(lab.good, false) AS good, coalesce(lab.toxic, false) AS toxic, {
    'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
    'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false)} AS fails
  FROM d LEFT JOIN lab ON d.doc_id = lab.doc_id
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM l a, l b, l c, l e, l g
  WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5
), s AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS earlier FROM o, unnest([1, 2, 3, 4, 5]) AS u(step)
), m AS (
  SELECT r, part, good, toxic, (CASE WHEN fails.A THEN 'A' ELSE '' END) || (CASE WHEN fails.B THEN 'B' ELSE '' END) || (CASE WHEN fails.C THEN 'C' ELSE '' END)
    || (CASE WHEN fails.D THEN 'D' ELSE '' END) || (CASE WHEN fails.E THEN 'E' ELSE '' END) AS failed FROM f
), e AS (
  SELECT m.part, s.filter_order, s.step, s.x, good, toxic, contains(failed, s.x) AS own, failed = s.x AS alone,
    len(list_filter(string_split(s.earlier, ''), lambda y: y <> '' AND contains(failed, y))) > 0 AS gone
  FROM m, s
), c AS (
  SELECT part, filter_order, step, x, count_if(NOT own AND NOT gone)::BIGINT AS kept, count_if(own AND NOT gone)::BIGINT AS removed,
    count_if(own AND gone)::BIGINT AS redundant, count_if(alone)::BIGINT AS unique_fails,
    count_if(own AND NOT gone AND good)::BIGINT AS good_lost, count_if(own AND NOT gone AND toxic)::BIGINT AS toxic_lost
  FROM e GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM c
"""
