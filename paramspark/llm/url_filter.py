"""URL filter: host/path rules, then a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

The filter's blocks are a DataFrame ``(block, w0..w3)`` built by ``bit_or`` per block, so it is built by the cluster and never
passes through the driver. It is broadcast only when its size, which follows from the number of listed URLs, is under a bound;
beyond that the probe is a shuffled join on the block. URLs that pass meet the list in an exact hash join, which removes false
positives: by broadcast under the same bound, in the one pass that probes; else URLs that do not pass skip that join's shuffle. The
list is written once before its three readers.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no rule and is never listed (verdict ``allow``);
repeated rows are judged one by one; null entries and duplicates of the list count once; an empty list lists nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, materialize

MAX_RULES = 1000
BROADCAST_BYTES = 32 << 20
BLOCK_BITS = 256
WORDS = [f"w{i}" for i in range(4)]


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without trailing slashes, other than tracking parameters in order; no scheme, no fragment.

    Null where the URL has no host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|ref)=")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), tail))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits; its fields are null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules can be compiled into one projection, got {len(rules)}")
    found = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _masks(url: Column) -> list[Column]:
    """Two bits in each of the block's four words."""
    bits = F.xxhash64(url, F.lit(1))
    at = lambda i: F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, at(i)).bitwiseOR(F.call_function("shiftleft", one, at(i + 4))) for i in range(4)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of the distinct, non-null ``url`` column of ``listed``."""
    masks = listed.select(F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block"), *(m.alias(w) for m, w in zip(_masks(F.col("url")), WORDS, strict=True)))
    return masks.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in WORDS))


def mark_listed(pages: DataFrame, listed: DataFrame, url: str, bits_per_url: int = 12) -> DataFrame:
    """``pages`` with a boolean ``listed``: whether column ``url`` (canonical) is in ``listed.url``."""
    listed = materialize(listed.where(F.col("url").isNotNull()).select("url").distinct(), "listed_urls")
    n = listed.count()
    blocks = max(1, math.ceil(n * bits_per_url / BLOCK_BITS))
    built = bloom_blocks(listed, blocks).withColumnsRenamed({"block": "__block"} | {w: f"__{w}" for w in WORDS})
    apart = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))  # null URLs are dealt out
    keyed = pages.withColumn("__block", F.when(F.col(url).isNotNull(), F.pmod(F.xxhash64(url), F.lit(blocks))).otherwise(apart))
    probed = keyed.join(F.broadcast(built) if blocks * 40 <= BROADCAST_BYTES else built, "__block", "left")
    passes = F.lit(True)
    for w, mask in zip(WORDS, _masks(F.col(url)), strict=True):
        passes = passes & (F.col(f"__{w}").bitwiseAND(mask) == mask)
    probed = probed.withColumn("__maybe", F.coalesce(passes & F.col(url).isNotNull(), F.lit(False)))
    scratch = ["__block", "__maybe", "__hit", "__url", *(f"__{w}" for w in WORDS)]
    exact = listed.select(F.col("url").alias("__url"), F.lit(True).alias("__hit"))
    if (listed.agg(F.sum(F.octet_length("url"))).first()[0] or 0) + 32 * n <= BROADCAST_BYTES:  # one pass over the pages
        hit = probed.join(F.broadcast(exact), F.when(F.col("__maybe"), F.col(url)) == F.col("__url"), "left")
        return hit.withColumn("listed", F.coalesce("__hit", F.lit(False))).drop(*scratch)
    maybe = probed.where("__maybe").join(exact, F.col(url) == F.col("__url"), "left").withColumn("listed", F.coalesce("__hit", F.lit(False)))
    no = probed.where(~F.col("__maybe")).withColumn("listed", F.lit(False))
    return maybe.drop(*scratch).unionByName(no.drop(*scratch))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical_url, listed); other columns of ``pages`` are not read."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canonical_url"))
    ruled = parsed.withColumn("__found", longest_rule(F.col("host"), F.col("path"), rules))
    judged = mark_listed(ruled, listed, "canonical_url")
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("__found.rule").alias("rule"), F.coalesce(F.col("__found.verdict"), own).alias("verdict"), "canonical_url", "listed")


# Fixed values of the op8 contract.
RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]
#: The list that the op8 query blocks: the canonical URL of each page that a look at its content found to be junk (symbols for text).
JUNK = r"(%%%|\*\*\*|###|\|\|\|)"


def op8(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    listed = pages.where(F.col("html").rlike(JUNK)).select(canonical(F.col("url")).alias("url"))
    return judge_urls(pages, listed, RULES)


OP8_SQL = rf"""
WITH cut AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parsed AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)='))) AS kept
  FROM cut
), canon AS (
  SELECT page_id, html, host, path, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN
    regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical_url
  FROM parsed
), listed AS (
  SELECT DISTINCT canonical_url AS u FROM canon WHERE regexp_matches(html, '{JUNK}') AND canonical_url IS NOT NULL
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM canon JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT c.page_id, c.host, c.path, b.rule, coalesce(b.verdict, CASE WHEN l.u IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  c.canonical_url, l.u IS NOT NULL AS listed
FROM canon c LEFT JOIN best b USING (page_id) LEFT JOIN listed l ON l.u = c.canonical_url
"""
