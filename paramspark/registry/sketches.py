"""Co-occurrence sketches and their predictors over all documents (or all events by day)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..functions.hashing import family, java_hash
from ..operators import sketches as S
from ..plans.numbering import numbered
from ..plans.storage import folder, materialize
from ..streaming.slots import answered
from .hashes import java_sql, murmur_sql, xx64_sql
from .tables import EVENTS_SQL, PAIRS_SQL, START, WORDED_SQL, epoch, hash_sql, slotted, streamed, table, word_list, worded

BITS, HASHES, TOW, MEANS, K = 1 << 16, 4, 32, 4, 10
QUERY_WORDS = ["the", "of", "und", "la", "queque"]
SLOT_WORDS = ["click", "u7", "u46", "nobody"]


def text(column: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


def bloom_build(spark, d):
    return S.bloom_build(worded(spark, d), num_bits=BITS, num_hashes=HASHES).select("word", F.size("bits").cast("long").alias("n_bits"), text("bits"))


def bloom_build_slotted(spark, d):
    return S.bloom_build(slotted(spark, d), num_bits=BITS, num_hashes=HASHES, slot=True).select("word", "slot", text("bits"))


def bloom_predict(spark, d):
    model = S.bloom_build(worded(spark, d), num_bits=BITS, num_hashes=HASHES)
    return S.bloom_predict(model, word_list(spark, QUERY_WORDS), num_bits=BITS, num_hashes=HASHES, k=K)


def bloom_predict_slotted(spark, d):
    model = S.bloom_build(slotted(spark, d), num_bits=BITS, num_hashes=HASHES, slot=True)
    return S.bloom_predict(model, word_list(spark, SLOT_WORDS), num_bits=BITS, num_hashes=HASHES, k=3, slot=True)


def minhash_build(spark, d):
    return S.minhash_build(worded(spark, d), num_hashes=HASHES).select("word", text("signature"))


def minhash_variation(spark, d):
    return S.minhash_build_rehashed(worded(spark, d), num_hashes=HASHES).select("word", text("signature"))


def minhash_predict(spark, d):
    docs = worded(spark, d)
    return S.minhash_predict(S.minhash_build(docs, num_hashes=HASHES), S.word_count(docs), word_list(spark, QUERY_WORDS), num_hashes=HASHES)


def minhash_search(spark, d):
    """The ten best for every 50th word, of those that share a document of their signatures."""
    docs = worded(spark, d)
    model, counts = S.minhash_build(docs, num_hashes=HASHES), materialize(S.word_count(docs), "counts")
    asked = numbered(counts.select("word"), [F.col("word")], "number").where(F.col("number") % 50 == 0).select("word")
    return S.minhash_predict(model, counts, asked, num_hashes=HASHES, k=K, matched_only=True)


def tow_build(spark, d):
    return S.tow_build(worded(spark, d), num_hashes=TOW).select("word", text("sums"))


def tow_build_slotted(spark, d):
    return S.tow_build(slotted(spark, d), num_hashes=TOW, slot=True).select("word", "slot", text("sums"))


def tow_predict(spark, d):
    model = S.tow_build(worded(spark, d), num_hashes=TOW)
    return S.tow_predict(model, word_list(spark, QUERY_WORDS), num_hashes=TOW, num_means=MEANS, k=K)


def tow_predict_slotted(spark, d):
    model = S.tow_build(slotted(spark, d), num_hashes=TOW, slot=True)
    return S.tow_predict(model, word_list(spark, SLOT_WORDS), num_hashes=TOW, num_means=MEANS, k=3, slot=True)


def tow_stream(spark, d):
    """Events as a stream: type and user as words, a day a slot; every 50th event asks for its user in its slot. Rows of the slots that have closed."""
    events = streamed(spark, d, "events").withColumn("at", epoch(F.col("ts")))
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    docs = events.select(F.col("at").alias("ts"), F.col("event_id").alias("doc_id"), F.array("event_type", user).alias("words"))
    queries = events.where(F.col("event_id") % 50 == 0).select(F.col("at").alias("ts"), user.alias("word"))
    return answered(docs, queries, folder(spark, "answers"), folder(spark, "stream"), num_hashes=TOW, num_means=MEANS, k=3, hours=24, start=START)


def additive_top(spark, d):
    return S.additive_top(S.tow_build(worded(spark, d), num_hashes=TOW), word_list(spark, QUERY_WORDS), k=K)


def family_values(spark, d):
    """Each family's hashes of all document ids as they are, and the string hash of texts that end in them."""
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    both = F.concat(family(F.col("id"), 2, "murmur3"), family(F.col("id"), 2, "xx64"))
    return ids.select("id", F.posexplode(both).alias("i", "h"), java_hash(F.concat(F.lit("word"), F.col("id").cast("string"))).alias("java"))


def java_hash_words(spark, d):
    """The string hash of every distinct word of all documents."""
    words = S.word_count(worded(spark, d)).select("word")
    return words.select("word", java_hash(F.col("word")).alias("java"))


def bloom_murmur(spark, d):
    """Bloom sketches by Murmur3, as a digest of their bits."""
    model = S.bloom_build(slotted(spark, d), num_bits=1 << 20, num_hashes=HASHES, hashes="murmur3")
    return model.select("word", F.size("bits").cast("long").alias("n_bits"), F.md5(F.array_join(F.col("bits").cast("array<string>"), ",")).alias("bits_md5"))


def tow_xx(spark, d):
    """Tug-of-war sums by XXH64."""
    return S.tow_build(slotted(spark, d), num_hashes=TOW, hashes="xx64").select("word", text("sums"))


def word_count(spark, d):
    return S.word_count(worded(spark, d))


def exact(spark, d):
    return S.cooccurrence_exact(worded(spark, d), word_list(spark, QUERY_WORDS), k=K)


def rank_correlation(spark, d):
    docs, queries = worded(spark, d), word_list(spark, QUERY_WORDS)
    model = S.bloom_build(docs, num_bits=BITS, num_hashes=HASHES)
    guess = S.bloom_predict(model, queries, num_bits=BITS, num_hashes=HASHES, k=30)
    return E.correlations(E.aligned(guess, S.cooccurrence_exact(docs, queries, k=30)))


def mean_rank_correlation(spark, d):
    return E.mean_correlations(rank_correlation(spark, d))


def _words(words: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{w}')" for w in words) + ") AS v(query)"


def _top(sql: str, by: str, k: int | None) -> str:
    ranked = f"SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY score DESC, word DESC) AS INTEGER) AS rank FROM ({sql})"
    return f"SELECT {by}, rank, word, score FROM ({ranked})" + (f" WHERE rank <= {k}" if k else "")


_BIT = f"CAST({hash_sql('doc_id', 'i')} % {BITS} AS INTEGER)"
_RANGE = "unnest(range(0, {n})) AS u(i)"
_BLOOM = f"WITH {WORDED_SQL}, {PAIRS_SQL}, h AS (SELECT doc_id, i, {_BIT} AS bit FROM (SELECT DISTINCT doc_id FROM w), {_RANGE.format(n=HASHES)}), b AS (SELECT DISTINCT word, bit FROM dw JOIN h USING (doc_id))"
_BLOOM_S = f"WITH {EVENTS_SQL}, b AS (SELECT DISTINCT word, slot, {_BIT} AS bit FROM sw, {_RANGE.format(n=HASHES)})"


def _e(n: str) -> str:
    return f"(CASE WHEN {n} >= {BITS} THEN 'inf'::DOUBLE ELSE {-BITS / HASHES} * ln(1.0::DOUBLE - {n} / {BITS}.0::DOUBLE) END)"


_BLOOM_SCORE = f"""n AS (SELECT word, count(*) AS n FROM b GROUP BY word),
  c AS (SELECT query, x.word, count(*) AS c FROM {_words(QUERY_WORDS)} JOIN b q ON q.word = query JOIN b x ON x.bit = q.bit GROUP BY 1, 2),
  p AS (SELECT v.query, n.word, round({_e("n.n")} + {_e("coalesce(m.n, 0)")} - {_e("(n.n + coalesce(m.n, 0) - coalesce(c, 0))")}, 6) AS score
    FROM {_words(QUERY_WORDS)} CROSS JOIN n LEFT JOIN n m ON m.word = query LEFT JOIN c ON c.query = v.query AND c.word = n.word)"""
_BLOOM_TOP = _top("SELECT query, word, score FROM p", "query", K)
_BLOOM_SCORE_S = f"""n AS (SELECT word, slot, count(*) AS n FROM b GROUP BY 1, 2),
  c AS (SELECT query, x.word, x.slot, count(*) AS c FROM {_words(SLOT_WORDS)} JOIN b q ON q.word = query JOIN b x ON x.bit = q.bit AND x.slot = q.slot GROUP BY 1, 2, 3),
  p AS (SELECT query, n.slot, n.word, round({_e("n.n")} + {_e("m.n")} - {_e("(n.n + m.n - coalesce(c, 0))")}, 6) AS score
    FROM {_words(SLOT_WORDS)} JOIN n m ON m.word = query JOIN n ON n.slot = m.slot LEFT JOIN c ON c.query = v.query AND c.word = n.word AND c.slot = n.slot)"""
_BLOOM_SCORE_S = _BLOOM_SCORE_S.replace("SELECT query, n.slot", "SELECT v.query, n.slot")

_MIN = f"WITH {WORDED_SQL}, {PAIRS_SQL}, h AS (SELECT doc_id, i, {hash_sql('doc_id', 'i')} AS h FROM (SELECT DISTINCT doc_id FROM w), {_RANGE.format(n=HASHES)}), m AS (SELECT word, i, first(doc_id ORDER BY h, doc_id) AS d FROM dw JOIN h USING (doc_id) GROUP BY 1, 2)"
_SIG = _MIN + " SELECT word, string_agg(CAST(d AS VARCHAR), ',' ORDER BY i) AS signature FROM m GROUP BY word"
_SIGN = f"CAST((({hash_sql('doc_id', '0')} >> i) & 1) * 2 - 1 AS BIGINT)"
_TOW = f"WITH {WORDED_SQL}, h AS (SELECT doc_id, i, {_SIGN} AS s FROM (SELECT DISTINCT doc_id FROM w), {_RANGE.format(n=TOW)}), x AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM w) GROUP BY 1, 2), t AS (SELECT word, i, CAST(sum(n * s) AS BIGINT) AS s FROM x JOIN h USING (doc_id) GROUP BY 1, 2)"
_TOW_S = f"WITH {EVENTS_SQL}, t AS (SELECT word, slot, i, CAST(sum({_SIGN}) AS BIGINT) AS s FROM sw, {_RANGE.format(n=TOW)} GROUP BY 1, 2, 3)"
_SLICE = TOW // MEANS
_MEDIAN = f"(l[{MEANS // 2}] + l[{MEANS // 2 + 1}]) / 2"
_COUNTS = f"WITH {WORDED_SQL}, {PAIRS_SQL}, c AS (SELECT query, x.word, count(*) AS score FROM {_words(QUERY_WORDS)} JOIN dw q ON q.word = query JOIN dw x USING (doc_id) GROUP BY 1, 2)"
_CORR = f"""{_BLOOM}, {_BLOOM_SCORE}, g AS ({_top("SELECT query, word, score FROM p", "query", 30)}),
  ec AS (SELECT query, x.word, count(*) AS score FROM {_words(QUERY_WORDS)} JOIN dw q ON q.word = query JOIN dw x USING (doc_id) GROUP BY 1, 2),
  e AS ({_top("SELECT query, word, score FROM ec", "query", 30)}),
  a AS (SELECT query, word, coalesce(g.score, 0) AS x, coalesce(e.score, 0)::DOUBLE AS y FROM g FULL JOIN e USING (query, word)),
  k AS (SELECT *, rank() OVER (PARTITION BY query ORDER BY x) + (count(*) OVER (PARTITION BY query, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY query ORDER BY y) + (count(*) OVER (PARTITION BY query, y) - 1) / 2.0 AS ry,
    row_number() OVER (PARTITION BY query ORDER BY x DESC, y DESC, word) AS place FROM a),
  l AS (SELECT query, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM k GROUP BY query),
  s AS (SELECT a.query, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy, 1.0::DOUBLE / a.place + 1.0::DOUBLE / b.place AS w FROM k a JOIN k b ON a.query = b.query AND a.place < b.place),
  q AS (SELECT query, sum(sx * sy) / sqrt(sum(abs(sx)) * sum(abs(sy))::DOUBLE) AS kendall, sum(w * sx * sy) / sqrt(sum(w * abs(sx)) * sum(w * abs(sy))) AS weighted_kendall FROM s GROUP BY query),
  z AS (SELECT query, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(kendall, 6) AS kendall, round(weighted_kendall, 6) AS weighted_kendall FROM l LEFT JOIN q USING (query))"""

QUERIES = {
    "hash_families": family_values,
    "java_hash_words": java_hash_words,
    "bloom_murmur3": bloom_murmur,
    "tow_xx64": tow_xx,
    "word_count": word_count,
    "bloom_build": bloom_build,
    "bloom_build_slotted": bloom_build_slotted,
    "bloom_predict": bloom_predict,
    "bloom_predict_slotted": bloom_predict_slotted,
    "minhash_build": minhash_build,
    "minhash_variation": minhash_variation,
    "minhash_predict": minhash_predict,
    "minhash_search": minhash_search,
    "tow_build": tow_build,
    "tow_build_slotted": tow_build_slotted,
    "tow_predict": tow_predict,
    "tow_predict_slotted": tow_predict_slotted,
    "tow_stream_slots": tow_stream,
    "additive_sketch_top": additive_top,
    "cooccurrence_exact": exact,
    "sketch_rank_correlation": rank_correlation,
    "sketch_mean_correlation": mean_rank_correlation,
}

ORACLE_SQL = {
    "hash_families": f"""WITH m AS ({murmur_sql("SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS t FROM documents", 2)}), x AS ({xx64_sql("SELECT doc_id AS id FROM documents", 2)}),
      j AS ({java_sql("SELECT doc_id AS id, 'word' || doc_id AS t FROM documents")})
      SELECT id, i, h, java FROM (SELECT id, i, CAST(h AS BIGINT) AS h FROM m UNION ALL SELECT id, i + 2, CAST(h AS BIGINT) FROM x) JOIN j USING (id)""",
    "java_hash_words": f"""WITH {WORDED_SQL} SELECT id AS word, java FROM ({java_sql("SELECT DISTINCT word AS id, word AS t FROM (SELECT unnest(words) AS word FROM w)")})""",
    "bloom_murmur3": f"""WITH {EVENTS_SQL}, m AS ({murmur_sql("SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS t FROM s", HASHES)}),
      b AS (SELECT DISTINCT word, CAST((h + 4294967296) % {1 << 20} AS INTEGER) AS bit FROM sw JOIN m ON id = doc_id)
      SELECT word, count(*) AS n_bits, md5(string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit)) AS bits_md5 FROM b GROUP BY word""",
    "tow_xx64": f"""WITH {EVENTS_SQL}, x AS ({xx64_sql("SELECT doc_id AS id FROM s", 1)}),
      t AS (SELECT word, i, CAST(sum(((u >> i::UHUGEINT) & 1::UHUGEINT)::BIGINT * 2 - 1) AS BIGINT) AS s FROM sw JOIN (SELECT id, u FROM x) ON id = doc_id, {_RANGE.format(n=TOW)} GROUP BY 1, 2)
      SELECT word, string_agg(CAST(s AS VARCHAR), ',' ORDER BY i) AS sums FROM t GROUP BY word""",
    "word_count": f"WITH {WORDED_SQL} SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM w) GROUP BY word",
    "bloom_build": _BLOOM + " SELECT word, count(*) AS n_bits, string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit) AS bits FROM b GROUP BY word",
    "bloom_build_slotted": _BLOOM_S + " SELECT word, slot, string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit) AS bits FROM b GROUP BY word, slot",
    "bloom_predict": f"{_BLOOM}, {_BLOOM_SCORE} {_BLOOM_TOP}",
    "bloom_predict_slotted": f"{_BLOOM_S}, {_BLOOM_SCORE_S} " + _top("SELECT query, slot, word, score FROM p", "query, slot", 3),
    "minhash_build": _SIG,
    "minhash_variation": _SIG,
    "minhash_predict": f"""{_MIN}, n AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM w) GROUP BY word),
      j AS (SELECT query, n.word, count(a.d)::DOUBLE / {HASHES} AS j FROM {_words(QUERY_WORDS)} CROSS JOIN n LEFT JOIN (SELECT x.word, q.word AS qw, x.d FROM m x JOIN m q ON x.i = q.i AND x.d = q.d) a ON a.word = n.word AND a.qw = query GROUP BY 1, 2),
      p AS (SELECT query, j.word, CAST(floor(j * (n.n + coalesce(k.n, 0)) / (j + 1) + 0.5) AS BIGINT) AS score FROM j JOIN n ON n.word = j.word LEFT JOIN n k ON k.word = query) """
    + _top("SELECT query, word, score FROM p", "query", None),
    "minhash_search": f"""{_MIN}, n AS (SELECT word, count(*) AS n, row_number() OVER (ORDER BY encode(word)) - 1 AS number FROM (SELECT unnest(words) AS word FROM w) GROUP BY word),
      j AS (SELECT q.word AS query, x.word, count(*)::DOUBLE / {HASHES} AS j FROM m x JOIN m q ON x.i = q.i AND x.d = q.d JOIN n ON n.word = q.word AND n.number % 50 = 0 GROUP BY 1, 2),
      p AS (SELECT query, j.word, CAST(floor(j * (n.n + k.n) / (j + 1) + 0.5) AS BIGINT) AS score FROM j JOIN n ON n.word = j.word JOIN n k ON k.word = query) """
    + _top("SELECT query, word, score FROM p", "query", K),
    "tow_build": _TOW + " SELECT word, string_agg(CAST(s AS VARCHAR), ',' ORDER BY i) AS sums FROM t GROUP BY word",
    "tow_build_slotted": _TOW_S + " SELECT word, slot, string_agg(CAST(s AS VARCHAR), ',' ORDER BY i) AS sums FROM t GROUP BY word, slot",
    "tow_predict": f"""{_TOW}, d AS (SELECT query, t.word, t.i // {_SLICE} AS g, sum(t.s * coalesce(q.s, 0)) / {_SLICE}.0::DOUBLE AS m
        FROM {_words(QUERY_WORDS)} CROSS JOIN t LEFT JOIN t q ON q.word = query AND q.i = t.i GROUP BY 1, 2, 3),
      p AS (SELECT query, word, round({_MEDIAN}, 6) AS score FROM (SELECT query, word, list(m ORDER BY m) AS l FROM d GROUP BY 1, 2)) """
    + _top("SELECT query, word, score FROM p", "query", K),
    "tow_predict_slotted": f"""{_TOW_S}, d AS (SELECT query, t.slot, t.word, t.i // {_SLICE} AS g, sum(t.s * q.s) / {_SLICE}.0::DOUBLE AS m
        FROM {_words(SLOT_WORDS)} JOIN t q ON q.word = query JOIN t ON t.slot = q.slot AND q.i = t.i GROUP BY 1, 2, 3, 4),
      p AS (SELECT query, slot, word, round({_MEDIAN}, 6) AS score FROM (SELECT query, slot, word, list(m ORDER BY m) AS l FROM d GROUP BY 1, 2, 3)) """
    + _top("SELECT query, slot, word, score FROM p", "query, slot", 3),
    "tow_stream_slots": f"""{_TOW_S}, a AS (SELECT slot, 'u' || user_id AS query FROM s JOIN events ON event_id = doc_id WHERE doc_id % 50 = 0 GROUP BY ALL),
      z AS (SELECT floor((least(max(floor(epoch(ts))), max(floor(epoch(ts))) FILTER (event_id % 50 = 0)) - {START} - 3600) / 86400) AS closed FROM events),
      d AS (SELECT query, t.slot, t.word, t.i // {_SLICE} AS g, sum(t.s * q.s) / {_SLICE}.0::DOUBLE AS m
        FROM a JOIN t q ON q.word = query AND q.slot = a.slot JOIN t ON t.slot = q.slot AND q.i = t.i WHERE t.slot < (SELECT closed FROM z) GROUP BY 1, 2, 3, 4),
      p AS (SELECT query, slot, word, round({_MEDIAN}, 6) AS score FROM (SELECT query, slot, word, list(m ORDER BY m) AS l FROM d GROUP BY 1, 2, 3)) """
    + _top("SELECT query, slot, word, score FROM p", "query, slot", 3),
    "additive_sketch_top": f"""{_TOW}, p AS (SELECT query, t.word, CAST(coalesce(sum(t.s * q.s), 0) AS BIGINT) AS score FROM {_words(QUERY_WORDS)} CROSS JOIN t LEFT JOIN t q ON q.word = query AND q.i = t.i GROUP BY 1, 2) """
    + _top("SELECT query, word, score FROM p", "query", K),
    "cooccurrence_exact": f"{_COUNTS} " + _top("SELECT query, word, score FROM c", "query", K),
    "sketch_rank_correlation": f"{_CORR} SELECT * FROM z",
    "sketch_mean_correlation": f"{_CORR} SELECT count(*) AS n, round(avg(pearson), 6) AS pearson, round(avg(spearman), 6) AS spearman, round(avg(kendall), 6) AS kendall, round(avg(weighted_kendall), 6) AS weighted_kendall FROM z WHERE pearson IS NOT NULL AND spearman IS NOT NULL AND kendall IS NOT NULL AND weighted_kendall IS NOT NULL AND NOT isnan(pearson) AND NOT isnan(kendall)",
}
