"""Factorization, top-K recommendation, passive-aggressive classification and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import portable
from ..functions.vectors import attach_length
from ..operators import evaluation as E
from ..operators import factorization as M
from ..operators import passive_aggressive as PA
from ..operators import stratified as ST
from ..operators import topk as K
from ..plans.storage import folder
from ..streaming.measures import measured
from .tables import RATINGS_SQL, WORDED_SQL, hash_sql, ratings, table, vectors, worded

SIZE, RATE, LOW, HIGH = 4, 0.1, -0.5, 0.5
FEATURES, CLASSES = 4096, 10
STRATA = 256


# --- Factorization -------------------------------------------------------------------------------------------------------


def start(rated) -> M.Factors:
    return M.Factors(M.initial(rated, "user", SIZE, LOW, HIGH, 0), M.initial(rated, "item", SIZE, LOW, HIGH, 1))


def tall(factors: M.Factors):
    """(side, id, k, v), rounded."""
    one = lambda df, side: df.select(F.lit(side).alias("side"), "id", F.posexplode("vec").alias("k", "v")).withColumn("v", F.round("v", 6) + 0.0)
    return one(factors.users, "user").unionByName(one(factors.items, "item"))


def mf_init(spark, d):
    return tall(start(ratings(spark, d)))


def mf_step(loss):
    def run(spark, d):
        rated = M.materialize(ratings(spark, d), "ratings")  # read for the ids of both sides too
        deltas = M.sgd_deltas(rated, start(rated), size=SIZE, rate=RATE, loss=loss)
        return deltas.select("user", "item", (F.round(F.get("du", F.lit(0)), 6) + 0.0).alias("du0"), (F.round(F.get("di", F.lit(SIZE - 1)), 6) + 0.0).alias("di_last"))

    return run


def mf_epoch(spark, d):
    rated = M.materialize(ratings(spark, d), "ratings")
    factors, parts = start(rated), M.Parts(rated)
    for _ in range(2):
        factors = parts.round(factors, size=SIZE, rate=RATE, how="mean")
    return tall(factors)


def mf_offline(spark, d):
    rated = M.materialize(ratings(spark, d), "ratings")
    parts = M.Parts(rated)
    return E.rmse(parts.predict(M.train_offline(rated, size=10, low=0.0, high=0.4, rate=0.5, rounds=6, parts=parts)))


def mf_stratum(spark, d):
    """All factors after the ordered steps of one stratum of many."""
    placed = M.materialize(ST.placed_ratings(ratings(spark, d), STRATA), "ratings")
    state = ST.state_of(M.Factors(M.initial(placed, "user", SIZE, LOW, HIGH, 0), M.initial(placed, "item", SIZE, LOW, HIGH, 1)), STRATA, 0)
    return tall(ST.factors_of(M.materialize(ST.stratum_pass(placed, state, 3, blocks=STRATA, rate=RATE), "state")))


def mf_offline_negatives(spark, d):
    rated = M.materialize(ratings(spark, d), "ratings")
    factors = M.train_offline(rated, size=SIZE, low=0.0, high=0.4, rate=0.3, rounds=2, negatives=2, memory=8)
    return E.rmse(M.Parts(rated).predict(factors))


def mf_online(spark, d):
    rated = M.materialize(ratings(spark, d), "ratings")
    factors = M.train_online(rated, size=SIZE, low=0.0, high=0.4, rate=0.5, batches=6)
    return tall(factors)


def mf_online_negatives(spark, d):
    rated = M.materialize(ratings(spark, d), "ratings")
    factors = M.train_online(rated, size=SIZE, low=0.0, high=0.4, rate=0.5, batches=3, negatives=2, memory=4)
    return tall(factors)


def negatives(spark, d):
    return M.negative_samples(ratings(spark, d), rate=2, memory=4)


def negatives_of_few(spark, d):
    """Four negatives of five event types, of which a user's last three and the event's own are taken: all that are free."""
    events = table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("item"), F.col("event_id").alias("ts"))
    found = M.negative_samples(events, rate=4, memory=3)
    return events.join(found, ["user", "item", "ts"], "left").groupBy("ts").agg(F.count_distinct("negative").alias("n"), F.count_if(F.col("negative") == F.col("item")).alias("own"))


def user_memory(spark, d):
    events = table(spark, d, "events")
    noted = K.recent_items(events, user="user_id", item="event_type", order="event_id", memory=3)
    return noted.select("event_id", F.array_join("recent", ",").alias("recent"))


# --- Top-K ---------------------------------------------------------------------------------------------------------------


def split(spark, d):
    """Queries: every vector whose id is divisible by 50; items: all vectors."""
    every = vectors(spark, d).select("id", "vec")
    return every.where(F.col("id") % 50 == 0), every


def top(strategy):
    def run(spark, d):
        queries, items = split(spark, d)
        return K.top_items(queries, items, k=10, strategy=strategy, bucket=100)

    return run


def top_unknown(spark, d):
    """Events ask for their user's vector; users without one get an empty list."""
    queries, items = split(spark, d)
    asked = table(spark, d, "customer").where(F.col("c_custkey") % 50 == 0).select(F.col("c_custkey").alias("id")).join(items, "id", "left")
    lists = K.top_items(asked, items, k=3, strategy="length")
    return asked.select(F.col("id").alias("query")).join(lists, "query", "left").groupBy("query").agg(F.count("item").alias("n"), F.coalesce(F.sum("item"), F.lit(0)).alias("items"))


def top_memory(spark, d):
    """Queries leave out the vectors of their own label among the ten ids before them."""
    queries, items = split(spark, d)
    labels = vectors(spark, d).where("label IS NOT NULL").select("id", "label")
    before = labels.where(F.col("id") % 50 == 0).select("id", "label", F.explode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.col("id") - i)).alias("other"))
    own = before.join(labels.withColumnsRenamed({"id": "other"}), ["other", "label"]).groupBy("id").agg(F.collect_list("other").alias("skip"))
    return K.top_items(queries.join(own, "id", "left"), items, k=5, strategy="coord")


def vector_lengths(spark, d):
    return vectors(spark, d).select("id", F.round(attach_length(F.col("vec"))["len"], 6).alias("len"))


# --- Prequential recommendation and ranking quality ------------------------------------------------------------------------


def implicit(spark, d):
    """(event, user, item, rating, ts): the parts of each order as implicit feedback; an order and a part make an event's number."""
    bought = table(spark, d, "orders").join(table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey"))
    event, day = F.col("l_orderkey").cast("long") * (1 << 32) + F.col("l_partkey"), F.floor(F.unix_timestamp("o_orderdate") / 86_400).cast("long")
    return bought.select(event.alias("event"), F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.lit(1.0).alias("rating"), day.alias("ts"))


def prequential(spark, d):
    lists, _ = M.prequential(implicit(spark, d), size=SIZE, rate=0.4, k=10, batches=3, low=0.0, high=0.1, memory=4)
    return lists


def prequential_negatives(spark, d):
    lists, _ = M.prequential(implicit(spark, d), size=SIZE, rate=0.4, k=5, batches=2, low=0.0, high=0.1, memory=4, negatives=2)
    return lists


def popular(spark, d):
    """(user, rank, item): the most frequent training items that a user has not had."""
    return E.popular_items(implicit(spark, d).where("ts < 9500"), k=5)


def popular_lists(spark, d):
    """(query, rank, item): the ten most frequent items, for every event."""
    from pyspark.sql import Window

    rated = implicit(spark, d)
    counts = rated.groupBy("item").agg(F.count("*").alias("n"))
    most = counts.orderBy(F.desc("n"), "item").limit(10)
    best = most.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "item")))  # of ten rows
    return rated, rated.select(F.col("event").alias("query")).crossJoin(F.broadcast(best.select("rank", "item")))


def ndcg_total(spark, d):
    rated, lists = popular_lists(spark, d)
    return E.ndcg_total(E.gains(lists, rated))


def ndcg_by_period(spark, d):
    rated, lists = popular_lists(spark, d)
    return E.ndcg_by_period(E.gains(lists, rated), 100)


def ndcg_stream(spark, d):
    """The same events as a stream with their lists: nDCG of the periods that have closed."""
    rated = implicit(spark, d)
    most = rated.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(10).collect()
    lists = F.array(*(F.lit(r["item"]) for r in most)) if most else F.array().cast("array<bigint>")
    events = M.materialize(rated.select("ts", "item", lists.alias("recommended")), "events")
    stream = spark.readStream.schema(events.schema).parquet(events._shared_path)
    return measured(stream, folder(spark, "periods"), folder(spark, "stream"), period=100, late="50 seconds")


def precision_recall(spark, d):
    rated = implicit(spark, d)
    return E.precision_recall(E.popular_items(rated.where("ts < 9500"), k=5), rated.where("ts >= 9500"), 5)


def rmse(spark, d):
    rated = ratings(spark, d)
    means = rated.groupBy("item").agg(F.avg("rating").alias("predicted"))
    return E.rmse(rated.join(means, "item"))


# --- Passive-aggressive classification --------------------------------------------------------------------------------------


def sparse(spark, d):
    """(features, labels): hashed words of labelled documents, -1 or 1 by quality."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("vec"), (2.0 * F.col("quality") - 1).alias("label"))
    words = worded(spark, d).join(labels.select(F.col("vec").alias("doc_id")), "doc_id", "left_semi")
    exploded = words.select(F.col("doc_id").alias("vec"), F.explode("words").alias("word"))
    hashed = exploded.select("vec", F.pmod(portable(F.col("word"), 0), F.lit(FEATURES)).cast("int").alias("feature"))
    return M.materialize(hashed.groupBy("vec", "feature").agg(F.log1p(F.count("*").cast("double")).alias("x")), "features"), labels


def pa_step(variant):
    def run(spark, d):
        features, labels = sparse(spark, d)
        w = PA.zero_weights(features)
        for _ in range(2):
            w = PA.binary_round(features, labels, w, variant=variant, c=0.01)
        return w.select("feature", F.round(F.col("w"), 6).alias("w"))

    return run


def pa_offline(spark, d):
    """Five rounds, then the confusion counts on the training documents."""
    features, labels = sparse(spark, d)
    w = PA.train_binary(features, labels, rounds=5, variant="PA", how="mean")
    answers = PA.binary_predict(features, w).join(labels.select("vec", (F.col("label") > 0).alias("label")), "vec")
    return E.confusion(answers)


def pa_predict(spark, d):
    """Margins under a fixed model: a feature's weight is its number's parity."""
    features, _ = sparse(spark, d)
    model = features.select("feature").distinct().withColumn("w", F.when(F.col("feature") % 2 == 0, 1.0).otherwise(-1.0))
    answers = PA.binary_predict(features, model).select("vec", (F.round("margin", 6) + 0.0).alias("margin"))
    return answers.withColumn("predicted", F.col("margin") > 0)  # of the rounded margin, as sums differ in their last bits


def pa_stream(spark, d):
    features, labels = sparse(spark, d)
    mixed = labels.select("vec", F.col("vec").alias("seq"), F.when(F.col("vec") % 5 != 0, F.col("label")).alias("label"))
    return PA.train_and_predict(mixed, features, batches=3).select("vec", "predicted", "batch")


def dense(spark, d):
    v = vectors(spark, d)
    return M.materialize(v.select(F.col("id").alias("vec"), F.posexplode("vec").alias("feature", "x")), "features"), v.select(F.col("id").alias("vec"), "label")


COST = [[abs(a - b) / 2 for b in range(CLASSES)] for a in range(CLASSES)]


def multi_step(method, variant="PA"):
    def run(spark, d):
        features, labels = dense(spark, d)
        w = PA.zero_weights(features, CLASSES)
        for _ in range(2):
            if method == "OVA":
                w = PA.ova_round(features, labels, w, classes=CLASSES, variant=variant, c=0.5)
            else:
                w = PA.cost_round(features, labels, w, classes=CLASSES, cost=COST, method=method)
        return w.select("feature", F.posexplode("w").alias("class", "w")).withColumn("w", F.round("w", 6) + 0.0)

    return run


def multi_predict(spark, d):
    """Classes under a fixed model: a class weighs every tenth feature."""
    features, _ = dense(spark, d)
    model = features.select("feature").distinct().withColumn("w", F.array(*(F.when(F.col("feature") % CLASSES == k, 1.0).otherwise(0.0) for k in range(CLASSES))))
    return PA.multi_predict(features, model, CLASSES)


def multi_accuracy(spark, d):
    return E.accuracy(multi_predict(spark, d).join(dense(spark, d)[1], "vec"))


def binary_accuracy(spark, d):
    return E.confusion(pa_predict(spark, d).join(sparse(spark, d)[1].select("vec", (F.col("label") > 0).alias("label")), "vec"))


def multi_stream(method):
    def run(spark, d):
        features, labels = dense(spark, d)
        mixed = labels.select("vec", F.col("vec").alias("seq"), F.when(F.col("vec") % 5 != 0, F.col("label")).alias("label"))
        cost = COST if method != "OVA" else None
        return PA.train_and_predict(mixed, features, batches=3, classes=CLASSES, method=method, cost=cost).select("vec", "predicted", "batch")

    return run


def merged_top(spark, d):
    """Lists of the best five of each label's vectors, merged into one of seven for each query."""
    queries, _ = split(spark, d)
    parts = None
    for label in range(CLASSES):
        found = K.top_items(queries, vectors(spark, d).where(F.col("label") == label).select("id", "vec"), k=5, strategy="length")
        parts = found if parts is None else parts.unionByName(found)
    return K.merge_top(parts.select("query", "item", "score"), 7).select("query", "rank", "item", "score")


def multi_offline(spark, d):
    features, labels = dense(spark, d)
    w = PA.train_multi(features, labels, classes=CLASSES, rounds=5, method="OVA")
    return E.accuracy(PA.multi_predict(features, w, CLASSES).join(labels, "vec"))


QUERIES = {
    "mf_ratings": ratings,
    "mf_init": mf_init,
    "mf_sgd_step": mf_step("squared"),
    "mf_sgd_step_sigmoid": mf_step("sigmoid"),
    "mf_epoch_bsp": mf_epoch,
    "mf_offline_rmse": mf_offline,
    "mf_stratum": mf_stratum,
    "mf_offline_negatives": mf_offline_negatives,
    "mf_online": mf_online,
    "mf_prequential_topk": prequential,
    "mf_online_negatives": mf_online_negatives,
    "mf_prequential_negatives": prequential_negatives,
    "negative_samples": negatives,
    "negative_samples_exhausted": negatives_of_few,
    "topk_merged": merged_top,
    "pa_multi_predict": multi_predict,
    "pa_multi_accuracy": multi_accuracy,
    "pa_binary_accuracy": binary_accuracy,
    "pa_multi_train_and_predict": multi_stream("OVA"),
    "pa_cost_train_and_predict": multi_stream("ML"),
    "user_memory": user_memory,
    "vector_lengths": vector_lengths,
    "topk_length": top("length"),
    "topk_coord": top("coord"),
    "topk_incr": top("incr:5"),
    "topk_lc": top("lc:1.2"),
    "topk_li": top("li:5:2.5"),
    "topk_unknown_user": top_unknown,
    "topk_memory_exclusion": top_memory,
    "ndcg_total": ndcg_total,
    "ndcg_by_period": ndcg_by_period,
    "ndcg_stream": ndcg_stream,
    "popular_items": popular,
    "precision_recall_at_5": precision_recall,
    "rmse": rmse,
    "pa_binary_pa": pa_step("PA"),
    "pa_binary_pa1": pa_step("PA-I"),
    "pa_binary_pa2": pa_step("PA-II"),
    "pa_binary_offline": pa_offline,
    "pa_binary_predict": pa_predict,
    "pa_train_and_predict": pa_stream,
    "pa_ova": multi_step("OVA"),
    "pa_ova_pa1": multi_step("OVA", "PA-I"),
    "pa_ova_pa2": multi_step("OVA", "PA-II"),
    "pa_cost_pb": multi_step("PB"),
    "pa_cost_ml": multi_step("ML"),
    "pa_multi_offline": multi_offline,
}

# --- SQL -----------------------------------------------------------------------------------------------------------------


def _init(side: str, seed: int) -> str:
    value = f"{LOW} + {hash_sql(f'id || chr(58) || {seed}', 'k')} / {float(16**15)}::DOUBLE * {HIGH - LOW}"
    return f"(SELECT id, CAST(k AS INTEGER) AS k, {value} AS v FROM (SELECT DISTINCT {side} AS id FROM r), unnest(range(0, {SIZE})) AS u(k))"


_START = f"WITH {RATINGS_SQL}, u0 AS {_init('\"user\"', 0)}, i0 AS {_init('item', 1)}"


def _round(n: int, loss: str = "squared") -> str:
    """CTEs of round ``n``: the errors, and the factors after it."""
    e = "rating - p" if loss == "squared" else "1 / (1 + exp(-(rating - p)))"
    side = lambda s, mine, other, key, okey: f"""{s}{n + 1} AS (SELECT a.id, a.k, a.v + coalesce(d, 0) AS v FROM {s}{n} a LEFT JOIN (
      SELECT e.{key} AS id, o.k, avg({RATE} * e.e * o.v) AS d FROM e{n} e JOIN {other}{n} o ON o.id = e.{okey} GROUP BY 1, 2) USING (id, k))"""  # noqa: E731
    return f"""e{n} AS (SELECT "user", item, {e} AS e FROM (SELECT r."user", r.item, rating, sum(u.v * i.v) AS p FROM r JOIN u{n} u ON u.id = r."user" JOIN i{n} i ON i.id = r.item AND i.k = u.k GROUP BY ALL)),
      {side("u", "u", "i", '"user"', "item")}, {side("i", "i", "u", "item", '"user"')}"""


def _tall(n: int) -> str:
    return f"SELECT 'user' AS side, id, k, round(v, 6) + 0.0::DOUBLE AS v FROM u{n} UNION ALL SELECT 'item', id, k, round(v, 6) + 0.0::DOUBLE FROM i{n}"


def _step(loss: str) -> str:
    return f"""{_START}, {_round(0, loss)} SELECT e."user", e.item, round({RATE} * e.e * i.v, 6) + 0.0::DOUBLE AS du0, round({RATE} * e.e * u.v, 6) + 0.0::DOUBLE AS di_last
      FROM e0 e JOIN i0 i ON i.id = e.item AND i.k = 0 JOIN u0 u ON u.id = e."user" AND u.k = {SIZE - 1}"""


_SCORES = "SELECT q.vec_id AS query, x.vec_id AS item, round(list_dot_product(q.embedding::DOUBLE[], x.embedding::DOUBLE[]), 6) AS score FROM embeddings q CROSS JOIN embeddings x"


def _best(sql: str, k: int) -> str:
    return f"SELECT query, rank, item, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS INTEGER) AS rank FROM ({sql})) WHERE rank <= {k}"


_TOP = _best(f"{_SCORES} WHERE q.vec_id % 50 = 0", 10)
_IMPLICIT = """r AS (SELECT CAST(l_orderkey AS BIGINT) * 4294967296 + l_partkey AS event, o_custkey AS "user", l_partkey AS item, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS ts
  FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON o_orderkey = l_orderkey)"""
_GAINS = f"""WITH {_IMPLICIT}, best AS (SELECT item, row_number() OVER (ORDER BY n DESC, item) AS rank FROM (SELECT item, count(*) AS n FROM r GROUP BY 1) QUALIFY rank <= 10),
  g AS (SELECT ts, CASE WHEN rank IS NULL THEN 0 ELSE ln(2) / ln(1.0::DOUBLE + rank) END AS ndcg FROM r LEFT JOIN best USING (item))"""
_POPULAR = f"""WITH {_IMPLICIT}, train AS (SELECT * FROM r WHERE ts < 9500), n AS (SELECT item, count(*) AS n FROM train GROUP BY 1 HAVING count(*) > 5),
  p AS (SELECT u."user", n.item, row_number() OVER (PARTITION BY u."user" ORDER BY n DESC, n.item) AS rank FROM (SELECT DISTINCT "user" FROM train) u CROSS JOIN n
    WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t."user" = u."user" AND t.item = n.item)),
  l AS (SELECT "user", CAST(rank AS INTEGER) AS rank, item FROM p WHERE rank <= 5)"""
_SPARSE = f"""WITH {WORDED_SQL}, y AS (SELECT doc_id AS vec, 2.0::DOUBLE * quality - 1 AS label FROM labels),
  f AS (SELECT vec, feature, ln(1.0::DOUBLE + count(*)) AS x FROM (SELECT doc_id AS vec, CAST({hash_sql('word', '0')} % {FEATURES} AS INTEGER) AS feature
    FROM (SELECT doc_id, unnest(words) AS word FROM w WHERE doc_id IN (SELECT vec FROM y))) GROUP BY 1, 2)"""


def _rate(variant: str, loss: str, norm: str, c: float) -> str:
    return {"PA": f"{loss} / {norm}", "PA-I": f"least({c}, {loss} / {norm})", "PA-II": f"{loss} / ({norm} + {1 / (2 * c)})"}[variant]


def _pa(variant: str, c: float = 0.01) -> str:
    parts = ["w0 AS (SELECT DISTINCT feature, 0.0::DOUBLE AS w FROM f)"]
    for n in range(2):
        parts.append(f"""m{n} AS (SELECT vec, label, sum(x * w) AS m, sum(x * x) AS n FROM f JOIN y USING (vec) JOIN w{n} USING (feature) GROUP BY 1, 2),
          t{n} AS (SELECT vec, {_rate(variant, "greatest(0.0::DOUBLE, 1 - label * m)", "n", c)} * label AS t FROM m{n}),
          w{n + 1} AS (SELECT feature, w + coalesce(d, 0) AS w FROM w{n} LEFT JOIN (SELECT feature, avg(t * x) AS d FROM f JOIN t{n} USING (vec) GROUP BY 1) USING (feature))""")
    return f"{_SPARSE}, {', '.join(parts)} SELECT feature, round(w, 6) AS w FROM w2"


_DENSE = "WITH f AS (SELECT vec_id AS vec, CAST(i - 1 AS INTEGER) AS feature, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) AS u(i)), y AS (SELECT vec_id AS vec, label FROM embeddings)"


def _multi(tau: str) -> str:
    """``tau``: SQL of (vec, class, t) from s{n} (vec, class, s, n, label)."""
    parts = [f"w0 AS (SELECT DISTINCT feature, CAST(c AS INTEGER) AS class, 0.0::DOUBLE AS w FROM f, unnest(range(0, {CLASSES})) AS u(c))"]
    for n in range(2):
        parts.append(f"""s{n} AS (SELECT vec, class, label, sum(x * w) AS s, sum(x * x) AS n FROM f JOIN w{n} USING (feature) JOIN y USING (vec) GROUP BY 1, 2, 3),
          t{n} AS ({tau.format(n=n)}),
          w{n + 1} AS (SELECT feature, class, w + coalesce(d, 0) AS w FROM w{n} LEFT JOIN (SELECT feature, class, avg(t * x) AS d FROM f JOIN t{n} USING (vec) GROUP BY 1, 2) USING (feature, class))""")
    return f"{_DENSE}, {', '.join(parts)} SELECT feature, class, round(w, 6) + 0.0::DOUBLE AS w FROM w2"


def _ova(variant: str) -> str:
    y = "(CASE WHEN label = class THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
    return _multi(f"SELECT vec, class, {_rate(variant, f'greatest(0.0::DOUBLE, 1 - {y} * s)', 'n', 0.5)} * {y} AS t FROM s{{n}}")


def _cost_tau(method: str) -> str:
    root = "sqrt(abs({a} - {b}) / 2.0::DOUBLE)"
    own = root.format(a="label", b="class")
    order = f"s + {own}" if method == "ML" else "s"
    return f"""SELECT a.vec, a.class, CASE WHEN r.rival = a.label THEN 0 ELSE (r.s - m.s + sqrt(abs(a.label - r.rival) / 2.0::DOUBLE)) / (2 * a.n) END
        * (CASE WHEN a.class = a.label THEN 1.0::DOUBLE WHEN a.class = r.rival THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END) AS t
      FROM s{{n}} a JOIN s{{n}} m ON m.vec = a.vec AND m.class = m.label
      JOIN (SELECT vec, class AS rival, s FROM s{{n}} QUALIFY row_number() OVER (PARTITION BY vec ORDER BY {order} DESC, class) = 1) r ON r.vec = a.vec"""


def _cost(method: str) -> str:
    return _multi(_cost_tau(method))


def _negatives(source: str, rate: int, memory: int, name: str = "ng") -> str:
    """CTE of negatives (user, item, ts, negative) of the ratings ``source``: the walk over all items, no matter how long it must be."""
    return f"""it AS MATERIALIZED (SELECT item, row_number() OVER (ORDER BY {hash_sql('item', '0')}, item) - 1 AS number FROM (SELECT DISTINCT item FROM {source})),
  st AS MATERIALIZED (SELECT "user", item, ts, row_number() OVER () AS row, list(item) OVER (PARTITION BY "user" ORDER BY ts, item ROWS BETWEEN {memory} PRECEDING AND CURRENT ROW) AS recent,
    {hash_sql('"user" || chr(124) || item || chr(124) || ts || chr(124) || 0', '0')} % (SELECT count(*) FROM it) AS start FROM {source}),
  wk AS (SELECT "user", st.item, ts, it.item AS negative, row_number() OVER (PARTITION BY row ORDER BY j) AS k
    FROM (SELECT *, (start + j) % (SELECT count(*) FROM it) AS number FROM st, unnest(range(0, least({rate + memory + 1}, (SELECT count(*) FROM it)))) AS u(j)) st JOIN it USING (number) WHERE NOT list_contains(recent, it.item)),
  {name} AS MATERIALIZED (SELECT "user", item, ts, negative FROM wk WHERE k <= {rate})"""


_NEG = f'WITH {RATINGS_SQL}, {_negatives("r", 2, 4)} SELECT "user", item, ts, negative FROM ng'


def _factors(source: str, size: int, low: float, high: float) -> str:
    """CTEs u0 and i0 (id, k, v) of the ids of ``source``."""
    value = lambda seed: f"{low} + {hash_sql(f'id || chr(58) || {seed}', 'k')} / {float(16**15)}::DOUBLE * {high - low}"
    one = lambda side, seed: f"(SELECT id, CAST(k AS INTEGER) AS k, {value(seed)} AS v FROM (SELECT DISTINCT {side} AS id FROM {source}), unnest(range(0, {size})) AS u(k))"
    return f"u0 AS MATERIALIZED {one('\"user\"', 0)}, i0 AS MATERIALIZED {one('item', 1)}"


def _learn(n: int, rows: str, rate: float) -> str:
    """CTEs of round ``n`` over rows (user, item, rating), each row a step of its own."""
    side = lambda s, mine, other, key, okey: f"""{s}{n + 1} AS MATERIALIZED (SELECT a.id, a.k, a.v + coalesce(d, 0) AS v FROM {s}{n} a LEFT JOIN (
      SELECT e.{key} AS id, o.k, avg({rate} * e.e * o.v) AS d FROM e{n} e JOIN {other}{n} o ON o.id = e.{okey} GROUP BY 1, 2) USING (id, k))"""  # noqa: E731
    return f"""s{n} AS MATERIALIZED (SELECT "user", item, rating, row_number() OVER () AS row FROM ({rows})),
      e{n} AS MATERIALIZED (SELECT any_value(s."user") AS "user", any_value(item) AS item, any_value(rating) - sum(u.v * i.v) AS e FROM s{n} s JOIN u{n} u ON u.id = s."user" JOIN i{n} i ON i.id = s.item AND i.k = u.k GROUP BY row),
      {side("u", "u", "i", '"user"', "item")}, {side("i", "i", "u", "item", '"user"')}"""


_STEPS = lambda source, n: f"(SELECT *, CAST(floor((ts - (SELECT min(ts) FROM {source})) / (((SELECT max(ts) - min(ts) FROM {source}) + 1) / {n}::DOUBLE)) AS INTEGER) AS batch FROM {source})"
_RATED = 'SELECT "user", item, rating FROM r'
_RMSE = """SELECT round(sqrt(avg((p - rating) * (p - rating))), 6) AS rmse FROM (SELECT any_value(rating) AS rating, sum(u.v * i.v) AS p
  FROM r JOIN u{n} u ON u.id = r."user" JOIN i{n} i ON i.id = r.item AND i.k = u.k GROUP BY r."user", r.item)"""
_BOTH = 'b AS MATERIALIZED (SELECT "user", item, rating, ts FROM r UNION ALL SELECT "user", negative, 0.0::DOUBLE, ts FROM ng)'


def _rounds(rows: list[str], rate: float) -> str:
    return ", ".join(_learn(n, x, rate) for n, x in enumerate(rows))


def _in_time(source: str, batches: int) -> list[str]:
    return [f'SELECT "user", item, rating FROM {_STEPS(source, batches)} WHERE batch = {n}' for n in range(batches)]


def _prequential(k: int, batches: int, memory: int, negatives: int) -> str:
    """Lists from the factors before each batch: known users and items, without the user's last ``memory`` items."""
    head = f"WITH {_IMPLICIT.replace('r AS (', 'p AS (', 1)}, r AS (SELECT *, 1.0::DOUBLE AS rating FROM p)"
    parts = [head, f"""m AS MATERIALIZED (SELECT *, coalesce(list(item) OVER (PARTITION BY "user" ORDER BY event ROWS BETWEEN {memory} PRECEDING AND 1 PRECEDING), []) AS recent FROM {_STEPS('r', batches)})""", _factors("r", SIZE, 0.0, 0.1)]
    rows = _in_time("r", batches)
    if negatives:
        parts += [_negatives("r", negatives, memory), _BOTH]
        rows = _in_time("b", batches)
    parts.append(_rounds(rows[:-1], 0.4))
    for n in range(1, batches):
        parts.append(f"""d{n} AS (SELECT m.event AS query, i.id AS item, round(sum(u.v * i.v), 6) + 0.0::DOUBLE AS score FROM m JOIN u{n} u ON u.id = m."user" JOIN i{n} i ON i.k = u.k
          WHERE m.batch = {n} AND m."user" IN (SELECT "user" FROM m WHERE batch < {n}) AND i.id IN (SELECT item FROM m WHERE batch < {n}) AND NOT list_contains(m.recent, i.id) GROUP BY 1, 2),
          l{n} AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS INTEGER) AS rank, item, score FROM d{n} QUALIFY rank <= {k})""")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM l{n}" for n in range(1, batches))


def _pa_rounds(rows: list[str], variant: str = "PA", c: float = 1.0) -> str:
    """CTEs w0, w1, … of rounds over labelled examples (vec, label)."""
    parts = ["w0 AS MATERIALIZED (SELECT DISTINCT feature, 0.0::DOUBLE AS w FROM f)"]
    for n, x in enumerate(rows):
        parts.append(f"""m{n} AS MATERIALIZED (SELECT vec, label, sum(x * w) AS m, sum(x * x) AS n FROM f JOIN ({x}) USING (vec) JOIN w{n} USING (feature) GROUP BY 1, 2),
          t{n} AS MATERIALIZED (SELECT vec, {_rate(variant, "greatest(0.0::DOUBLE, 1 - label * m)", "n", c)} * label AS t FROM m{n}),
          w{n + 1} AS MATERIALIZED (SELECT feature, w + coalesce(d, 0) AS w FROM w{n} LEFT JOIN (SELECT feature, avg(t * x) AS d FROM f JOIN t{n} USING (vec) GROUP BY 1) USING (feature))""")
    return ", ".join(parts)


def _multi_rounds(rows: list[str], method: str = "OVA") -> str:
    """The same for several classes."""
    parts = [f"w0 AS MATERIALIZED (SELECT DISTINCT feature, CAST(c AS INTEGER) AS class, 0.0::DOUBLE AS w FROM f, unnest(range(0, {CLASSES})) AS u(c))"]
    y = "(CASE WHEN label = class THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
    for n, x in enumerate(rows):
        tau = f"SELECT vec, class, greatest(0.0::DOUBLE, 1 - {y} * s) / n * {y} AS t FROM s{n}" if method == "OVA" else _cost_tau(method).format(n=n)
        parts.append(f"""s{n} AS MATERIALIZED (SELECT vec, class, label, sum(x * w) AS s, sum(x * x) AS n FROM f JOIN w{n} USING (feature) JOIN ({x}) USING (vec) GROUP BY 1, 2, 3),
          t{n} AS MATERIALIZED ({tau}),
          w{n + 1} AS MATERIALIZED (SELECT feature, class, w + coalesce(d, 0) AS w FROM w{n} LEFT JOIN (SELECT feature, class, avg(t * x) AS d FROM f JOIN t{n} USING (vec) GROUP BY 1, 2) USING (feature, class))""")
    return ", ".join(parts)


_CONFUSION = """SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn,
  round(100 * avg(CAST(y = p AS INTEGER)), 6) AS accuracy FROM"""
_MIXED = "mx AS MATERIALIZED (SELECT vec, label, vec % 5 = 0 AS asked, CAST(floor((row_number() OVER (ORDER BY vec) - 1) * 3 / (SELECT count(*) FROM y)::DOUBLE) AS INTEGER) AS batch FROM y)"
_TAUGHT = [f"SELECT vec, label FROM mx WHERE batch = {b} AND NOT asked" for b in range(2)]
_CLASS = lambda w, rows: f"SELECT vec, class AS predicted FROM (SELECT vec, class, sum(x * w) AS s FROM f JOIN {w} USING (feature) WHERE vec IN ({rows}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY vec ORDER BY s DESC, class) = 1"
_ASKED = lambda b: f"SELECT vec FROM mx WHERE batch = {b} AND asked"


def _multi_stream(method: str) -> str:
    answers = " UNION ALL ".join(f"SELECT *, CAST({b} AS INTEGER) AS batch FROM ({_CLASS(f'w{b}', _ASKED(b))})" for b in range(3))
    return f"{_DENSE}, {_MIXED}, {_multi_rounds(_TAUGHT, method)} {answers}"


# One stratum, step by step: in step n each pair of blocks takes its n-th rating.
_BLOCK = lambda id, seed: f"CAST({hash_sql(id, str(seed))} % {STRATA} AS INTEGER)"
_STRATUM = f"""WITH RECURSIVE {RATINGS_SQL}, u0 AS {_init('"user"', 0)}, i0 AS {_init('item', 1)},
  p AS (SELECT "user", item, rating, {_BLOCK('"user"', 0)} AS blk, {_BLOCK('item', 1)} AS iblk, {hash_sql('"user" || chr(124) || item', '0')} AS h FROM r),
  q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY blk ORDER BY h, "user", item) AS n FROM p WHERE (iblk - blk + {STRATA}) % {STRATA} = 3),
  st AS (
    SELECT 0 AS step, side, id, v FROM (SELECT 'user' AS side, id, list(v ORDER BY k) AS v FROM u0 GROUP BY id UNION ALL SELECT 'item', id, list(v ORDER BY k) FROM i0 GROUP BY id)
    UNION ALL
    SELECT step + 1, side, id, CASE WHEN rating IS NULL THEN v ELSE
        list_transform(list_zip(v, other), lambda z: z[1] + {RATE} * (rating - list_dot_product(v, other)) * z[2]) END
    FROM (SELECT st.step, st.side, st.id, st.v, q.rating,
        CASE WHEN side = 'user' THEN any_value(v) FILTER (side = 'item') OVER w ELSE any_value(v) FILTER (side = 'user') OVER w END AS other
      FROM st LEFT JOIN q ON q.n = st.step + 1 AND st.id = CASE WHEN st.side = 'user' THEN q."user" ELSE q.item END
      WINDOW w AS (PARTITION BY coalesce(q.blk, -1)))
    WHERE step < (SELECT max(n) FROM q))
  SELECT side, id, CAST(k - 1 AS INTEGER) AS k, round(v[k], 6) + 0.0::DOUBLE AS v FROM st, unnest(range(1, {SIZE + 1})) AS x(k) WHERE step = (SELECT max(n) FROM q)"""

ORACLE_SQL = {
    "mf_stratum": _STRATUM,
    "mf_ratings": f"WITH {RATINGS_SQL} SELECT * FROM r",
    "mf_init": f"{_START} {_tall(0)}",
    "mf_sgd_step": _step("squared"),
    "mf_sgd_step_sigmoid": _step("sigmoid"),
    "mf_epoch_bsp": f"{_START}, {_round(0)}, {_round(1)} {_tall(2)}",
    "mf_offline_rmse": f"WITH {RATINGS_SQL}, {_factors('r', 10, 0.0, 0.4)}, {_rounds([_RATED] * 6, 0.5)} {_RMSE.format(n=6)}",
    "mf_offline_negatives": f"WITH {RATINGS_SQL}, {_negatives('r', 2, 8)}, {_BOTH}, {_factors('r', SIZE, 0.0, 0.4)}, {_rounds(['SELECT \"user\", item, rating FROM b'] * 2, 0.3)} {_RMSE.format(n=2)}",
    "mf_online": f"WITH {RATINGS_SQL}, {_factors('r', SIZE, 0.0, 0.4)}, {_rounds(_in_time('r', 6), 0.5)} {_tall(6)}",
    "mf_online_negatives": f"WITH {RATINGS_SQL}, {_negatives('r', 2, 4)}, {_BOTH}, {_factors('r', SIZE, 0.0, 0.4)}, {_rounds(_in_time('b', 3), 0.5)} {_tall(3)}",
    "mf_prequential_topk": _prequential(10, 3, 4, 0),
    "mf_prequential_negatives": _prequential(5, 2, 4, 2),
    "negative_samples": _NEG,
    "negative_samples_exhausted": """SELECT event_id AS ts, least(4, 5 - len(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id, event_type ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)))) AS n,
        CAST(0 AS BIGINT) AS own FROM events""",
    "topk_merged": _best(f"SELECT query, item, score FROM (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, item) AS place FROM ({_SCORES.replace('AS score FROM', 'AS score, x.label AS label FROM')} WHERE q.vec_id % 50 = 0)) WHERE place <= 5", 7),
    "pa_binary_offline": f"{_SPARSE}, {_pa_rounds(['SELECT vec, label FROM y'] * 5)} {_CONFUSION} (SELECT vec, label > 0 AS y, sum(x * w) > 0 AS p FROM f JOIN y USING (vec) JOIN w5 USING (feature) GROUP BY vec, label)",
    "pa_train_and_predict": f"{_SPARSE}, {_MIXED}, {_pa_rounds(_TAUGHT)} " + " UNION ALL ".join(f"SELECT vec, sum(x * w) > 0 AS predicted, CAST({b} AS INTEGER) AS batch FROM f JOIN w{b} USING (feature) WHERE vec IN ({_ASKED(b)}) GROUP BY vec" for b in range(3)),
    "pa_multi_offline": f"{_DENSE}, {_multi_rounds(['SELECT vec, label FROM y'] * 5)} SELECT count(*) AS n, round(100 * avg(CAST(label = predicted AS INTEGER)), 6) AS accuracy FROM ({_CLASS('w5', 'SELECT vec FROM y')}) JOIN y USING (vec)",
    "pa_multi_train_and_predict": _multi_stream("OVA"),
    "pa_cost_train_and_predict": _multi_stream("ML"),
    "pa_multi_predict": f"{_DENSE}, w AS (SELECT feature, CAST(c AS INTEGER) AS class, CAST(feature % {CLASSES} = c AS INTEGER)::DOUBLE AS w FROM (SELECT DISTINCT feature FROM f), unnest(range(0, {CLASSES})) AS u(c)) {_CLASS('w', 'SELECT vec FROM y')}",
    "pa_multi_accuracy": f"{_DENSE}, w AS (SELECT feature, CAST(c AS INTEGER) AS class, CAST(feature % {CLASSES} = c AS INTEGER)::DOUBLE AS w FROM (SELECT DISTINCT feature FROM f), unnest(range(0, {CLASSES})) AS u(c)) SELECT count(*) AS n, round(100 * avg(CAST(label = predicted AS INTEGER)), 6) AS accuracy FROM ({_CLASS('w', 'SELECT vec FROM y')}) JOIN y USING (vec)",
    "pa_binary_accuracy": f"{_SPARSE} {_CONFUSION} (SELECT vec, label > 0 AS y, round(sum(x * (CASE WHEN feature % 2 = 0 THEN 1 ELSE -1 END)), 6) > 0 AS p FROM f JOIN y USING (vec) GROUP BY vec, label)",
    "user_memory": """SELECT event_id, coalesce(array_to_string(list_sort(list_distinct(list(event_type) OVER w)), ','), '') AS recent FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
    "vector_lengths": "SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS len FROM embeddings",
    **{f"topk_{k}": _TOP for k in ("length", "coord", "incr", "lc", "li")},
    "topk_unknown_user": f"""WITH q AS (SELECT c_custkey AS query FROM customer WHERE c_custkey % 50 = 0), l AS ({_best(_SCORES, 3)})
        SELECT query, count(item) AS n, CAST(coalesce(sum(item), 0) AS BIGINT) AS items FROM q LEFT JOIN l USING (query) GROUP BY 1""",
    "topk_memory_exclusion": _best(f"{_SCORES} WHERE q.vec_id % 50 = 0 AND NOT coalesce(x.label = q.label AND x.vec_id BETWEEN q.vec_id - 10 AND q.vec_id - 1, false)", 5),
    "ndcg_total": f"{_GAINS} SELECT count(*) AS n, count(*) FILTER (ndcg > 0) AS hits, round(sum(ndcg), 6) AS ndcg_sum, round(avg(ndcg), 6) AS ndcg_avg FROM g",
    "ndcg_by_period": f"{_GAINS} SELECT ts // 100 AS period, count(*) AS n, count(*) FILTER (ndcg > 0) AS hits, round(avg(ndcg), 6) AS ndcg_avg FROM g GROUP BY 1",
    "ndcg_stream": f"""{_GAINS} SELECT ts // 100 AS period, count(*) AS n, count(*) FILTER (ndcg > 0) AS hits, round(sum(ndcg), 6) AS ndcg_sum, round(avg(ndcg), 6) AS ndcg_avg
      FROM g GROUP BY 1 HAVING (period + 1) * 100 <= (SELECT max(ts) - 50 FROM g)""",
    "popular_items": f"{_POPULAR} SELECT * FROM l",
    "precision_recall_at_5": f"""{_POPULAR}, t AS (SELECT DISTINCT "user", item FROM r WHERE ts >= 9500),
        h AS (SELECT t."user", count(*) AS n, count(l.item) AS hits FROM t LEFT JOIN l ON l."user" = t."user" AND l.item = t.item GROUP BY 1)
        SELECT count(*) AS users, round(avg(hits / 5.0::DOUBLE), 6) AS precision, round(avg(hits / n::DOUBLE), 6) AS recall FROM h""",
    "rmse": f"WITH {RATINGS_SQL} SELECT round(sqrt(avg((m - rating) * (m - rating))), 6) AS rmse FROM (SELECT rating, avg(rating) OVER (PARTITION BY item) AS m FROM r)",
    "pa_binary_pa": _pa("PA"),
    "pa_binary_pa1": _pa("PA-I"),
    "pa_binary_pa2": _pa("PA-II"),
    "pa_binary_predict": f"""{_SPARSE} SELECT vec, margin, margin > 0 AS predicted FROM (
        SELECT vec, round(sum(x * (CASE WHEN feature % 2 = 0 THEN 1 ELSE -1 END)), 6) + 0.0::DOUBLE AS margin FROM f GROUP BY 1)""",
    "pa_ova": _ova("PA"),
    "pa_ova_pa1": _ova("PA-I"),
    "pa_ova_pa2": _ova("PA-II"),
    "pa_cost_pb": _cost("PB"),
    "pa_cost_ml": _cost("ML"),
}
