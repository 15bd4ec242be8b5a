"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text give a small network that minimises the non-negative unbiased risk
``p R+(positives) + max(0, R-(unlabelled) - p R-(positives))`` with the logistic loss, ``p`` being the estimated class prior. When the
bracket turns negative (the network begins to fit single unlabelled rows as negatives) its gradient is reversed. The prior is the
share of label 1 among the labelled training rows if both labels occur, else Elkan and Noto's estimate from the fitted scores.

Inputs of a score are measures of the text alone. Fitting uses at most about ``SAMPLE`` labelled and ``SAMPLE`` unlabelled training
rows, drawn by a hash of the id (a documented bound); only their measures reach the driver. Scoring reads every whole text once,
row by row, and shuffles nothing.

Edge cases: null and empty texts get the measures of an empty text and a score like any other; rows with a null id are scored but
never learned from; null labels are ignored, of several labels for a document the highest counts; without positives or without
unlabelled rows every score is 1, so that nothing is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_bucket, map_batches, record_batch, rewrite_batches

SAMPLE = 20_000
THRESHOLD = 0.7
HIDDEN = 24
STEPS = 1500
BATCH = 512
MARKS = b"!|%$&*#<>@_=.,?:;/\\{}[]()\"'-+~^`"
# Common function words of the four languages.
_STOP = frozenset(b"a and as at by con das de del der die du ein el en est et for from il in is ist it la las le les los mit of on or para pour que se sich sur that the this to un una und une was with y".split())
_END = (b".", b"!", b"?", b":", b'"', b")")
#: First and last words, characters and lines are seen like all others: every measure runs over the whole text.
N_FEATURES = len(MARKS) + 16


def features(raw: bytes | None) -> np.ndarray:
    raw = raw or b""
    own = raw.split()
    n, size = max(1, len(own)), max(1, len(raw))
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, wide = bytes_of[65:91].sum(), bytes_of[97:123].sum(), bytes_of[128:].sum()
    use = Counter(own)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    marked = [sum(x.count(bytes([c])) for c in b"|%$&*#!<>") / max(1, x.count(b" ") + 1) for x in lines]
    words = np.array(list(map(len, own)) or [0])
    return np.concatenate([
        np.log1p(100.0 * bytes_of[list(MARKS)] / n),
        [
            np.log1p(len(own)), np.log1p(len(raw)), words.mean(), words.std(), upper / max(1, upper + lower), bytes_of[48:58].sum() / size,
            (upper + lower + wide) / size, len(use) / n, max(use.values(), default=0) / n, sum(use[w] for w in _STOP) / n,
            1 - len(set(lines)) / m, n / m, sum(x.rstrip().endswith(_END) for x in lines) / m, max(marked, default=0.0), float(np.mean(np.array(marked or [0.0]) > 0.5)),
            sum(x.isupper() for x in lines) / m,
        ],
    ])


class Model(NamedTuple):
    """A network of one hidden layer over standardised measures. ``w1`` None: every score is 1."""

    mean: np.ndarray | None
    scale: np.ndarray | None
    w1: np.ndarray | None
    b1: np.ndarray | None
    w2: np.ndarray | None
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.ones(len(x)) if self.w1 is None else 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = STEPS, seed: int = 0, decay: float = 1e-4) -> Model:
    """Minimises the non-negative risk by Adam over mini-batches; deterministic for equal rows in equal order."""
    if not len(positive) or not len(unlabelled):
        return Model(None, None, None, None, None, 0.0, prior)
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    weights = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
    weights[2] = rng.normal(0, 0.1, HIDDEN)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), min(BATCH, 4 * len(p)))], u[rng.integers(0, len(u), BATCH)]
        x = np.concatenate([xp, xu])
        hidden = np.tanh(x @ weights[0] + weights[1])
        out = hidden @ weights[2] + weights[3][0]
        gp, gu = out[: len(xp)], out[len(xp) :]
        as_negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        up_p = -prior * sigmoid(-gp) / len(gp)  # of p R+(positives)
        down_p, down_u = -prior * sigmoid(gp) / len(gp), sigmoid(gu) / len(gu)  # of the bracket
        if as_negative < 0:
            grad = np.concatenate([-down_p, -down_u])
        else:
            grad = np.concatenate([up_p + down_p, down_u])
        back = np.outer(grad, weights[2]) * (1 - hidden**2)
        grads = [x.T @ back + decay * weights[0], back.sum(axis=0), hidden.T @ grad + decay * weights[2], np.array([grad.sum()])]
        rate = 0.01 * (1 - step / (steps + 1))
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]), prior)


def _measured(docs: DataFrame) -> DataFrame:
    """(label, x) of rows (label, text)."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(raw) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            return record_batch({"label": batch.column(0), "x": pa.array(list(found), pa.list_(pa.float64())), "order": batch.column(2)})

        return each

    return map_batches(docs.select("label", "text", "order"), make, "label int, x array<double>, order bigint")


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, steps: int = STEPS) -> Model:
    """Fits on ``docs`` and ``labels`` (label 1: trusted positive), both without held-out rows."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    ones, zeros, rows = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1), docs.count()
    if not ones or not rows:
        return fit_nnpu(np.empty((0, N_FEATURES)), np.empty((0, N_FEATURES)), 0.5)
    draw = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 24)) < int(min(1.0, sample / max(1, n)) * (1 << 24))
    trusted = F.broadcast(known.where((F.col("label") == 1) & draw(ones, "positive")))
    picked = docs.join(trusted, "doc_id", "left").withColumn("free", draw(rows, "unlabelled")).where("label IS NOT NULL OR free")
    each = F.explode(F.filter(F.array(F.col("label"), F.when(F.col("free"), F.lit(0))), lambda x: x.isNotNull()))
    found = _measured(picked.select(each.alias("label"), "text", F.xxhash64("doc_id", "text").alias("order"))).collect()
    found.sort(key=lambda r: (r["label"], r["order"], r["x"]))  # bounded by ``sample``; the order makes the fit repeatable
    positive, unlabelled = (np.array([r["x"] for r in found if r["label"] == k]).reshape(-1, N_FEATURES) for k in (1, 0))
    prior = ones / (ones + zeros)
    if not zeros and len(positive) and len(unlabelled):
        trial = fit_nnpu(positive, unlabelled, 0.5, steps=steps)
        prior = float(np.clip(trial.scores(unlabelled).mean() / max(1e-6, trial.scores(positive).mean()), 0.05, 0.95))
    return fit_nnpu(positive, unlabelled, float(np.clip(prior, 0.02, 0.98)), steps=steps)


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every text."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(raw) for raw in batch.column(1).cast(pa.binary()).to_pylist()])
            return record_batch({"doc_id": batch.column(0), "score": pa.array(model.scores(x), pa.float64())})

        return each

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(kept, make, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double")


def learn_from(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on the rows that are not held out of labels; their ids decide."""
    ours = F.coalesce(id_bucket(F.col("doc_id"), 4) != 2, F.lit(False))
    return fit(docs.where(ours), labels.where(ours))


def keep_good(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the texts that score under ``least``."""
    place = docs.columns.index(text)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(raw) for raw in batch.column(place).cast(pa.binary()).to_pylist()])
            return batch.filter(pa.array(model.scores(x) >= least))

        return each

    return rewrite_batches(docs, make)


def op3(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, learn_from(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
