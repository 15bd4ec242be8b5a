"""Passive-aggressive classification: binary, one-versus-all and cost-based, over sparse features.

Examples are long rows (vec, feature, x); labels are (vec, label). Weights are (feature, w), or (feature, w array) for several
classes. A round joins features with weights, sums margins by example, takes each example's step against the round's weights and
averages (or sums) steps by feature: two shuffles a round, nothing gathered. ``on_example`` forms in numpy state the step for one
example; the exact fold uses them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from ..plans.storage import materialize

VARIANTS = ("PA", "PA-I", "PA-II")


def rate(loss: Column, norm: Column, variant: str, c: float) -> Column:
    """Step size of an example with this loss and squared length."""
    if variant == "PA":
        return loss / norm
    if variant == "PA-I":
        return F.least(F.lit(c), loss / norm)
    if variant == "PA-II":
        return loss / (norm + F.lit(1 / (2 * c)))
    raise ValueError(f"variant is one of {VARIANTS}, not {variant!r}")


def np_rate(loss, norm, variant: str, c: float):
    """``rate`` for numbers; an example without features takes no step."""
    if norm == 0:
        return 0.0 * loss
    if variant == "PA":
        return loss / norm
    return np.minimum(c, loss / norm) if variant == "PA-I" else loss / (norm + 1 / (2 * c))


def _steps(total: str):
    return F.avg if total == "mean" else F.sum


def binary_round(features: DataFrame, labels: DataFrame, weights: DataFrame, *, variant: str = "PA", c: float = 1.0, how: str = "mean") -> DataFrame:
    """Weights (feature, w) after one round; labels are -1 or 1. Examples without features take no part."""
    met = features.join(labels, "vec").join(weights, "feature", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    examples = met.groupBy("vec", "label").agg(F.sum(F.col("x") * F.col("w")).alias("margin"), F.sum(F.col("x") * F.col("x")).alias("norm"))
    loss = F.greatest(F.lit(0.0), 1 - F.col("label") * F.col("margin"))
    taus = examples.where("norm > 0").select("vec", (rate(loss, F.col("norm"), variant, c) * F.col("label")).alias("tau"))
    deltas = features.join(taus, "vec").groupBy("feature").agg(_steps(how)(F.col("tau") * F.col("x")).alias("d"))
    return weights.join(deltas, "feature", "full").select("feature", (F.coalesce("w", F.lit(0.0)) + F.coalesce("d", F.lit(0.0))).alias("w"))


def binary_predict(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(vec, predicted): true if the margin is positive; only examples with features come out."""
    met = features.join(weights, "feature", "left")
    return met.groupBy("vec").agg(F.sum(F.col("x") * F.coalesce("w", F.lit(0.0))).alias("margin")).select("vec", "margin", (F.col("margin") > 0).alias("predicted"))


def train_binary(features: DataFrame, labels: DataFrame, *, rounds: int = 5, variant: str = "PA", c: float = 1.0, how: str = "mean", model: DataFrame | None = None) -> DataFrame:
    """Offline training over all labelled examples; ``model`` starts it."""
    weights = model if model is not None else features.select("feature").distinct().withColumn("w", F.lit(0.0))
    for _ in range(rounds):
        weights = materialize(binary_round(features, labels, weights, variant=variant, c=c, how=how), "weights")
    return weights


def _margins(features: DataFrame, weights: DataFrame, classes: int) -> DataFrame:
    met = features.join(weights, "feature", "left")
    sums = [F.sum(F.col("x") * F.coalesce(F.get("w", F.lit(k)), F.lit(0.0))).alias(f"s{k}") for k in range(classes)]
    return met.groupBy("vec").agg(F.sum(F.col("x") * F.col("x")).alias("norm"), *sums).select("vec", "norm", F.array(*(F.col(f"s{k}") for k in range(classes))).alias("s"))


def _apply(features: DataFrame, taus: DataFrame, weights: DataFrame, classes: int, how: str) -> DataFrame:
    steps = features.join(taus, "vec").groupBy("feature").agg(*(_steps(how)(F.get("tau", F.lit(k)) * F.col("x")).alias(f"d{k}") for k in range(classes)))
    new = F.array(*(F.coalesce(F.get("w", F.lit(k)), F.lit(0.0)) + F.coalesce(f"d{k}", F.lit(0.0)) for k in range(classes)))
    return weights.join(steps, "feature", "full").select("feature", new.alias("w"))


def ova_round(features: DataFrame, labels: DataFrame, weights: DataFrame, *, classes: int, variant: str = "PA", c: float = 1.0, how: str = "mean") -> DataFrame:
    """One-versus-all: each class takes a binary step, +1 for its own label and -1 else."""
    examples = _margins(features, weights, classes).join(labels, "vec").where("norm > 0")

    def tau(k: int) -> Column:
        y = F.when(F.col("label") == k, F.lit(1.0)).otherwise(F.lit(-1.0))
        return rate(F.greatest(F.lit(0.0), 1 - y * F.get("s", F.lit(k))), F.col("norm"), variant, c) * y

    taus = examples.select("vec", F.array(*(tau(k) for k in range(classes))).alias("tau"))
    return _apply(features, taus, weights, classes, how)


def cost_round(features: DataFrame, labels: DataFrame, weights: DataFrame, *, classes: int, cost: list[list[float]], method: str = "PB", how: str = "mean") -> DataFrame:
    """Cost-based steps toward the label and away from a rival: the predicted class (PB) or the class of largest loss (ML)."""
    examples = _margins(features, weights, classes).join(labels, "vec").where("norm > 0")
    roots = F.array(*(F.array(*(F.lit(math.sqrt(x)) for x in row)) for row in cost))
    own = F.get(roots, F.col("label"))
    mine = F.get("s", F.col("label"))
    ranked = [F.get("s", F.lit(k)) + (F.get(own, F.lit(k)) if method == "ML" else F.lit(0.0)) for k in range(classes)]
    rival = F.array_position(F.array(*ranked), F.array_max(F.array(*ranked))).cast("int") - 1  # the first of equal ones
    found = examples.withColumn("rival", rival)
    loss = F.get("s", F.col("rival")) - mine + F.get(own, F.col("rival"))
    tau = F.when(F.col("rival") != F.col("label"), loss / (2 * F.col("norm"))).otherwise(F.lit(0.0))
    side = lambda k: F.when(F.col("label") == k, F.lit(1.0)).when(F.col("rival") == k, F.lit(-1.0)).otherwise(F.lit(0.0))
    taus = found.withColumn("t", tau).select("vec", F.array(*(F.col("t") * side(k) for k in range(classes))).alias("tau"))
    return _apply(features, taus, weights, classes, how)


def multi_predict(features: DataFrame, weights: DataFrame, classes: int) -> DataFrame:
    """(vec, predicted): the first class of the largest margin."""
    margins = _margins(features, weights, classes)
    return margins.select("vec", (F.array_position("s", F.array_max("s")) - 1).cast("int").alias("predicted"))


def zero_weights(features: DataFrame, classes: int = 0) -> DataFrame:
    zero = F.array(*(F.lit(0.0) for _ in range(classes))) if classes else F.lit(0.0)
    return features.select("feature").distinct().withColumn("w", zero)


def multi_round(features: DataFrame, labels: DataFrame, weights: DataFrame, *, classes: int, method: str = "OVA", variant: str = "PA", c: float = 1.0, cost: list[list[float]] | None = None, how: str = "mean") -> DataFrame:
    """Weights after one round of ``method`` OVA, PB or ML; the cost of a wrong class is 1 by default."""
    if method == "OVA":
        return ova_round(features, labels, weights, classes=classes, variant=variant, c=c, how=how)
    return cost_round(features, labels, weights, classes=classes, cost=cost or [[float(a != b) for b in range(classes)] for a in range(classes)], method=method, how=how)


def train_multi(features: DataFrame, labels: DataFrame, *, classes: int, rounds: int = 5, method: str = "OVA", variant: str = "PA", c: float = 1.0, cost: list[list[float]] | None = None, how: str = "mean") -> DataFrame:
    weights = zero_weights(features, classes)
    for _ in range(rounds):
        weights = materialize(multi_round(features, labels, weights, classes=classes, method=method, variant=variant, c=c, cost=cost, how=how), "weights")
    return weights


def train_and_predict(examples: DataFrame, features: DataFrame, *, batches: int, variant: str = "PA", c: float = 1.0, classes: int = 2, method: str = "OVA", cost: list[list[float]] | None = None) -> DataFrame:
    """A mixed stream (vec, seq, label or null) in micro-batches: labelled examples train, the others get the model's answer of their time.
    Two classes: labels -1 and 1; more: 0 to ``classes`` - 1, learned by ``method``."""
    several = classes > 2
    weights, answers = zero_weights(features, classes if several else 0), None
    n = max(1, examples.count())
    cut = materialize(numbered(examples, [F.col("seq"), F.col("vec")], "place").withColumn("batch", F.floor(F.col("place") * batches / n)), "examples")
    for b in range(batches):
        now = cut.where(F.col("batch") == b)
        unlabelled = features.join(now.where("label IS NULL").select("vec"), "vec", "left_semi")
        asked = multi_predict(unlabelled, weights, classes) if several else binary_predict(unlabelled, weights)
        asked = materialize(asked.withColumn("batch", F.lit(b)), "answers")
        answers = asked if answers is None else answers.unionByName(asked)
        taught = now.where("label IS NOT NULL").select("vec", "label")
        own = features.join(taught.select("vec"), "vec", "left_semi")
        if several:
            weights = multi_round(own, taught, weights, classes=classes, method=method, variant=variant, c=c, cost=cost)
        else:
            weights = binary_round(own, taught, weights, variant=variant, c=c)
        weights = materialize(weights, "weights")
    return answers


def classify_offline(train: DataFrame, labels: DataFrame, test: DataFrame, *, classes: int = 2, rounds: int = 5, **options) -> tuple[DataFrame, DataFrame]:
    """Trains for some rounds, then answers the test examples: (answers, weights). Two classes: labels -1 and 1; more: 0 to ``classes`` - 1."""
    if classes == 2:
        weights = train_binary(train, labels, rounds=rounds, **options)
        return binary_predict(test, weights), weights
    weights = train_multi(train, labels, classes=classes, rounds=rounds, **options)
    return multi_predict(test, weights, classes), weights


class BinaryLearner:
    """Exact one-at-a-time steps over a weight map, for dense or sparse examples (indices, values)."""

    def __init__(self, variant: str = "PA", c: float = 1.0):
        self.variant, self.c, self.w = variant, c, {}

    def margin(self, indices, values) -> float:
        return float(sum(self.w.get(i, 0.0) * v for i, v in zip(indices, values, strict=True)))

    def predict(self, indices, values) -> bool:
        return self.margin(indices, values) > 0

    def learn(self, indices, values, label: int) -> dict[int, float]:
        loss = max(0.0, 1 - label * self.margin(indices, values))
        tau = float(np_rate(loss, float(np.dot(values, values)), self.variant, self.c)) * label
        delta = {i: tau * v for i, v in zip(indices, values, strict=True)} if tau else {}
        for i, d in delta.items():
            self.w[i] = self.w.get(i, 0.0) + d
        return delta


class SparseVector:
    """(size, indices, values) with equality by content."""

    def __init__(self, size: int, entries: dict[int, float]):
        self.size, self.entries = size, {int(k): float(v) for k, v in entries.items()}

    def get(self, i: int) -> float:
        return self.entries.get(i, 0.0)

    @property
    def indices(self) -> list[int]:
        return sorted(self.entries)

    @property
    def values(self) -> list[float]:
        return [self.entries[i] for i in self.indices]

    def __len__(self) -> int:
        return len(self.entries)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, SparseVector) and (self.size, self.entries) == (other.size, other.entries)

    def __hash__(self) -> int:
        return hash((self.size, tuple(sorted(self.entries.items()))))
