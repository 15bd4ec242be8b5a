"""Matrix factorization in strata: ordered stochastic steps, in parallel, without a server.

Users and items are dealt out over ``blocks`` each by a hash. In stratum s the ratings of user block b and item block b + s meet; as no two of
these pairs share a user or an item, each pair is an ordered pass of its own, in which every step sees the vectors that the step before
left, and all pairs run at once. ``blocks`` strata make a pass over all ratings.

A pair is one cogroup: its ratings and the vectors of both blocks, so memory follows the size of a block, and a hot user's or item's
ratings are spread over all strata. The vectors are a written table after each stratum, which the next one reads. Choose about as many
blocks as tasks can run at once: each stratum writes all vectors.

Edge cases: ratings with a null are left out; repeated ratings are steps each, one after the other; no ratings give no factors; factors without
a rating stay as they are, and ratings whose ids have no factors are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import portable
from ..plans.storage import discard, materialize
from .factorization import Factors, initial


def block_of(id: Column, blocks: int, seed: int = 0) -> Column:  # noqa: A002
    return F.pmod(portable(id, seed), F.lit(blocks)).cast("int")


def placed_ratings(ratings: DataFrame, blocks: int, seed: int = 0) -> DataFrame:
    """Ratings with the stratum they belong to, the user block and their place in the order of steps (a hash of user and item, then these)."""
    own, other = block_of(F.col("user"), blocks, seed), block_of(F.col("item"), blocks, seed + 1)
    order = portable(F.concat_ws("|", F.col("user").cast("string"), F.col("item").cast("string")), seed)
    kept = ratings.where("user IS NOT NULL AND item IS NOT NULL AND rating IS NOT NULL")
    return kept.select("user", "item", F.col("rating").cast("double").alias("rating"), own.alias("block"), F.pmod(other - own, F.lit(blocks)).alias("stratum"), order.alias("order"))


def state_of(factors: Factors, blocks: int, seed: int) -> DataFrame:
    """(item_side, id, vec, block) of both sides."""
    one = lambda df, side: df.select(F.lit(side).alias("item_side"), "id", "vec", block_of(F.col("id"), blocks, seed + side).alias("block"))
    return one(factors.users, 0).unionByName(one(factors.items, 1))


def stratum_pass(placed: DataFrame, state: DataFrame, stratum: int, *, blocks: int, rate: float, loss: str = "squared") -> DataFrame:
    """The state after the steps of one stratum."""

    def steps(rated: pa.Table, vectors: pa.Table) -> pa.Table:
        side, ids = vectors["item_side"].to_pylist(), vectors["id"].to_pylist()
        values = np.array(vectors["vec"].to_pylist(), float).reshape(len(ids), -1 if ids else 0)
        at = {key: i for i, key in enumerate(zip(side, ids, strict=True))}
        rated = rated.sort_by([("order", "ascending"), ("user", "ascending"), ("item", "ascending"), ("rating", "ascending")])
        for user, item, rating in zip(*(rated[c].to_pylist() for c in ("user", "item", "rating")), strict=True):
            u, i = at.get((0, user)), at.get((1, item))
            if u is None or i is None:
                continue
            error = rating - float(values[u] @ values[i])
            error = rate * (1 / (1 + np.exp(-error)) if loss == "sigmoid" else error)
            values[u], values[i] = values[u] + error * values[i], values[i] + error * values[u]
        return vectors.set_column(vectors.schema.get_field_index("vec"), "vec", pa.array(values.tolist(), pa.list_(pa.float64())))

    # The vectors of an item block go to the user block that they meet.
    home = F.when(F.col("item_side") == 1, F.pmod(F.col("block") - stratum, F.lit(blocks))).otherwise(F.col("block"))
    there = state.withColumn("home", home)
    moved = placed.where(F.col("stratum") == stratum).groupBy("block").cogroup(there.groupBy("home")).applyInArrow(steps, there.schema)
    return moved.drop("home")


def train_stratified(ratings: DataFrame, *, size: int = 10, low: float = -0.01, high: float = 0.01, rate: float = 0.01, rounds: int = 10, blocks: int = 8, loss: str = "squared", seed: int = 0) -> Factors:
    """Ordered passes over all ratings, stratum by stratum."""
    placed = materialize(placed_ratings(ratings, blocks, seed), "ratings")
    start = Factors(initial(placed, "user", size, low, high, seed), initial(placed, "item", size, low, high, seed + 1))
    state = materialize(state_of(start, blocks, seed), "state")
    for _ in range(rounds):
        for stratum in range(blocks):
            after = materialize(stratum_pass(placed, state, stratum, blocks=blocks, rate=rate, loss=loss), "state")
            discard(state)
            state = after
    discard(placed)
    return factors_of(state)


def factors_of(state: DataFrame) -> Factors:
    return Factors(state.where("item_side = 0").select("id", "vec"), state.where("item_side = 1").select("id", "vec"))
