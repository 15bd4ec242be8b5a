"""Connected components of a graph given as links, by alternating large-star and small-star steps.

Each step is a grouped aggregation over links; the number of steps grows with the logarithm of the longest chain. Each round is
written to the shared folder, so lineage stays short. No link or component reaches the driver: only whether a link is left that
is not yet between a node and its root. Large-star connects a node's larger neighbours to its smallest neighbour, so a hot node's
links are spread over its neighbours as rows; the minimum of each node is found by a partial aggregation, never by gathering its
neighbours, and written before links meet it, so that the join's sides are plain shuffles, which adaptive execution splits where
a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``: the smallest node reachable. Null ends and loops are ignored."""
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    n = links.count()
    while True:
        # Large star: all neighbours larger than a node meet the smallest of its neighbourhood.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "lowest", 2 * n)
        met = materialize(both.join(low, "a").select("a", "b", "m", (F.col("m") != F.least("a", "b")).alias("open")), "large", 2 * n)
        # Links are stars around the smallest nodes exactly if each end of each link has the link's smaller end as its smallest.
        if not met.where("open").take(1):
            found = low.select(F.col("a").alias("node"), F.col("m").alias("root"))
            discard(met, links)
            return found
        large = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours meet the smallest of them.
        large = materialize(large, "links", 2 * n)
        lowest = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "lowest", 2 * n)
        joined = large.join(lowest, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        after = materialize(small, "links", 2 * n)
        discard(links, low, met, large, lowest)
        links = after
