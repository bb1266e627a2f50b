"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges up to which a round's minima, at most two an edge, are broadcast (a node takes up to 24 bytes).
SMALL = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of `edges` (a, b).

    Each round links every node to the smallest node of its neighbourhood; rounds are logarithmic in the
    number of nodes, and end when neither the number of edges nor the sum of their hashes changes. A node with very
    many neighbours is only ever the key of a pre-aggregated minimum and of a join with a table of minima, which is
    broadcast while there are few edges; beyond, the join's two sides have shuffles of their own, so that Spark may split
    a large partition. Loops, repeated edges and nulls are ignored. No edges give no rows.
    """
    pairs = edges.where("a is not null and b is not null and a != b")
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = _state(pairs)
    if not state[0]:
        return pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))
    while True:
        minima = F.broadcast if state[0] <= SMALL else cut
        # large star: every larger neighbour goes to the smallest of the closed neighbourhood
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = minima(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = cut(both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct())
        # small star: a node's smaller neighbours go to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(minima(least), "b")
        pairs = cut(small.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").unionByName(least.select(F.col("m").alias("a"), "b")).distinct())
        before, state = state, _state(pairs)
        if state == before:
            break
    stars = pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
