"""Connected components by alternating large-star and small-star rounds.

Edges stay distributed: every round is a partial aggregation (the smallest
neighbour of each node) and an equi-join, and is written to the shared
checkpoint folder, so lineage stays short and a lost executor costs one round.
The smallest-neighbour table is written first, so that the join reads two plain
scans and adaptive execution may split the partition of a node with many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import checkpoint

#: Rounds are logarithmic in the longest path; beyond this something is wrong.
MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = checkpoint(both.groupBy("a").agg(F.min("b").alias("m"))
                       .select("a", F.least("a", "m").alias("m")))
    return (both.filter(F.col("b") > F.col("a")).join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, are tied to the smallest one."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = checkpoint(down.groupBy("a").agg(F.min("b").alias("m")))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the smallest
    node of its component. Roots themselves are included. Self-loops count for
    nothing; an empty edge table gives an empty result."""
    edges = checkpoint(edges.select("a", "b").filter("a <> b").distinct())
    before = _signature(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        edges = checkpoint(_small_star(checkpoint(_large_star(edges))))
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
