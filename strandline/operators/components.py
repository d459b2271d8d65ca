"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.lineage import durable

MAX_ROUNDS = 30


def _settled(e: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none: then all components are stars around their least node."""
    row = e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("m")).first()
    return row["n"] == row["m"] and not e.select("b").distinct().join(e.select(F.col("a").alias("b")), "b", "left_semi").take(1)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with an edge; component is the least node of its component.

    Edges are undirected; loops, repeated edges and rows with a null end are ignored. Each
    round is two joins and three aggregations over the edges, each half cut off by a checkpoint; neighbour lists are
    never collected, so a hub costs no more memory than any node. The number of rounds grows with the
    logarithm of the diameter; more than MAX_ROUNDS raises instead of giving a part.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    # Each step reads edges several times, so each is cut off before the next: plans stay small whatever the edges come from.
    e = durable(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        # Large star: every neighbour above a node is tied to the least node around it.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = durable(large)
        # Small star: every neighbour below a node, and the node, are tied to the least of them.
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(m.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = durable(small)
        if _settled(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
