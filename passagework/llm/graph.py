"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.shared import attach, settled

MOST_ROUNDS = 60


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has just one, which has none itself."""
    ends = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))
    return ends.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("v").isNull()).alias("root")).where("low <> high or (root and low is not null)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of the links (a, b) the smallest node that it is connected with.

    Each round is a constant number of shuffles of the links; the rounds grow with the logarithm of the longest chain,
    not with a component's size, and end when only stars are left. It is an error if MOST_ROUNDS rounds don't settle
    them. Least neighbours are found by partial aggregates, and those of the few nodes with most links are broadcast,
    so a hub's links stay where they are.
    """
    edges = settled(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # rows: links to larger nodes, the only ones that meet the least neighbour
        least = settled(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.when(F.col("v") > F.col("u"), True)).alias("n")).where("n > 0"))
        large = attach(both.where("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = settled(small.where("u <> v").distinct())
        if _stars_only(edges):
            break
    else:
        raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
