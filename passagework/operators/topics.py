"""Topic map: communities of a weighted graph by distributed local moves, and their sizes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from passagework.operators.tables import written


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of labels (node, community) on undirected edges (a, b, weight)."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    both = edges.join(la, "a").join(lb, "b").withColumn("inside", F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0))
    ends = both.select(F.explode(F.array(*(F.struct(F.col(c).alias("c"), "weight", "inside") for c in ("ca", "cb")))).alias("e"))
    sums = ends.groupBy("e.c").agg(F.sum("e.weight").alias("k"), F.sum("e.inside").alias("inside"))
    twice, inside, squares = sums.agg(F.sum("k"), F.sum("inside"), F.sum(F.col("k") * F.col("k"))).first()
    return inside / twice - squares / (twice * twice) if twice else 0.0


def communities(edges: DataFrame) -> DataFrame:
    """(node, community): nodes of undirected edges (a, b, weight) by modularity; a community is named by its least node.

    Louvain's moves, made in parallel: in each round the nodes of one parity of a hash move to the neighbouring
    community of largest gain, ties to the least name. A level ends when neither parity's moves raise modularity any
    more, its communities are the next level's nodes, and the last level is the one that joins nothing. Everything is
    joins and sums, and the result depends on the edges alone.
    """
    given = edges.select("a", "b", F.col("weight").cast("double").alias("weight"))
    # every edge from both of its ends, so a loop counts twice
    graph = written(given.unionByName(given.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    names = None
    while True:
        labels, moved = _moved(graph)
        if names is None:
            names = labels
        elif moved:
            names = written(names.join(labels.select(F.col("node").alias("community"), F.col("community").alias("to")), "community").select("node", F.col("to").alias("community")))
        if not moved:
            break
        ca, cb = (labels.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in ("a", "b"))
        merged = graph.join(ca, "a").groupBy("ca", "b").agg(F.sum("weight").alias("weight")).join(cb, "b")
        graph = written(merged.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight")))
    least = names.groupBy("community").agg(F.min("node").alias("name"))
    return names.join(least, "community").select("node", F.col("name").alias("community"))


class _Weighed(NamedTuple):
    """Labels as a table (node, community, to, k): where each node is and would go, and its degree; with their modularity."""

    table: DataFrame
    modularity: float

    def after(self, parity: int) -> DataFrame:
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == parity
        return self.table.select("node", F.when(turn, F.col("to")).otherwise(F.col("community")).alias("community"), "k")


def _moved(graph: DataFrame) -> tuple[DataFrame, bool]:
    """Labels after the rounds of one level, and whether any node moved; loops count for a node's degree but pull nowhere.

    One pass weighs labels and finds where the nodes of either parity would go from them, so a round is one pass over
    the edges, and what the labels before it chose serves again if its moves are taken back.
    """
    loop = F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)
    seen = Observation()
    degree = graph.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k"), F.sum(loop).alias("loops"))
    degree = written(degree.observe(seen, F.sum("k").alias("total"), F.sum("loops").alias("loops")))
    total, loops = seen.get["total"] or 1.0, seen.get["loops"] or 0.0
    near = written(graph.where("a <> b").join(degree.select(F.col("node").alias("a"), "k"), "a"))
    best = _weighed(near, degree.select("node", F.col("node").alias("community"), "k"), total, loops)
    r = idle = 0
    moved = False
    while idle < 2:
        now = _weighed(near, best.after(r % 2), total, loops)
        if now.modularity > best.modularity + 1e-12:
            best, idle, moved = now, 0, True
        else:
            idle += 1
        r += 1
    return best.table.select("node", "community"), moved


def _weighed(near: DataFrame, labels: DataFrame, total: float, loops: float) -> _Weighed:
    """Labels (node, community, k) weighed over near (a, b, weight, k), where k is the degree of a."""
    tot = labels.groupBy("community").agg(F.sum("k").alias("tot"))
    there = labels.join(tot, "community")
    pull = near.join(there.select(F.col("node").alias("b"), "community", "tot"), "b").select(F.col("a").alias("node"), "community", "weight", "k", "tot", F.lit(False).alias("now"))
    own = there.select("node", "community", F.lit(0.0).alias("weight"), "k", "tot", F.lit(True).alias("now"))
    # a node's rows are dealt once, for both of the sums below
    choice = pull.unionByName(own).repartition("node").groupBy("node", "community").agg(F.sum("weight").alias("w"), F.max("k").alias("k"), F.max("tot").alias("tot"), F.max("now").alias("now"))
    others = F.col("tot") - F.when(F.col("now"), F.col("k")).otherwise(0.0)
    gain = F.round(F.col("w") - F.col("k") * others / total, 10)
    place = F.min(F.struct((F.lit(0.0) - gain).alias("gain"), (~F.col("now")).alias("away"), F.col("community").alias("to")))
    stay = lambda c: F.max(F.when(F.col("now"), F.col(c)))
    picked = choice.groupBy("node").agg(stay("community").alias("community"), place.alias("place"), F.max("k").alias("k"), stay("w").alias("w"), stay("tot").alias("tot"))
    seen = Observation()
    sums = picked.observe(seen, F.sum("k").alias("twice"), F.sum("w").alias("inside"), F.sum(F.col("k") * F.col("tot")).alias("squares"))
    table = written(sums.select("node", "community", F.col("place.to").alias("to"), "k"))
    twice, inside, squares = (seen.get[x] for x in ("twice", "inside", "squares"))
    return _Weighed(table, (inside + loops) / twice - squares / (twice * twice) if twice else 0.0)
