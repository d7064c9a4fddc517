"""Places for the nodes of a topic map: the best connected nodes, a disc for each cluster, forces inside it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators.links import degrees

#: A map shows so many nodes, those of most edges; more can't be read on a screen.
MOST_NODES = 1500


def shown_nodes(edges: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """(node, degree) of the nodes that a map shows, ties to the least node."""
    return degrees(edges).orderBy(F.desc("degree"), F.asc("node")).limit(most)


def discs(sizes: list[tuple[int, int]]) -> dict[int, tuple[float, float, float]]:
    """cluster to (x, y, radius) for (cluster, nodes): largest first, each at the first free place of a spiral."""
    placed: dict[int, tuple[float, float, float]] = {}
    for cluster, n in sorted(sizes, key=lambda s: (-s[1], s[0])):
        r, t = float(np.sqrt(n)) + 0.5, 0.0
        while True:
            x, y = 0.35 * t * np.cos(t), 0.35 * t * np.sin(t)
            if all((x - a) ** 2 + (y - b) ** 2 >= (r + c) ** 2 for a, b, c in placed.values()):
                placed[cluster] = (float(x), float(y), r)
                break
            t += 0.1 if t < 10 else 1 / t * 2
    return placed


def settled_places(n: int, edges: np.ndarray, radius: float, seed: int, rounds: int = 60) -> np.ndarray:
    """Points inside a disc: edges pull, all pairs push, steps shrink; equal inputs give equal places."""
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(n, 2)) * radius / 3
    for k in range(rounds):
        gap = p[:, None] - p[None, :]
        far = np.maximum((gap**2).sum(axis=2), 1e-2)
        force = (gap / far[..., None]).sum(axis=1)
        for a, b in edges:
            pull = (p[b] - p[a]) * 0.3
            force[a] += pull
            force[b] -= pull
        p += force * (0.3 * radius / (1 + np.abs(force).max())) * (1 - k / rounds)
        out = np.maximum(np.linalg.norm(p, axis=1) / radius, 1)
        p /= out[:, None]
    return p


def placed(edges: DataFrame, clusters: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """(node, cluster, x, y) of the shown nodes of edges (a, b, weight), each in the disc of its cluster (node, cluster).

    Clusters are laid out in parallel; none has more nodes than the map shows.
    """
    nodes = shown_nodes(edges, most).join(clusters, "node").select("node", "cluster").cache()
    where = discs([(r["cluster"], r["n"]) for r in nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()])
    mate = edges.join(nodes.select(F.col("node").alias("a"), "cluster"), "a").join(nodes.select(F.col("node").alias("b"), F.col("cluster").alias("_c")), "b").where("cluster = _c").select(F.col("_c").alias("of"), "a", "b")

    def lay(own: pd.DataFrame, inner: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node")
        at = {v: i for i, v in enumerate(own["node"])}
        pairs = np.array(sorted((at[a], at[b]) for a, b in zip(inner["a"], inner["b"], strict=True)), dtype=int).reshape(-1, 2)
        x, y, r = where[int(own["cluster"].iat[0])]
        p = settled_places(len(own), pairs, r - 0.5, int(own["cluster"].iat[0]) % 2**32)
        return pd.DataFrame({"node": own["node"].to_numpy(), "cluster": own["cluster"].to_numpy(), "x": p[:, 0] + x, "y": p[:, 1] + y})

    return nodes.groupBy("cluster").cogroup(mate.groupBy("of")).applyInPandas(lay, "node bigint, cluster bigint, x double, y double")
