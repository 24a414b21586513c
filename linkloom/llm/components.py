"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step sums the least neighbour per node before it shuffles, and a node with very many
edges is only the long side of an equi-join, which Spark splits. Nothing but two numbers
per round comes to the driver. Each round's edges are written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the edges (a, b) connect: fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]


def _least(edges: DataFrame) -> DataFrame:
    """edges (a, b) with m: the least of a and all its b."""
    least = edges.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m")).withColumnRenamed("a", "k")
    return edges.join(least, F.col("a") == F.col("k")).drop("k")


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's least node) of every node that the edges (a, b) link to another."""
    edges = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    told = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        small = _least(large).select("a", "b", "m")
        edges = written(
            small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct(),
            "edges",
        )
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        now = (row["n"], row["h"])
        if now == told or not row["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        told = now
