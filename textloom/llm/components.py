"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

JUMPS = 2  # pointer jumps in a round


def _distinct_edges(edges: DataFrame) -> DataFrame:
    a, b = F.greatest("a", "b"), F.least("a", "b")
    return edges.where(F.col("a") != F.col("b")).select(a.alias("a"), b.alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of every node that has an edge. edges: a, b (bigint).

    Each round hangs every node on its least smaller neighbour, follows such links a few steps, and renames the ends of
    all edges; an edge whose ends meet goes. Nodes should be hashes: then a round takes away a constant share of them.
    """
    edges = storage.materialize(_distinct_edges(edges.select("a", "b")), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        parents = edges.groupBy("a").agg(F.min("b").alias("p"))
        parents = storage.materialize(parents, "parents")
        for _ in range(JUMPS):
            up = parents.select(F.col("a").alias("p"), F.col("p").alias("q"))
            parents = parents.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        parents = storage.materialize(parents, "parents")
        to = lambda c: parents.select(F.col("a").alias(c), F.col("p").alias(f"{c}_to"))
        moved = edges.join(to("a"), "a").join(to("b"), "b", "left").select(F.col("a_to").alias("a"), F.coalesce("b_to", "b").alias("b"))
        labels = labels.join(to("label"), "label", "left").select("node", F.coalesce("label_to", "label").alias("label"))
        labels = storage.materialize(labels, "labels")
        edges = storage.materialize(_distinct_edges(moved), "edges")
    return labels
