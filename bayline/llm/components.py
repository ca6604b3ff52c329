"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayline.llm.store import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a long, b long); component is one of its nodes.

    Each round every node points at its least neighbour, pointers are followed once more, and the
    graph is contracted along them; with ids that are hashes this leaves a fraction of the nodes.
    Rounds end when no edge is left. Each round's pointers are written, and the chain of pointers
    is joined from the last round back to the first. No node's edges are ever gathered.
    """
    rounds: list[DataFrame] = []
    edges = materialise(edges.where("a <> b").distinct())
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        least = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent"))
        least = materialise(least)
        further = least.select(F.col("node").alias("parent"), F.col("parent").alias("beyond"))
        parents = materialise(least.join(further, "parent").select("node", F.col("beyond").alias("parent")))
        rounds.append(parents)
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("x"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("y"))
        halfway = materialise(edges.join(left, "a").select("x", "b"))
        edges = materialise(halfway.join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds.pop().withColumnRenamed("parent", "component")
    while rounds:
        below = found.select(F.col("node").alias("parent"), "component")
        parents = rounds.pop()
        found = materialise(parents.join(below, "parent", "left").select("node", F.coalesce("component", "parent").alias("component")))
    return found
