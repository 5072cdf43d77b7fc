"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from polyphon.sources.workspace import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (a > b) edges: every neighbour is linked to the smallest one.

    Large star looks at all neighbours and moves the larger ones; small star
    looks at the smaller ones only. The smallest neighbour per node is stored
    first, so that both sides of the join are stored tables and adaptive
    execution can split the rows of a node with very many neighbours.
    """
    if large:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    moved = edges.join(least, "a")
    if large:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") > F.col("b"))
    if large:
        out = out.union(least.where(F.col("m") < F.col("a")).select("a", F.col("m").alias("b")))
    else:
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.distinct()


def _is_flat(edges: DataFrame) -> bool:
    twice = edges.groupBy("a").count().where("count > 1").select("a")
    chained = edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").select("a")
    return twice.union(chained).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links to ``(node, component)`` for all nodes with a link; ``component`` is the smallest node.

    Each round writes its edges to the shared folder. Rounds end when every node
    has one edge, to a node that has none, which takes about log2 of the longest
    chain of links.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = materialize(edges, "edges")
    while not _is_flat(edges):
        edges = materialize(_star(materialize(_star(edges, True), "large_star"), False), "small_star")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
