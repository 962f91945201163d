"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfattr.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """`node` and `component` (the same for nodes that are connected) of every node with an edge.

    edges: `a`, `b`, longs in no meaningful order, as the number of rounds then grows with the
    logarithm of the longest chain. In each round every group joins its smallest neighbour and
    the edges move to the joined groups. Only min and distinct run over the edges of a node, both
    with partial aggregation; every round's tables are stored, and the labels follow them in the end.
    """
    first = live = stored(edges.select("a", "b").where("a != b").distinct(), "edges")
    rounds = []
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        joins = both.groupBy(F.col("a").alias("old")).agg(F.min("b").alias("least"))
        joins = stored(joins.select("old", F.least("old", "least").alias("new")), "joins")
        rounds.append(joins)
        left, right = joins.toDF("a", "x"), joins.toDF("b", "y")
        moved = live.join(left, "a").join(right, "b").where("x != y")
        live = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    nodes = first.select("a").union(first.select("b")).distinct().toDF("node")
    labels = nodes.withColumn("component", F.col("node"))
    for joins in rounds:
        labels = labels.join(joins, labels.component == joins.old, "left").select(
            "node", F.coalesce("new", "component").alias("component")
        )
    return stored(labels, "labels")


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels of a graph with further edges: only components that these link are joined, not all edges gone through again."""
    known = labels.toDF("a", "x"), labels.toDF("b", "y")
    between = edges.select("a", "b").join(known[0], "a", "left").join(known[1], "b", "left")
    between = between.select("a", "b", F.coalesce("x", "a").alias("of_a"), F.coalesce("y", "b").alias("of_b"))
    between = stored(between, "between")
    joined = components(between.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    old = labels.join(joined.toDF("component", "to"), "component", "left").select(
        "node", F.coalesce("to", "component").alias("component")
    )
    # A node without a label so far stands for itself among the joined ones.
    alone = between.where("a = of_a").select(F.col("a").alias("node"))
    alone = alone.union(between.where("b = of_b").select("b")).distinct()
    new = alone.join(labels, "node", "left_anti").join(joined, "node")
    return stored(old.unionByName(new), "labels")
