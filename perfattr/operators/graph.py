"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfattr.sources.storage import stored


def connected(edges: DataFrame) -> DataFrame:
    """(a, component) for every node with an edge to another: equal for nodes that are linked, however far apart.

    edges: a, b, longs without a meaningful order (hashes).  In each round every node joins its smallest
    neighbour, or stays if it is smaller, and edges move to what their ends have joined.  As the order
    has no meaning a fixed share of nodes goes in each round, along chains too, so rounds
    grow with the logarithm of the number of nodes.  A node's neighbours meet under partial aggregation.
    """
    live = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    nodes = live.select("a").union(live.select("b")).distinct().withColumn("component", F.col("a"))
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        moves = both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))
        moves = stored(moves.where("to <> a"), "moves")
        to = lambda c: F.coalesce(f"to_{c}", c).alias(c)
        moved = live.join(moves.toDF("a", "to_a"), "a", "left").join(moves.toDF("b", "to_b"), "b", "left")
        live = stored(moved.select(to("a"), to("b")).where("a <> b").distinct(), "edges")
        nodes = nodes.join(moves.toDF("component", "to"), "component", "left")
        nodes = nodes.select("a", F.coalesce("to", "component").alias("component"))
    return stored(nodes, "components")
