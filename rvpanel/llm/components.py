"""Connected components of an edge table, by contraction with pointer jumping.

Every round each node points to its smallest neighbour or itself, pointers are followed a few
steps, and edges are renamed by them; rounds end when no edge is left.  Each round's tables are
written to the shared folder, so nothing reaches the driver but whether edges remain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rvpanel.sources.store import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a long, b long)``; component: smallest node reachable."""
    both = edges.select("a", "b").where("a <> b")
    left = materialize(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
    found = nodes.select("node", F.col("node").alias("component"))
    while not left.isEmpty():
        ends = left.select(F.col("b").alias("node"), F.col("a").alias("to"))
        # Pointers of all nodes with a smaller neighbour; the others point to themselves.
        to = materialize(ends.groupBy("node").agg(F.min("to").alias("to")))
        for _ in range(2):
            ahead = to.select(F.col("node").alias("to"), F.col("to").alias("further"))
            to = to.join(ahead, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        to = materialize(to)
        found = materialize(_renamed(found, "component", to))
        moved = _renamed(_renamed(left, "a", to), "b", to).where("a <> b")
        left = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return found


def _renamed(rows: DataFrame, column: str, to: DataFrame) -> DataFrame:
    by = to.select(F.col("node").alias("_node"), F.col("to").alias("_to"))
    out = rows.join(by, rows[column] == by["_node"], "left").withColumn(column, F.coalesce("_to", column))
    return out.drop("_node", "_to")
