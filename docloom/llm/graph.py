"""Classes of a link graph, and joins with tables of a few numbers a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage

SMALL_ROWS = 4_000_000  # a table of two numbers a row is broadcast up to this size, and joined by a shuffle beyond


def classes(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the link graph: equal roots, if and only if a path joins the nodes.

    Each round points every node to the least of itself and its neighbours and contracts the graph by that;
    the number of nodes left falls by a constant factor a round.
    """
    edges = cut_lineage(edges.where("a <> b"))
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = cut_lineage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent")))
        if labels is None:
            labels = parents.withColumnRenamed("parent", "root")
        else:
            step = parents.withColumnsRenamed({"node": "root", "parent": "next"})
            labels = labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        labels = cut_lineage(labels)
        left, right = parents.withColumnsRenamed({"node": "a", "parent": "pa"}), parents.withColumnsRenamed({"node": "b", "parent": "pb"})
        edges = cut_lineage(edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if edges.isEmpty():
            return labels


def small(table: DataFrame) -> DataFrame:
    """``table`` (written before; a few numbers a row) marked for broadcast if it has at most ``SMALL_ROWS`` rows."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table
