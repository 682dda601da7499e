"""Connected components of a graph that is only ever held as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mealgrid.core.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); the component is its smallest node.

    Contraction: every node that has a smaller neighbour points to the smallest one; pointers are followed by doubling;
    edges are redrawn between the roots, and what is left goes round again. Only minima are gathered per node, so a
    node may have any number of neighbours, and all states are tables in the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    left = written(
        edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges"
    )
    nodes = left.select(a.alias("node")).union(left.select(b.alias("node"))).distinct()
    found = written(nodes.withColumn("component", F.col("node")), "components")
    while not left.isEmpty():
        root = _roots(left.groupBy("a").agg(F.min("b").alias("p")))
        to = root.withColumnRenamed("a", "node")
        found = written(
            found.join(to.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("p", "component").alias("component")
            ),
            "components",
        )
        moved = left.join(root, "a").select(F.col("p").alias("a"), "b")
        moved = moved.join(to.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("p", "b").alias("b"))
        moved = moved.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
        left = written(moved, "edges")
    return found


def _roots(pointers: DataFrame) -> DataFrame:
    """Pointers (a, p) followed to their ends."""
    now = written(pointers, "pointers")
    while True:
        after = now.select(F.col("a").alias("p"), F.col("p").alias("q"))
        now = written(
            now.join(after, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("went")),
            "pointers",
        )
        moved = now.where("went").isEmpty()
        now = now.select("a", "p")
        if moved:
            return now
