"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import sized, stored


def _jump(parents: DataFrame) -> DataFrame:
    """Follow pointers (node, root), which always go to a smaller number, to their ends."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
        parents = stored(parents.join(sized(up), "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "graph-jump")
        if parents.where("moved").isEmpty():
            return parents.select("node", "root")
        parents = parents.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """Smallest number reachable for every node of stored links (a, b): id, root.

    Rounds of contraction: every node that has a smaller neighbour points to its smallest one,
    pointers are followed to their ends, and links are rewritten to those ends. Nodes that
    still have links at least halve in each round, so rounds grow with the logarithm of
    the nodes. Each round is a few equi-joins and map-side minima on stored tables: a node
    with very many links is never gathered, and nothing goes to the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).where("root < node")
        parents = _jump(stored(smallest, "graph-hooks"))
        known = sized(parents)
        ends = known.select(F.col("node").alias("root"), F.col("root").alias("end"))
        if labels is None:
            labels = parents
        else:
            # every node of a contracted link is an end of the round before
            moved = labels.join(ends, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
            labels = moved.unionByName(parents.join(sized(labels), "node", "left_anti"))
        labels = stored(labels, "graph-labels")
        to = lambda side: known.select(F.col("node").alias(side), F.col("root").alias(f"{side}_end"))
        moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left")
        moved = moved.select(F.coalesce("a_end", "a").alias("a"), F.coalesce("b_end", "b").alias("b")).where("a <> b")
        edges = stored(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "graph-links")
        if edges.isEmpty():
            return labels.select(F.col("node").alias("id"), "root")
