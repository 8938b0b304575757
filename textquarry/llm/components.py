"""Connected components of an edge table, by alternating star contractions; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.shared import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); a component is named by its least node.

    Each round links every node's neighbours to its least neighbour (large star) and then the smaller
    ones among themselves (small star). Both steps only need a minimum per node, which is aggregated
    before the shuffle, and a join on the node, whose hot keys adaptive execution splits. Every round is
    written to the shared folder, and the rounds end when the edges no longer change, after about the
    logarithm of the longest path; each round brings some node nearer to its root, so they do end.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # An edge to a smaller node b stays b's business; it is re-added by the small star below.
        large = stored(large.where("a <> b").distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = stored(small.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
