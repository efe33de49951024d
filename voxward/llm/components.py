"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxward.llm.tables import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a``, ``b``, longs).

    The component is the smallest node reachable. Each step points nodes at a
    smaller neighbour, so the number of rounds grows with the logarithm of the
    longest chain; no component is ever gathered in one task. The smallest
    neighbours are combined before their shuffle and stored before they are
    joined back, so that joins on a node with very many links can be split.
    Self-links and rows with a null are left out; a table without links gives
    no rows.
    """
    edges = stored(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "lowest")
        large = stored(
            both.join(lowest, "a").where("b > a AND b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(),
            "large",
        )
        lowest = stored(large.groupBy("a").agg(F.min("b").alias("low")), "lowest")
        joined = large.join(lowest, "a")
        small = joined.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = stored(small.union(lowest.select("a", F.col("low").alias("b"))).distinct(), "edges")
        seen = edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
