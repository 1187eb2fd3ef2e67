"""Connected components of a graph given by edges, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazelake.llm.common import written


def _larger(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least neighbour of it."""
    both = e.select("hi", "lo").union(e.select("lo", "hi")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _smaller(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; a root is its component's least node.

    Rounds of the two steps above, each written to the shared folder, until the edges stay the same. They
    end as stars. Least neighbours are aggregated before the shuffle, so a node with many links is no hot key there.
    """
    a, b = F.col("a"), F.col("b")
    e = written(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    mark = None
    while True:
        e = written(_smaller(_larger(e).distinct()).distinct(), "edges")
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == mark:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark = seen
