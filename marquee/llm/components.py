"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import settle


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node that can be reached.

    Each round sends all larger neighbours of a node to the smallest node around it, then all smaller ones, until
    nothing changes; the number of rounds grows with the logarithm of the longest path. A round is checkpointed, so
    its lineage ends there. Minima are summed up before the shuffle, so a node with very many edges is no burden,
    and the join that hands a minimum to a node's edges is one that Spark splits where it is uneven.
    """
    current = settle(edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).filter("low < high").distinct())
    seen = None
    while True:
        # Larger neighbours of every node go to the smallest of node and neighbours.
        both = current.select(F.col("high").alias("u"), F.col("low").alias("v")).union(current.select("low", "high"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = current.select(F.col("low").alias("u"), "high").join(least, "u").select(F.col("m").alias("low"), "high").distinct()
        # Smaller neighbours, and the node itself, go to the smallest of them.
        base = large.groupBy("high").agg(F.min("low").alias("m"))
        moved = large.join(base, "high").filter("low > m").select(F.col("m").alias("low"), F.col("low").alias("high"))
        current = settle(moved.union(base.select(F.col("m").alias("low"), "high")).distinct())
        now = current.agg(F.count("*"), F.sum(F.hash("low", "high").cast("long")), F.sum(F.xxhash64("low", "high").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return roots.union(current.select("low", "low").distinct())
