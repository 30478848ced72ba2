"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import replaced, stored


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node with an edge to another.

    Each step links nodes to the smallest neighbour, keeping all connections; neighbours are only
    ever aggregated to a minimum, so a node with very many edges is not gathered anywhere. Every
    round is written to the shared folder, which cuts the lineage; the round before it is removed. One
    row of totals per round comes to the driver, to see whether anything changed.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                 .where("u != v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u is linked to the smallest of u and its neighbours.
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # Small star: u and its smaller neighbours are linked to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        now = replaced(small, "edges", now)
        total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if total == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = total
    raise RuntimeError("components did not settle")
