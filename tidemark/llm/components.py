"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges (u, v)."""
    edges = scratch.table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}_0")
    step = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smallest = large.where("u <> v").distinct()
        parent = smallest.groupBy("u").agg(F.min("v").alias("m"))
        small = smallest.join(parent, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        step += 1
        now = scratch.table(small.where("u <> v").distinct(), f"{name}_{step}")
        # Done when every node hangs from one root that hangs from none.
        roots = now.select(F.col("v").alias("u")).distinct()
        apart = now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u").unionByName(now.join(roots, "u", "left_semi").select("u"))
        scratch.drop(f"{name}_{step - 1}")
        edges = now
        if apart.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
