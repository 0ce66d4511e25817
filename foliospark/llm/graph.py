"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import checkpoint_ready


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) from edges a, b of integers; nodes without an edge don't appear.

    Alternates large-star and small-star steps, whose number grows with the logarithm of the nodes; each
    round is written to the checkpoint folder. NULL ends and loops are left out.
    """
    checkpoint_ready(edges.sparkSession)
    e = edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct().checkpoint()
    before = None
    while True:
        both = e.unionByName(e.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.join(least, "u").where("v > u").selectExpr("v u", "m v").where("u <> v").distinct()
        # small star: lower neighbours and the node itself go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v u", "m v").unionByName(least.selectExpr("u", "m v")).where("u <> v").distinct()
        e = small.checkpoint()
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return e.selectExpr("u node", "v component").unionByName(e.selectExpr("v node", "v component")).distinct()
