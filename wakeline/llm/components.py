"""Connected components of an edge table by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs each node's larger (large) or smaller-or-equal neighbours under the least node around it."""
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a"), F.least("a", "_m").alias("m"))
    hung = both.join(least, "a")
    out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else hung.select("b", "m").union(least.select("a", "m")).toDF("a", "b")
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of the edges (a, b) but the least ones themselves; rounds go on until nothing changes."""
    now = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        now = checkpoint(_star(_star(now, True), False))
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
