"""Connected components of an edge list, in Spark, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Large star links each node's larger neighbours to its least; small star the smaller ones and itself."""
    near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = near.join(least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (least node of its component) for every node that has an edge. edges: u long, v long, u != v."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    shape = None
    while True:
        e = stored(_star(_star(e, True), False))
        now = e.agg(F.count(F.lit(1)), F.count_distinct("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == shape:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        shape = now
