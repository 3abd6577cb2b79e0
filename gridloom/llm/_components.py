"""Connected components of a large edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its least neighbour (or itself) to its larger neighbours (large) or to its smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    if large:
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of long ids, any direction, to (node, root): the least node of each node's component, for all nodes but roots.

    Null ends and loops are ignored; an empty table gives an empty one. Each round
    is written to the shared folder; it ends when a round changes nothing.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    now, before = settle(now, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        now = settle(_star(_star(now, True), False), "edges")
