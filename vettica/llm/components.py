"""Connected components by alternating large and small stars.

Every round is joins and aggregates on the edge table; nothing is gathered by node,
so one large component is spread over tasks like any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettica.llm.common import stored


def _nearest(edges: DataFrame) -> DataFrame:
    """(u, v, m): both directions of each edge with the least node at or beside u."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the least node beside it."""
    near = _nearest(edges)
    return near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """With a > b: each node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), "m"), F.struct(F.col("b").alias("x"), "m"))).alias("e"))
    return moved.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); the component is its least
    node.  Loops and repeated edges are ignored; nodes without an edge have no row."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    mark = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == found:
            break
        mark = found
        now = stored(_small_star(_large_star(now)))
    # now each node but the least points at the least
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
