"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.session import checkpointed

#: Edges (two numbers each) that one task takes: fewer tasks than shuffle partitions where edges are few.
EDGES_PER_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``: root is the smallest node that can be reached.

    Each step joins every edge's ends with the smallest neighbour of one end, so a
    hub is never gathered into one row; a few steps of logarithmic number remain.
    No step makes more edges than it got, so their first count sets the number of
    tasks for all of them: many tiny tasks would leave many tiny shuffle files.
    """
    current = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tasks = max(1, math.ceil(current.count() / EDGES_PER_TASK))
    current = current.coalesce(tasks)
    seen = None
    while True:
        # Large star: every larger neighbour of a node moves to the node's smallest neighbour.
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        current = checkpointed(moved.union(low.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks))
        state = current.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
