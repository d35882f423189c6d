"""Ordered work within a slot that may be too large for one task: parts by range, and what they hand on.

Rows are dealt by ranges of (slot, order), so a slot with very many rows spans
several parts and a part holds many small slots.  A part works on its own rows with
a window; what a slot's rows need from other parts is taken from one row for each
slot and part.  Only slots that cross a border have any: two for each part at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.sources.tables import shared_folder

#: Rows of a slot that one window takes; with more, the slot is swept in parts.
MOST_ROWS = 1_000_000


def largest_slot(rows: DataFrame, slot: Sequence[str]) -> int:
    """Rows of the largest slot: counts are added up before they move."""
    return rows.groupBy(*slot).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def dealt(rows: DataFrame, slot: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with ``_part``, rising with (slot, order), written so that every reader sees the same parts."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = shared_folder(spark, "sweep")
    rows.repartitionByRange(parts, *slot, *order).withColumn("_part", F.spark_partition_id()).write.parquet(folder)
    return spark.read.parquet(folder)


def crossing(parts: DataFrame, slot: Sequence[str], *values: Column) -> DataFrame:
    """``slot, _part, values``, aggregated over a slot's rows in a part, of the slots that are in several parts."""
    ends = parts.groupBy(*slot, "_part").agg(*values)
    return ends.withColumn("_parts", F.count("*").over(Window.partitionBy(*slot))).where("_parts > 1").drop("_parts")


def handed(rows: DataFrame, crossed: DataFrame, slot: Sequence[str]) -> DataFrame:
    """The rows with the other columns of ``crossed`` for their slot and part; at most two rows for each part, so these are broadcast."""
    names = {c: f"_x_{k}" for k, c in enumerate([*slot, "_part"])}
    side = crossed.withColumnsRenamed(names)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(x)) for c, x in names.items()])
    return rows.join(F.broadcast(side), same, "left").drop(*names.values())
