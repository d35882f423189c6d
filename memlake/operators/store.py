"""The memory table: listing, counting, describing, duplicates, access counts, folding of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import ascii_lower

SORT_KEYS = ("created_at", "importance", "access_count")


def list_memories(memories: DataFrame, sort_by: str = "created_at", limit: int = 20, namespace: str | None = None) -> DataFrame:
    """The first ``limit`` (1 to 1000) memories by one key, highest first."""
    if sort_by not in SORT_KEYS:
        raise ValueError(f"sort_by must be one of {SORT_KEYS}")
    rows = memories.where(F.col("namespace") == namespace) if namespace else memories
    return rows.orderBy(F.desc(sort_by), F.asc("id")).limit(max(1, min(1000, limit)))


def count_by_namespace(memories: DataFrame) -> DataFrame:
    return memories.groupBy("namespace").agg(F.count("*").alias("n"))


def describe(memories: DataFrame) -> DataFrame:
    """One row for each namespace, the most used first, beside the table's own totals."""
    by = memories.groupBy("namespace").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
    total = by.agg(F.sum("n").alias("total"), F.min("oldest").alias("first_at"), F.max("newest").alias("last_at"))
    return by.crossJoin(F.broadcast(total)).orderBy(F.desc("n"), F.asc("namespace"))


def dedup_proposals(memories: DataFrame, prefix: int = 50) -> DataFrame:
    """Groups of memories of a namespace that begin alike (A-Z folded)."""
    head = F.substring(ascii_lower("content"), 1, prefix)
    return memories.groupBy("namespace", head.alias("head")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def exact_duplicates(memories: DataFrame) -> DataFrame:
    """Groups of equal texts of a namespace, by ``digest``: what is dealt is a SHA-256 and a length, never the texts."""
    keyed = memories.select("id", "namespace", F.sha2("content", 256).alias("digest"), F.length("content").alias("size"))
    return keyed.groupBy("namespace", "digest", "size").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def duplicate_members(memories: DataFrame) -> DataFrame:
    """The rows of all groups of exact duplicates, with their digest in place of the text."""
    keyed = memories.select("id", "namespace", F.sha2("content", 256).alias("digest"))
    return keyed.join(exact_duplicates(memories).select("namespace", "digest"), ["namespace", "digest"], "left_semi")


def consolidate_preview(memories: DataFrame, limit: int = 50, characters: int = 80) -> DataFrame:
    """The largest groups of exact duplicates, with the beginning of their first text."""
    groups = exact_duplicates(memories).orderBy(F.desc("n"), F.asc("first_id")).limit(limit)
    first = memories.select(F.col("id").alias("first_id"), F.substring("content", 1, characters).alias("preview"))
    return groups.join(first, "first_id").select("namespace", "first_id", "n", "preview")


def duplicate_losers(memories: DataFrame) -> DataFrame:
    """Rows that a clean-up deletes: all of a group but the most important, oldest, lowest id.

    A digest stands for the content, so the shuffle carries no texts.
    """
    order = Window.partitionBy("namespace", "digest").orderBy(F.desc("importance"), F.asc("created_at"), F.asc("id"))
    narrow = memories.select("id", "namespace", "importance", "created_at", F.sha2("content", 256).alias("digest"))
    return narrow.withColumn("rank", F.row_number().over(order)).where("rank > 1").withColumn("rank", F.col("rank").cast("long")).drop("digest")


def fold_accesses(batches: DataFrame) -> DataFrame:
    """``batches(ids array, at)`` to hits and last access of each id."""
    return batches.select(F.explode("ids").alias("id"), "at").groupBy("id").agg(F.count("*").alias("hits"), F.max("at").alias("last_accessed"))


def apply_accesses(memories: DataFrame, hits: DataFrame) -> DataFrame:
    added = hits.select("id", F.col("hits").alias("_hits"), F.col("last_accessed").alias("_last"))
    joined = memories.join(added, "id", "left")
    counted = joined.withColumn("access_count", F.col("access_count") + F.coalesce("_hits", F.lit(0)))
    return counted.withColumn("last_accessed", F.coalesce("_last", "last_accessed")).drop("_hits", "_last")


def fold_operations(ops: DataFrame) -> DataFrame:
    """State of each id after an append-only log of ``(seq, op, id, content, importance, at)``.

    remember sets, update overwrites what is given, invalidate closes at ``at``,
    forget removes; what follows a forget counts alone.
    """
    start = F.max(F.when(F.col("op").isin("remember", "forget"), F.col("seq"))).over(Window.partitionBy("id"))
    live = ops.withColumn("_start", start).where("_start is null or seq >= _start")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & F.col("op").isin("remember", "update"), F.col("seq")))
    state = live.groupBy("id").agg(
        latest("content").alias("content"),
        latest("importance").alias("importance"),
        F.max(F.when(F.col("op") == "invalidate", F.col("at"))).alias("valid_until"),
        F.bool_or(F.col("op") == "forget").alias("_gone"),
        F.bool_or(F.col("op") == "remember").alias("_made"),
    )
    return state.where("_made and not _gone").drop("_gone", "_made")


def visible(session_id: str, all_sessions: bool = False) -> Column:
    """Rows of the session, and global ones; any scope but these two is hidden."""
    known = F.col("scope").isin("session", "global")
    return known if all_sessions else known & ((F.col("scope") == "global") | (F.col("session_id") == session_id))


def last_of(rows: DataFrame, key: str, order: Column, k: int) -> DataFrame:
    """Ring buffer: the ``k`` newest rows of each key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order.desc(), F.desc("event_id")))).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))
