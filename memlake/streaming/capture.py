"""Structured Streaming forms of turn capture, access counting and the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlake.functions.text import has_identity_signal
from memlake.operators.consolidate import consolidate


def stream_parquet(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; files that arrive later are later batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def capture_turns(turns: DataFrame) -> DataFrame:
    """Turns that are kept, with their importance; the same for a stream and a table."""
    weight = F.when((F.col("role") == "user") & (F.length("content") > 5), 0.5).when((F.col("role") == "assistant") & (F.length("content") > 10), 0.15).when(F.col("role") == "tool", 0.2)
    return turns.where(F.trim("content") != "").withColumn("importance", weight).where("importance is not null")


def access_counts(accesses: DataFrame) -> DataFrame:
    """Accesses and last access by id: a stateful count when ``accesses(id, at)`` is a stream."""
    return accesses.groupBy("id").agg(F.count("*").alias("hits"), F.max("at").alias("last_accessed"))


def session_spans(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of a user's events by gaps, with a watermark for late ones."""
    late = events.withWatermark("ts", lateness)
    return late.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")


def change_feed(changes: DataFrame, cursor: int, limit: int = 500) -> DataFrame:
    """The next changes after a cursor, in order."""
    return changes.where(F.col("seq") > cursor).orderBy("seq").limit(max(1, min(500, limit)))


def push(changes: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted changes and duplicates, by id."""
    ids = known.select("id").distinct()
    return changes.join(ids, "id", "left_anti"), changes.join(ids, "id", "left_semi")


#: Contexts in which an agent talks to itself: their turns are no memories.
INNER_CONTEXTS = ("cron", "flush", "subagent", "background", "skill_loop")


def worth_keeping(turns: DataFrame, owner: str | None = None) -> DataFrame:
    """``turns(context, speaker, owner, content)`` that a user said to the owner's agent, outside of its inner contexts."""
    mine = F.lit(True) if owner is None else F.col("owner").isNull() | (F.col("owner") == owner)
    said = F.coalesce(F.col("speaker"), F.lit("user")) == "user"
    return turns.where(~F.coalesce(F.col("context").isin(*INNER_CONTEXTS), F.lit(False)) & said & mine & (F.trim(F.coalesce("content", F.lit(""))) != ""))


def identity_memories(turns: DataFrame, characters: int = 400) -> DataFrame:
    """The extra global row of each user's turn that speaks of who they are."""
    told = turns.where((F.col("role") == "user") & has_identity_signal("content"))
    return told.select("session_id", "turn", F.substring("content", 1, characters).alias("content"), F.lit(0.85).alias("importance"), F.lit("identity").alias("source"), F.lit("global").alias("scope"))


def run_change_feed(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Append the changes that came since the last run: the stream's checkpoint is the cursor."""
    run_available(stream.select("seq", "id", "op"), sink, checkpoint)


def audit_rows(actions: DataFrame) -> DataFrame:
    """Audit rows of a stream of actions, with a digest in place of any text."""
    return actions.select("event_id", "at", "action", "memory_id", F.sha2(F.coalesce("detail", F.lit("")), 256).alias("detail_sha256"))


def run_consolidation(stream: DataFrame, sink: str, checkpoint: str, least: int = 10) -> None:
    """Summaries of the sessions that a batch brought at least ``least`` turns of; a batch written again replaces its own file."""

    def write(batch: DataFrame, number: int) -> None:
        busy = batch.groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("session_id")
        rows = batch.join(busy, "session_id", "left_semi")
        consolidate(rows).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start().awaitTermination()


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there, into a Parquet folder; a second run takes only what is new."""
    query = stream.writeStream.trigger(availableNow=True).outputMode(mode).option("checkpointLocation", checkpoint).option("path", sink).format("parquet").start()
    query.awaitTermination()


def run_counts(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Run a stateful count over all that is there; each batch replaces the counts that it changes in ``sink/batch=n``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.trigger(availableNow=True).outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start().awaitTermination()
