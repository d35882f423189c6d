"""Push and pull between a replica and the store: three-way merge by digests, pages by a cursor.

A change says on which text it was made, by that text's digest.  It is accepted if
the store still has that text (none for a new id), a duplicate if the store has the
change's own text already, and a conflict otherwise.  Changes of one id are judged
in the order of their numbers, each against what the ones before have left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Changes that a pull gives at most.
PAGE = 500


def digest(content: Column | str) -> Column:
    return F.sha2(content, 256)


def judge(changes: DataFrame, store: DataFrame) -> DataFrame:
    """``seq, id, outcome, content, digest`` of ``changes(seq, id, base_digest, content)`` against ``store(id, content)``.

    Outcomes are ``accepted``, ``duplicate`` and ``conflict``.  A change that comes
    twice (one seq and id) is judged once.  A null content counts as empty.  An id's
    changes of one push are folded in one row.
    """
    own = F.struct("seq", "base_digest", F.coalesce("content", F.lit("")).alias("content"), digest(F.coalesce("content", F.lit(""))).alias("digest"))
    pushed = changes.dropDuplicates(["seq", "id"]).groupBy("id").agg(F.sort_array(F.collect_list(own)).alias("changes"))
    held = store.select("id", digest("content").alias("held"))
    met = pushed.join(held, "id", "left")

    def step(state: Column, change: Column) -> Column:
        outcome = F.when(change["digest"].eqNullSafe(state["held"]), "duplicate").when(change["base_digest"].eqNullSafe(state["held"]), "accepted").otherwise("conflict")
        row = F.struct(change["seq"].alias("seq"), outcome.alias("outcome"), change["content"].alias("content"), change["digest"].alias("digest"))
        return F.struct(F.when(outcome == "accepted", change["digest"]).otherwise(state["held"]).alias("held"), F.array_append(state["out"], row).alias("out"))

    start = F.struct(F.col("held"), F.expr("cast(array() as array<struct<seq:bigint,outcome:string,content:string,digest:string>>)").alias("out"))
    return met.select("id", F.explode(F.aggregate("changes", start, step)["out"]).alias("o")).select("o.seq", "id", "o.outcome", "o.content", "o.digest")


def applied(store: DataFrame, judged: DataFrame) -> DataFrame:
    """``store(id, content, seq)`` after the accepted changes, each id with its last one's number."""
    last = judged.where("outcome = 'accepted'").groupBy("id").agg(F.max_by("content", "seq").alias("content"), F.max("seq").alias("seq"))
    return store.join(last.select("id"), "id", "left_anti").select("id", "content", "seq").unionByName(last)


def page(store: DataFrame, cursor: int, limit: int = PAGE) -> DataFrame:
    """The store's rows that changed after the cursor, oldest first, ``PAGE`` at most: the greatest seq is the next cursor."""
    return store.where(F.col("seq") > cursor).orderBy("seq", "id").limit(max(1, min(PAGE, limit)))


def counts(judged: DataFrame) -> DataFrame:
    """One row: how many changes were accepted, duplicates, conflicts, and the greatest number judged."""
    kinds = [F.count_if(F.col("outcome") == k).alias(k) for k in ("accepted", "duplicate", "conflict")]
    return judged.agg(*kinds, F.max("seq").alias("cursor"))


def store_at(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/store/version={version}")


def open_store(store: DataFrame, folder: str) -> None:
    """Write ``store(id, content, seq)`` as the version that the first push is judged against."""
    store.select("id", "content", "seq").write.parquet(f"{folder}/store/version=0")


def run_push(stream: DataFrame, folder: str) -> None:
    """Judge and apply all changes of a stream that are there.

    Batch n is judged against version n of the store and writes version n + 1 and
    ``outcomes/batch=n``, both in place of what is there: a batch that is run again,
    because an executor or the driver was lost, changes nothing a second time.
    """
    spark = stream.sparkSession

    def push(batch: DataFrame, number: int) -> None:
        store = store_at(spark, folder, number)
        judge(batch, store).write.mode("overwrite").parquet(f"{folder}/outcomes/batch={number}")
        applied(store, spark.read.parquet(f"{folder}/outcomes/batch={number}")).write.mode("overwrite").parquet(f"{folder}/store/version={number + 1}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(push).start().awaitTermination()
