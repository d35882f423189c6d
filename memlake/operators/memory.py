"""States of memories: writes with duplicates, lookups, validation, slots, triples, personas, mirrors, checkpoints.

Every change is a row of a log; a state is the fold of its log, grouped by key, so
it can be computed anew at any time and a retried write changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.facts import version_intervals

ACTIONS = ("attest", "update", "invalidate", "delete")
OPERATIONS = ("remember", "update", "forget", "invalidate")
TIERS = ("permanent", "long_term", "working")


def seen_by(session: Column | str) -> Column:
    """Rows of the session that asks, given as a column, and global ones; other scopes are hidden from all."""
    return ((F.col("scope") == "session") & (F.col("session_id") == session)) | (F.col("scope") == "global")


def lookup(requests: DataFrame, working: DataFrame, episodic: DataFrame) -> DataFrame:
    """``requests(id, asker)`` with the row that each sees: the working one if there is one, else the episodic one."""
    both = working.withColumn("store", F.lit("working")).unionByName(episodic.withColumn("store", F.lit("episodic")), allowMissingColumns=True)
    found = requests.join(both, "id").where(seen_by(F.col("asker")))
    first = Window.partitionBy("id", "asker").orderBy(F.desc("store"))
    return found.withColumn("store_place", F.row_number().over(first)).where("store_place = 1").drop("store_place")


def insert_folding(rows: DataFrame) -> DataFrame:
    """New memories of a session with the same text as one: the highest importance, the newest time and source, the newest known veracity.

    A digest stands for the text while rows are dealt.  ``rows(session_id, content, id,
    importance, timestamp, source, veracity)``.
    """
    keyed = rows.withColumn("digest", F.sha2("content", 256))
    order = F.struct("timestamp", "id")
    known = F.when(F.col("veracity") != "unknown", order)
    return keyed.groupBy("session_id", "digest").agg(
        F.min_by("id", order).alias("id"),
        F.max("importance").alias("importance"),
        F.max("timestamp").alias("timestamp"),
        F.max_by("source", order).alias("source"),
        F.coalesce(F.max_by("veracity", known), F.lit("unknown")).alias("veracity"),
        F.count("*").alias("writes"),
    )


def check_operations(ops: DataFrame) -> DataFrame:
    """``ops`` with ``error``, null for what can be applied: the dry run of a batch."""
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    why = (
        F.when(~F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False)), "unknown operation")
        .when((F.col("op") != "remember") & F.col("id").isNull(), "id is required")
        .when((F.col("op") == "remember") & blank, "content is required")
        .when((F.col("op") == "update") & blank & F.col("importance").isNull(), "nothing to update")
        .when(~F.coalesce(F.col("importance").between(0, 1), F.lit(True)), "importance must be 0 to 1")
    )
    return ops.withColumn("error", why)


def applicable(ops: DataFrame, batch: str = "batch") -> DataFrame:
    """The operations of the batches of which every one can be applied: a batch is applied whole or not at all."""
    bad = check_operations(ops).where("error is not null").select(batch).distinct()
    return ops.join(bad, batch, "left_anti")


def invalidate(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows ``(id, store, session_id, scope, valid_until, superseded_by)`` after ``requests(id, asker, at, replacement)``.

    A request ends the working row of its id if the asker sees it, else the episodic
    one; of several requests for a row the last counts.
    """
    met = rows.select("id", "store", "session_id", "scope").join(requests, "id").where(seen_by(F.col("asker")))
    first = Window.partitionBy("id", "asker", "at").orderBy(F.desc("store"))
    hit = met.withColumn("store_place", F.row_number().over(first)).where("store_place = 1")
    last = hit.groupBy("id", "store").agg(F.max_by(F.struct("at", "replacement"), F.struct("at", "asker")).alias("end"))
    joined = rows.join(last, ["id", "store"], "left")
    changed = F.col("end").isNotNull()
    return joined.withColumn("valid_until", F.when(changed, F.col("end.at")).otherwise(F.col("valid_until"))).withColumn("superseded_by", F.when(changed, F.col("end.replacement")).otherwise(F.col("superseded_by"))).drop("end")


def forget(rows: DataFrame, vectors: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and vectors that are left after ``requests(id, asker)``: what the asker sees goes, and its vector with it."""
    gone = rows.join(requests, "id").where(seen_by(F.col("asker"))).select("id").distinct()
    return rows.join(gone, "id", "left_anti"), vectors.join(gone, "id", "left_anti")


def validations(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows ``(id, content, valid_until)`` after a log ``(seq, id, validator, action, new_content, at)`` of attestations.

    The last validator and time, how many there were, the last new text, the time of
    the last invalidation; deleted rows go, and what is logged after a delete meets nothing.
    """
    end = F.min(F.when(F.col("action") == "delete", F.col("seq"))).over(Window.partitionBy("id"))
    live = log.where(F.col("action").isin(*ACTIONS)).withColumn("end", end).where("end is null or seq <= end")
    state = live.groupBy("id").agg(
        F.max_by("validator", "seq").alias("validator"),
        F.max_by("at", "seq").alias("validated_at"),
        F.count("*").alias("validation_count"),
        F.max_by("new_content", F.when(F.col("action") == "update", F.col("seq"))).alias("new_content"),
        F.max_by("at", F.when(F.col("action") == "invalidate", F.col("seq"))).alias("ended"),
        F.bool_or(F.col("action") == "delete").alias("deleted"),
    )
    joined = rows.join(state, "id", "left").where(~F.coalesce("deleted", F.lit(False)))
    kept = joined.withColumn("content", F.coalesce("new_content", "content")).withColumn("valid_until", F.coalesce("ended", "valid_until"))
    return kept.withColumn("validation_count", F.coalesce("validation_count", F.lit(0))).drop("new_content", "ended", "deleted")


def slot_versions(log: DataFrame, key: list[str]) -> DataFrame:
    """Versions of slots from a log ``(key..., seq, action, body, at)``: a write of the same body makes none, a forget ends the slot.

    ``version`` counts a slot's writes from 1; ``valid_until`` is the next change's time.
    """
    order = Window.partitionBy(*key).orderBy("seq")
    before = F.lag(F.when(F.col("action") == "remember", F.col("body"))).over(order)
    changed = log.where(~((F.col("action") == "remember") & (F.trim("body") == ""))).withColumn("before", before)
    changed = changed.where((F.col("action") == "forget") | F.col("before").isNull() | (F.col("before") != F.col("body")))
    ended = changed.withColumn("valid_until", F.lead("at").over(order)).where("action = 'remember'")
    return ended.withColumn("version", F.row_number().over(order).cast("long")).drop("action", "before")


def live(versions: DataFrame) -> DataFrame:
    return versions.where("valid_until is null")


def search_slots(versions: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Live slots that have the text in name or body, newest first."""
    low = text.lower()
    return live(versions).where(F.contains(F.lower("body"), F.lit(low)) | F.contains(F.lower("name"), F.lit(low))).orderBy(F.desc("at"), F.asc("name"), F.asc("owner_id")).limit(limit)


def task_list(versions: DataFrame, most: int = 200) -> DataFrame:
    """Each owner's tasks and their present states, cut for display."""
    return live(versions).where("category = 'task:progress'").select("owner_id", F.col("name").alias("task"), F.substring("body", 1, most).alias("state"), F.col("at").alias("valid_from"))


def add_triples(log: DataFrame) -> DataFrame:
    """Triples with their ends from a log ``(seq, subject, predicate, object, at, supersede, ends)``.

    An addition that supersedes closes what was open of its subject and predicate; one
    with ``ends`` closes the same triple and adds none.
    """
    slot = Window.partitionBy("subject", "predicate").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("subject", "predicate", "object").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    # The next superseding addition and the next end after each row: sorted backwards, the last one met.
    later = F.last(F.when(F.col("supersede") & ~F.col("ends"), F.struct("seq", "at")), ignorenulls=True).over(slot)
    ended = F.last(F.when(F.col("ends"), F.struct("seq", "at")), ignorenulls=True).over(same)
    rows = log.withColumn("later", later).withColumn("ended", ended).where("not ends")
    first = F.when(F.col("ended").isNull() | (F.col("later.seq") < F.col("ended.seq")), F.col("later.at")).otherwise(F.col("ended.at"))
    return rows.withColumn("valid_until", first).drop("later", "ended")


def personas(log: DataFrame) -> DataFrame:
    """Personas from a log ``(seq, memory_id, action, tier, at)`` of promote, demote and reinforce.

    A demoted one stays as a tombstone, whose tier is ``demoted``; promoting it again
    revives it.  Reinforcement counts since the last promotion.
    """
    start = F.max(F.when(F.col("action") == "promote", F.col("seq"))).over(Window.partitionBy("memory_id"))
    since = log.withColumn("start", start).where("seq >= start")
    state = since.groupBy("memory_id").agg(
        F.max_by("tier", F.when(F.col("action") == "promote", F.col("seq"))).alias("promoted"),
        F.count_if(F.col("action") == "reinforce").alias("reinforcement_count"),
        F.max(F.when(F.col("action") == "reinforce", F.col("at"))).alias("last_reinforced_at"),
        F.bool_or(F.col("action") == "demote").alias("gone"),
    )
    return state.withColumn("tier", F.when(F.col("gone"), "demoted").otherwise(F.col("promoted"))).drop("promoted", "gone")


def persona_order() -> list[Column]:
    """Permanent ones first, then long-term, working and others; the most reinforced first in each."""
    rank = F.lit(len(TIERS))
    for k, tier in enumerate(TIERS):
        rank = F.when(F.col("tier") == tier, k).otherwise(rank)
    return [rank, F.desc("reinforcement_count"), F.asc("memory_id")]


def mirror(entries: DataFrame, mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New mappings and retired ones, from native ``entries(target, native_id, content)`` and ``mapped(target, native_id, digest)``.

    An entry that is mapped with its present text is left alone; one with another text
    retires its mapping and makes a new one; one that is gone retires it.
    """
    now = entries.select("target", "native_id", F.sha2("content", 256).alias("digest")).distinct()
    key = ["target", "native_id", "digest"]
    return now.join(mapped, key, "left_anti"), mapped.join(now, key, "left_anti")


def unconsolidated(working: DataFrame, episodic: DataFrame) -> DataFrame:
    """Working rows that no summary has covered, or one that isn't verified.

    ``episodic(id, summary_of, coverage_version, verified)``; lineage is a comma list of ids.
    """
    open_ids = episodic.where("coverage_version = 1 and not coalesce(verified, false)").select(F.explode(F.split("summary_of", ",")).alias("id")).distinct()
    fresh = working.where("consolidated_at is null")
    return fresh.unionByName(working.where("consolidated_at is not null").join(open_ids, "id", "left_semi"))


def cross_tier(results: DataFrame, episodic: DataFrame) -> DataFrame:
    """Results ``(query_id, id, tier)`` without summaries that aren't verified, nor sources whose summary is among them."""
    bad = episodic.where("coverage_version = 1 and not coalesce(verified, false)").select("id", F.lit("episodic").alias("tier"))
    fine = results.join(bad, ["id", "tier"], "left_anti")
    lines = episodic.select(F.col("id").alias("summary"), F.explode(F.split("summary_of", ",")).alias("id"))
    covered = fine.where("tier = 'episodic'").select("query_id", F.col("id").alias("summary")).join(lines, "summary").select("query_id", "id", F.lit("working").alias("tier")).distinct()
    return fine.join(covered, ["query_id", "id", "tier"], "left_anti")


def expired(rows: DataFrame, now: Column, hours: float) -> DataFrame:
    """Working rows older than their time to live."""
    return rows.where(F.col("timestamp") < now - F.make_dt_interval(hours=F.lit(int(hours))))


def degradation_batch(rows: DataFrame, cutoff: Column, size: int) -> DataFrame:
    """The oldest rows before the cut-off that can still be degraded."""
    return rows.where((F.col("tier") < 3) & (F.col("created_at") < cutoff)).orderBy("created_at", "id").limit(size)


def audit_count(log: DataFrame, visible: Column) -> DataFrame:
    return log.where(visible).agg(F.count("*").alias("n"))


def store_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table, one row a table."""
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def bootstrap(memories: DataFrame, k: int = 10) -> DataFrame:
    """The most important memories, newest first, as a list of where they come from."""
    best = memories.orderBy(F.desc("importance"), F.desc("created_at"), F.asc("id")).limit(max(1, min(100, k)))
    return best.select("id", "importance", F.concat(F.lit("memory:"), "namespace", F.lit("/"), F.col("id").cast("string")).alias("provenance"))


def inspect(rows: DataFrame, most: int = 4000) -> DataFrame:
    """Rows with their text cut, and whether it was."""
    return rows.withColumn("content_truncated", F.length("content") > most).withColumn("content", F.substring("content", 1, most))


def compression_excerpt(messages: DataFrame, last: int = 100, most_bytes: int = 200_000, shown: int = 12, characters: int = 4000) -> DataFrame:
    """``session_id, excerpt``: the last user and assistant messages of a conversation, within bounds of bytes and characters.

    ``messages(session_id, seq, role, content)``.  Of the ``last`` messages, those up to
    the byte bound are usable; of these the last ``shown`` are cut by what is left of
    the characters.  A conversation's bounded end is one row.
    """
    back = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    tail = messages.withColumn("n", F.row_number().over(back)).where(F.col("n") <= last)
    spoken = tail.withColumn("role", F.lower(F.trim("role"))).withColumn("content", F.trim("content")).where(F.col("role").isin("user", "assistant") & (F.col("content") != ""))
    ahead = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    usable = spoken.withColumn("bytes", F.sum(F.octet_length("content")).over(ahead)).where(F.col("bytes") <= most_bytes)
    ends = usable.withColumn("n", F.row_number().over(back)).where(F.col("n") <= shown)
    before = F.coalesce(F.sum(F.length("content")).over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = ends.withColumn("room", F.lit(characters) - before).where("room > 0")
    line = F.concat(F.lit("["), "role", F.lit("] "), F.substring("content", F.lit(1), F.col("room").cast("int")))
    return cut.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("lines")).select("session_id", F.array_join(F.transform("lines", lambda e: e["line"]), "\n").alias("excerpt"))


def checkpoint_keys(evidence: DataFrame) -> DataFrame:
    """``session_id, name``: a name for a session's evidence ``(session_id, seq, role, content)`` made of its content alone.

    The digest is of the messages' digests in order, so no row holds a session's texts.
    """
    one = evidence.select("session_id", "seq", F.sha2(F.to_json(F.struct("content", "role")), 256).alias("d"))
    whole = one.groupBy("session_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "d"))), lambda e: e["d"]), ""), 256).alias("digest"))
    return whole.select("session_id", F.concat(F.sha2(F.col("session_id").cast("string"), 256), F.lit("-"), "digest").alias("name"))


def unwritten(keys: DataFrame, written: DataFrame) -> DataFrame:
    """Checkpoints whose name isn't there yet: equal evidence is never written twice."""
    return keys.join(written.select("name").distinct(), "name", "left_anti")


def history(log: DataFrame, slot: list[str]) -> DataFrame:
    return version_intervals(log, slot, "at", "seq")
