"""Consolidation of working memories into summaries, and degradation of old ones by tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import column, key_tokens, single_line, truncate

SEPARATOR = " | "
LEAST_IMPORTANCE = 0.25
#: Sources of one summary: a session of more has several, numbered by ``part``.
MOST_SOURCES = 200
#: What a memory's truth rests on, the most careful one first: of equally many the first counts.
CAUTION = ("unknown", "imported", "tool", "inferred", "stated")
#: Limits beyond which labels count as none that can be read.
MOST_METADATA, MOST_LABEL, MOST_ALIASES = 65_536, 512, 64


def in_parts(rows: DataFrame, key: str = "session_id", order: str = "seq", most: int = MOST_SOURCES) -> DataFrame:
    """The rows with ``part``: each ``most`` of a key's rows in their order, from 0."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order, "id"))
    return rows.withColumn("part", F.floor((place - 1) / most).cast("int"))


def consolidate(rows: DataFrame, key: str = "session_id", order: str = "seq", most: int = MOST_SOURCES) -> DataFrame:
    """Summaries of each group of ``rows(key, seq, id, content, valid_until, scope)``, one for each ``most`` of its rows.

    Keyless: a summary is the sources joined in order.  It holds until the first
    source's end and is global only if all of them are.  Only ``most`` sources meet in
    one row, however many a session has.
    """
    packed = F.sort_array(F.collect_list(F.struct(F.col(order), "id", single_line("content").alias("line"))))
    grouped = in_parts(rows, key, order, most).groupBy(key, "part").agg(packed.alias("_s"), F.min("valid_until").alias("valid_until"), F.bool_and(F.col("scope") == "global").alias("_global"), F.count("*").alias("sources"))
    return grouped.select(
        key,
        "part",
        F.array_join(F.transform("_s", lambda e: e["line"]), SEPARATOR).alias("summary"),
        F.transform("_s", lambda e: e["id"]).alias("summary_of"),
        "valid_until",
        F.when(F.col("_global"), "global").otherwise("session").alias("scope"),
        "sources",
    )


def veracity(rows: DataFrame, key: str = "session_id", order: str = "seq", most: int = MOST_SOURCES, caution: Sequence[str] = CAUTION) -> DataFrame:
    """``key, part, veracity``: the label that most of a summary's sources have; of equally many the more careful one.

    Labels are counted before they move.  Null and unknown labels count as the most careful one.
    """
    label = F.when(F.lower("veracity").isin(*caution), F.lower("veracity")).otherwise(caution[0])
    counts = in_parts(rows, key, order, most).groupBy(key, "part", label.alias("label")).agg(F.count("*").alias("n"))
    careful = -F.array_position(F.array(*map(F.lit, caution)), F.col("label"))
    return counts.groupBy(key, "part").agg(F.max_by("label", F.struct("n", careful)).alias("veracity"))


def normal_text(text: Column | str) -> Column:
    """Lower case, white space collapsed."""
    return F.lower(single_line(F.coalesce(column(text), F.lit(""))))


def shared_labels(metadata: Column | str) -> Column:
    """``name, aliases`` of metadata, aliases without order of their own; null if they can't be read or are beyond the limits.

    No metadata is an empty object.  A name must be text, aliases a list of texts.
    """
    raw = F.when(F.coalesce(column(metadata), F.lit("")) == "", F.lit("{}")).otherwise(column(metadata))
    parsed = F.try_parse_json(raw)
    name, aliases = F.try_variant_get(parsed, "$.canonical_name", "variant"), F.try_variant_get(parsed, "$.aliases", "variant")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    names = F.try_variant_get(parsed, "$.aliases", "array<string>")
    text = F.try_variant_get(parsed, "$.canonical_name", "string")
    fine = F.startswith(kind(parsed), F.lit("OBJECT")) & (F.length(raw) <= MOST_METADATA) & kind(name).isin("VOID", "STRING") & (F.coalesce(F.length(text), F.lit(0)) <= MOST_LABEL)
    listed = kind(aliases).isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>") & (F.coalesce(F.size(names), F.lit(0)) <= MOST_ALIASES) & ~F.coalesce(F.exists(names, lambda a: F.length(a) > MOST_LABEL), F.lit(False))
    return F.when(fine & listed, F.struct(text.alias("name"), names.alias("aliases")))


def covered(summaries: DataFrame, rows: DataFrame, key: str = "session_id", order: str = "seq", most: int = MOST_SOURCES) -> DataFrame:
    """``key, part, verified``: whether each summary says just what its sources say.

    It is if, but for case, white space and what stands in ``<think>``, its text is
    the sources' in order, none of them empty; if these have one end and one scope;
    and if they have the same labels, each of which the summary says.  ``rows`` may
    have ``metadata``.  Texts are compared by their digests, ends, scopes and labels
    by their least and greatest, so only ``most`` lines meet in one row.
    """
    own = in_parts(rows, key, order, most).withColumn("_line", normal_text("content"))
    own = own.withColumn("_labels", shared_labels("metadata") if "metadata" in rows.columns else F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<string>").alias("aliases")))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), "id", "_line"))), lambda e: e["_line"]), SEPARATOR)
    scope = F.coalesce(F.nullif("scope", F.lit("")), F.lit("session"))
    one = lambda c: (F.min(c).eqNullSafe(F.max(c))) & F.count(c).isin(0, F.count("*"))
    labels = F.to_json("_labels", {"ignoreNullFields": "false"})
    checks = own.groupBy(key, "part").agg(
        F.sha2(lines, 256).alias("_digest"),
        (F.count_if(F.col("_line") == "") == 0).alias("_said"),
        one(F.col("valid_until")).alias("_one_end"),
        (F.min(scope) == F.max(scope)).alias("_one_scope"),
        ((F.count("_labels") == F.count("*")) & (F.min(labels) == F.max(labels))).alias("_one_label"),
        F.first("_labels", ignorenulls=True).alias("_labels"),
    )
    text = F.trim(F.regexp_replace("summary", r"(?s)<think>.*?</think>", ""))
    met = summaries.select(key, "part", normal_text(text).alias("_text")).join(checks, [key, "part"])
    needed = F.filter(F.concat(F.array(F.col("_labels.name")), F.coalesce(F.col("_labels.aliases"), F.expr("cast(array() as array<string>)"))), lambda x: F.coalesce(x, F.lit("")) != "")
    says = F.forall(needed, lambda x: F.contains(F.col("_text"), normal_text(x)))
    same = (F.sha2("_text", 256) == F.col("_digest")) & F.col("_said") & F.col("_one_end") & F.col("_one_scope") & F.col("_one_label") & says
    return met.select(key, "part", F.coalesce(same, F.lit(False)).alias("verified"))


def demote(rows: DataFrame) -> DataFrame:
    """Sources of a verified summary count for no more than the least importance."""
    return rows.withColumn("importance", F.least("importance", F.lit(LEAST_IMPORTANCE)))


def degrade(rows: DataFrame, first: int = 800, second: int = 300) -> DataFrame:
    """Tier 1 to 2 and 2 to 3 by shortening; a step that would lose a key token is refused.

    Key tokens have a digit or a capital and are compared without case.  The copy's
    id is a digest of its parent's and the tier; its text is null if refused.
    """
    limit = F.when(F.col("tier") == 1, first).otherwise(second)
    short = F.when(F.col("tier") == 1, truncate(single_line("content"), first)).otherwise(truncate(single_line("content"), second))
    step = rows.where(F.col("tier") < 3).withColumn("short", short).withColumn("limit", limit)
    lost = F.size(F.array_except(key_tokens("content", folded=True), key_tokens("short", folded=True)))
    return step.select(
        "id",
        (F.col("tier") + 1).alias("tier"),
        F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit("|"), (F.col("tier") + 1).cast("string")), 256), 1, 32).alias("copy_id"),
        F.length("short").cast("long").alias("size"),
        lost.cast("long").alias("lost_keys"),
        (lost == 0).alias("accepted"),
        F.when(lost == 0, F.col("short")).alias("copy"),
    )
