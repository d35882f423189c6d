"""Scalar expressions over lines, dates, identifiers and metadata kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.text import column, single_line

#: Longest metadata that is read; longer ones count as unreadable.
MOST_METADATA = 32_768
LABEL_CHARACTERS, LABEL_TOKENS, MOST_ALIASES = 512, 16, 64
IDENTIFIER_CHARACTERS = 256
LABEL_SCHEMA = "canonical_name string, aliases array<string>"
REFERENCE_SCHEMA = "source_ref struct<session_id:string,message_id:string,origin:string,message_id_namespace:string>"
PROVENANCE_SCHEMA = "provenance struct<model:string,engine_version:string,agent_version:string,recorded_at:string>"


def norm_line(text: Column | str) -> Column:
    """Lower case, white space collapsed, without the brackets and parentheses that lead the line."""
    bare = F.regexp_replace(F.trim(column(text)), r"^\s*(?:(?:\[[^\]]*\]|\([^)]*\))\s*)+", "")
    return F.lower(single_line(bare))


def word_truncate(text: Column | str, limit: int) -> Column:
    """At most ``limit`` characters and three dots; cut at the last space if that keeps half; 0 for no limit."""
    text = column(text)
    if limit <= 0:
        return text
    cut = F.rtrim(F.substring(text, 1, limit))
    last = F.length(cut) - F.locate(" ", F.reverse(cut))
    bounded = F.when((F.locate(" ", F.reverse(cut)) > 0) & (last >= max(1, limit // 2)), F.rtrim(F.substring(cut, F.lit(1), last))).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(bounded, F.lit("...")))


def correction_bonus(text: Column | str, bonus: float = 0.05) -> Column:
    """A small bonus for a text that says, after labels of its speaker, that it corrects something."""
    lead = r"(?i)^\s*(?:\[[a-z]+\]\s*|[a-z_]+:\s*)*"
    return F.when(F.regexp_like(column(text), F.lit(lead + r"(?:(?:correction|update|to correct)\b[\s,:]+|actually[\s,:]+)")), bonus).otherwise(0.0)


def recency_bonus(query_tokens: Column, content_tokens: Column, bonus: float = 0.05) -> Column:
    """A bonus where the query asks for the present state and the text speaks of it; the amount is this library's own."""
    # Words of a question about the present state, and of an answer.
    asks = F.array(*[F.lit(w) for w in ("current", "currently", "latest", "now", "newer")])
    says = F.array(*[F.lit(w) for w in ("current", "currently", "latest", "newer", "updated")])
    return F.when(F.arrays_overlap(query_tokens, asks) & F.arrays_overlap(content_tokens, says), bonus).otherwise(0.0)


def utc_date(seconds: Column | str) -> Column:
    """The day of a Unix time; null for what is no time of the years 1 to 9999."""
    x = column(seconds)
    fine = x.isNotNull() & ~F.isnan(x) & (x >= -62_135_596_800) & (x < 253_402_300_800)
    return F.when(fine, F.to_date(F.timestamp_seconds(F.when(fine, x).otherwise(0))))


def days_since(moment: Column | str, start: str) -> Column:
    """Whole days from a fixed UTC moment to an ISO one; null if it can't be read."""
    return F.floor((F.unix_timestamp(F.try_to_timestamp(column(moment))) - F.unix_timestamp(F.to_timestamp(F.lit(start)))) / 86_400).cast("long")


def age_hours(moment: Column | str, now: str) -> Column:
    return (F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(F.try_to_timestamp(column(moment)))) / 3600


def minute_stamp(moment: Column | str) -> Column:
    """The date, hour and minute of an ISO time."""
    return F.substring(column(moment), 1, 16)


def hash_split(identifier: Column | str) -> Column:
    """``fit`` or ``held`` by the last bit of the identifier's SHA-256: the same on every run."""
    last = F.substring(F.sha2(column(identifier).cast("string").cast("binary"), 256), 64, 1)
    return F.when(F.conv(last, 16, 10).cast("int") % 2 == 0, "fit").otherwise("held")


def occurrences(text: Column | str, marker: str) -> Column:
    text = column(text)
    return ((F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("long")


def token_estimate(text: Column | str) -> Column:
    """About a token for four characters."""
    return F.floor((F.length(column(text)) + 3) / 4).cast("long")


def identifier(value: Column | str, most: int = IDENTIFIER_CHARACTERS) -> Column:
    """The value if it can name something: not blank, not too long, no control characters; else null."""
    value = column(value)
    return F.when((F.trim(value) != "") & (F.length(value) <= most) & ~F.regexp_like(value, F.lit(r"[\x00-\x1f\x7f]")), value)


def json_object(text: Column | str) -> Column:
    """The text if it is a JSON object of bearable length, else null."""
    text = column(text)
    return F.when((F.length(text) <= MOST_METADATA) & (F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")), text)


def json_merge(base: Column | str, patch: Column | str) -> Column:
    """The base object with the patch's members in place of its own; a base that is no object stays as it is."""
    base, patch = column(base), column(patch)
    kind = "map<string,variant>"
    both = F.map_concat(F.map_filter(F.from_json(json_object(base), kind), lambda k, _: ~F.map_contains_key(F.from_json(patch, kind), k)), F.from_json(patch, kind))
    return F.when(json_object(base).isNull() & base.isNotNull(), base).otherwise(F.coalesce(F.to_json(both), patch))


def labels(metadata: Column | str) -> Column:
    """The canonical name and aliases of metadata, in order; those that are empty or too long are left out."""
    parsed = F.from_json(json_object(metadata), LABEL_SCHEMA)
    words = lambda t: F.regexp_count(t, F.lit(r"[\p{L}\p{N}]+"))
    usable = lambda t: t.isNotNull() & (F.length(t) <= LABEL_CHARACTERS) & words(t).between(1, LABEL_TOKENS)
    aliases = F.when(F.size(parsed["aliases"]) <= MOST_ALIASES, parsed["aliases"])
    none = F.array().cast("array<string>")
    return F.filter(F.concat(F.array(parsed["canonical_name"]), F.coalesce(aliases, none)), usable)


def source_reference(metadata: Column | str) -> Column:
    """``session_id, message_id, origin, namespace`` of metadata, or null; what it says of its origin proves nothing."""
    found = F.from_json(json_object(metadata), REFERENCE_SCHEMA)["source_ref"]
    session, message = identifier(found["session_id"]), identifier(found["message_id"])
    origin = F.when(found["origin"] == "host", "host").otherwise("caller")
    space = F.when(found["message_id_namespace"].isin("platform", "internal"), found["message_id_namespace"])
    return F.when(session.isNotNull() & message.isNotNull(), F.struct(session.alias("session_id"), message.alias("message_id"), origin.alias("origin"), space.alias("namespace")))


def provenance_line(metadata: Column | str) -> Column:
    """One line on the model and versions that a row was learned under, empty parts left out; null without any."""
    found = F.from_json(json_object(metadata), PROVENANCE_SCHEMA)["provenance"]
    part = lambda name: identifier(F.trim(found[name]))
    engine = F.when(part("engine_version") != "unknown", part("engine_version"))
    line = F.concat_ws(", ", F.concat(F.lit("model "), part("model")), F.concat(F.lit("engine "), engine), F.concat(F.lit("agent "), part("agent_version")), F.substring(part("recorded_at"), 1, 10))
    return F.when(line != "", F.concat(F.lit("learned under "), line))
