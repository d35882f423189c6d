"""Generated lives with known truth, probes about them, and the grades of what a surface returns.

A life has slots whose values change by versions; each version is told in one
event.  Everything is drawn by a hash of its numbers, so any engine makes the same
lives, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import column

# Fixed values of the generated lives.
ATTRIBUTES = ("editor", "test runner", "region", "owner", "deadline")
VALUES = ("Vim", "Neovim", "tox", "pytest", "eu-west", "Sunday 02:00 UTC")
KINDS = ("answerable_current", "answerable_historical", "fabricated", "expired", "carried_lesson")
PROBES, STAGES = 10, 4


def number(*parts: Column) -> Column:
    """A number of 32 bits from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def lives(ids: DataFrame) -> DataFrame:
    """``life_id, slot, entity, attribute, version, versions, value, day, ends, text`` of each event; ``ids(life_id)``.

    The ids are few bytes for all that is made of them, so they are dealt over all
    tasks first, each life to one: what is grouped or joined by life stays there.
    """
    parts = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slots = ids.repartition(parts, "life_id").select("life_id", F.explode(F.sequence(F.lit(0), F.lit(len(ATTRIBUTES) - 1))).alias("slot"))
    life, slot = F.col("life_id"), F.col("slot")
    named = slots.withColumn("entity", F.concat(F.lit("unit"), F.substring(F.md5(F.concat_ws(":", life.cast("string"), slot.cast("string")).cast("binary")), 1, 6)))
    named = named.withColumn("attribute", pick(ATTRIBUTES, slot)).withColumn("versions", (1 + number(life, slot, F.lit("n")) % 3).cast("int"))
    told = named.withColumn("version", F.explode(F.sequence(F.lit(0), F.col("versions") - 1)))
    told = told.withColumn("value", pick(VALUES, number(life, slot) + F.col("version"))).withColumn("day", F.col("version") * 30 + number(life, slot, F.col("version")) % 20)
    ends = F.when((F.col("version") == F.col("versions") - 1) & (number(life, slot, F.lit("x")) % 4 == 0), F.col("day") + 10)
    words = F.concat(F.when(F.col("version") > 0, "Correction: the ").otherwise("The "), "attribute", F.lit(" of "), "entity", F.lit(" is "), "value", F.coalesce(F.concat(F.lit(" until day "), ends.cast("string")), F.lit("")), F.lit("."))
    return told.withColumn("ends", ends).withColumn("text", words)


def probes(events: DataFrame) -> DataFrame:
    """``probe_id, life_id, kind, entity, attribute, answers, stale, as_of, split`` of the lives' events: ten of each life.

    Kinds take turns; a slot whose last fact has ended is asked about as expired, one
    that hasn't as current.  Fabricated probes name a unit that is nowhere.
    """
    told = events.groupBy("life_id", "slot", "entity", "attribute").agg(F.sort_array(F.collect_list(F.struct("version", "value"))).alias("v"), F.max("ends").alias("ends"), F.max("day").alias("day"))
    told = told.withColumn("v", F.transform("v", lambda e: e["value"]))
    asked = told.withColumn("turn", F.explode(F.array(F.col("slot"), F.col("slot") + len(ATTRIBUTES))))
    wanted = pick(KINDS, F.col("turn") + F.col("life_id"))
    kind = F.when(wanted.isin("answerable_current", "expired"), F.when(F.col("ends").isNotNull(), "expired").otherwise("answerable_current")).otherwise(wanted)
    rows = asked.withColumn("kind", kind)
    none = F.array().cast("array<string>")
    last = F.element_at("v", -1)
    answers = F.when(F.col("kind").isin("answerable_current", "carried_lesson"), F.array(last)).when(F.col("kind") == "answerable_historical", F.array(F.element_at("v", 1))).otherwise(none)
    stale = F.when(F.col("kind") == "expired", F.array_distinct("v")).when(F.col("kind") == "answerable_current", F.array_except("v", F.array(last))).otherwise(none)
    entity = F.when(F.col("kind") == "fabricated", F.concat(F.lit("z"), "entity", F.lit("z"))).otherwise(F.col("entity"))
    dev = F.when(F.col("life_id") % 5 == 0, "dev").otherwise("heldout")
    return rows.select((F.col("life_id") * PROBES + F.col("turn")).alias("probe_id"), "life_id", "kind", entity.alias("entity"), "attribute", answers.alias("answers"), stale.alias("stale"), (F.col("day") + 40).alias("as_of"), dev.alias("split"))


def recall_life(asked: DataFrame, events: DataFrame, k: int = 5, strict: bool = False) -> DataFrame:
    """``probe_id, rank, text``: a life's events that name the probe's entity or attribute, the former first, newest first.

    ``strict`` returns nothing for an entity that no event of the life has.  Lives are
    generated from ids, by whose size Spark judges them: they are never broadcast.
    """
    met = asked.select("probe_id", "life_id", F.col("entity").alias("named"), F.col("attribute").alias("about")).join(events.select("life_id", "slot", "version", "day", "text").hint("merge"), "life_id")
    hits = F.contains("text", F.col("named")).cast("int") * 2 + F.contains("text", F.col("about")).cast("int")
    met = met.withColumn("score", hits).where("score > 0")
    if strict:
        met = met.withColumn("best", F.max("score").over(Window.partitionBy("life_id", "probe_id"))).where("best >= 2")
    order = Window.partitionBy("life_id", "probe_id").orderBy(F.desc("score"), F.desc("day"), F.asc("slot"), F.asc("version"))
    return met.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("probe_id", "rank", "text")


def normal(text: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(column(text), F.lit("")), r"\s+", " ")))


def contains_term(text: Column | str, needle: Column) -> Column:
    """Whether the text has the needle as a whole term: no letter or digit touches it."""
    quoted = F.replace(normal(needle), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), quoted, F.lit(r"\E(?![\p{L}\p{N}])"))
    return (normal(needle) != "") & F.contains(normal(text), normal(needle)) & F.regexp_like(normal(text), pattern)


def rank_of_first(rows: DataFrame, key: str, hit: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.min(F.when(hit, F.col("rank"))).alias("first"))


def grade(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """What each probe's returned ``rows(probe_id, rank, text)`` are worth, by its kind.

    A row with a stale value counts only if it names the probe's entity; it ranks above
    the current one if its first rank isn't behind it.
    """
    joined = asked.join(rows, "probe_id", "left")
    answer = F.exists("answers", lambda a: contains_term("text", a))
    about = (F.coalesce("entity", F.lit("")) == "") | contains_term("text", F.col("entity"))
    stale = about & F.exists("stale", lambda v: contains_term("text", v))
    per = joined.groupBy("probe_id", "life_id", "kind", "split").agg(
        F.count("rank").alias("returned_rows"),
        F.min(F.when(answer, F.col("rank"))).alias("answer"),
        F.min(F.when(stale, F.col("rank"))).alias("stale_rank"),
        F.count_if(stale).alias("served"),
    )
    asks = F.col("kind").isin("answerable_current", "answerable_historical", "carried_lesson")
    answer_rank = F.when(asks, F.col("answer"))
    return per.select(
        "probe_id",
        "life_id",
        "kind",
        "split",
        "returned_rows",
        (asks & F.col("answer").isNotNull()).alias("answer_hit"),
        answer_rank.alias("answer_rank"),
        F.when(F.col("kind") == "fabricated", F.col("returned_rows")).otherwise(0).alias("fabricated_rows"),
        F.when(F.col("kind") == "expired", F.col("served")).otherwise(0).alias("expired_served"),
        F.coalesce((F.col("kind") == "answerable_current") & (F.col("stale_rank") <= F.col("answer")), F.lit(False)).cast("int").alias("stale_above_current"),
        ((F.col("kind") == "fabricated") & (F.col("returned_rows") > 0)).alias("answered_fabricated"),
    )


def grade_prefetch(asked: DataFrame, contexts: DataFrame) -> DataFrame:
    """The same of one text for each probe, ``contexts(probe_id, context)``: ranks mean nothing here."""
    joined = asked.join(contexts, "probe_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    some = F.trim("context") != ""
    present = some & F.exists("answers", lambda a: contains_term("context", a))
    stale = some & F.exists("stale", lambda v: contains_term("context", v))
    about = (F.coalesce("entity", F.lit("")) == "") | contains_term("context", F.col("entity"))
    asks = ~F.col("kind").isin("fabricated", "expired")
    return joined.select(
        "probe_id",
        "kind",
        (asks & present).alias("answer_present"),
        ((F.col("kind") == "fabricated") & some).alias("fabricated_present"),
        ((F.col("kind") == "expired") & about & stale).alias("expired_present"),
        ((F.col("kind") == "answerable_current") & stale & ~present).alias("stale_present"),
    )


def provenance_entries(contexts: DataFrame) -> DataFrame:
    """``probe_id, at, row, line``: each row of a context with the line of provenance that follows it, else an empty one."""
    lines = contexts.select("probe_id", F.posexplode(F.split("context", "\n")).alias("at", "row"))
    following = F.lead("row").over(Window.partitionBy("probe_id").orderBy("at"))
    line = F.when(F.startswith(F.ltrim("next"), F.lit("learned under ")), F.trim("next")).otherwise("")
    return lines.withColumn("next", F.coalesce(following, F.lit(""))).where(F.startswith("row", F.lit("  ["))).select("probe_id", "at", "row", line.alias("line"))


def grade_provenance(asked: DataFrame, contexts: DataFrame) -> DataFrame:
    """``probe_id, provenance_present, provenance_lines, wrong_model`` of probes with the ``model_a`` that told the lesson."""
    found = asked.join(provenance_entries(contexts), "probe_id", "left")
    model = F.regexp_extract("line", r"learned under model (.+?)(?:, (?:engine|agent) |, \d{4}-)", 1)
    has = F.coalesce(F.col("line"), F.lit("")) != ""
    own = has & contains_term("row", F.element_at("answers", 1))
    return found.groupBy("probe_id").agg(F.coalesce(F.bool_or(own), F.lit(False)).alias("provenance_present"), F.count_if(has).alias("provenance_lines"), F.count_if(has & (model != "") & (F.trim(model) != F.col("model_a"))).alias("wrong_model"))


def summarize(grades: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of grades, the counts of each kind and over kinds."""
    is_kind = lambda *k: F.col("kind").isin(*k)
    answerable = is_kind("answerable_current", "answerable_historical")
    rate = lambda hit, of: F.round(F.try_divide(F.count_if(hit & of).cast("double"), F.count_if(of).cast("double")), 6)
    out = [F.count("*").alias("probes")]
    for kind in KINDS:
        out += [F.count_if(is_kind(kind)).alias(f"{kind}_probes"), F.count_if(is_kind(kind) & F.col("answer_hit")).alias(f"{kind}_hits"), F.coalesce(F.sum(F.when(is_kind(kind), F.col("returned_rows"))), F.lit(0)).alias(f"{kind}_returned")]
    return grades.groupBy(*by).agg(
        *out,
        rate(F.col("answer_hit"), answerable).alias("answerable_recall"),
        rate(F.col("answer_hit"), is_kind("carried_lesson")).alias("lesson_recall"),
        F.count_if(F.col("answered_fabricated")).alias("fabricated_with_rows"),
        F.sum("fabricated_rows").alias("fabricated_rows"),
        F.sum("expired_served").alias("expired_served"),
        F.count_if(F.col("expired_served") > 0).alias("expired_probes_served"),
        F.sum("stale_above_current").alias("stale_above_current"),
    )


def cohorts(asked: DataFrame, staged: DataFrame) -> DataFrame:
    """``probe_id, cohort``: the first stage with an event that answers the current-truth probe."""
    current = asked.where("kind = 'answerable_current'")
    met = current.join(staged.select("life_id", "entity", "attribute", "value", "stage").hint("merge"), ["life_id", "entity", "attribute"]).where(F.array_contains("answers", F.col("value")))
    return met.groupBy("probe_id").agg(F.min("stage").alias("cohort"))


def stage_drop(matrix: DataFrame) -> DataFrame:
    """``stage, cohort, recall, fallen``: recall by ``matrix(stage, cohort, recall)`` and how far it fell since the cohort's own stage."""
    first = matrix.where("stage = cohort").select("cohort", F.col("recall").alias("initial"))
    return matrix.join(first, "cohort", "left").select("stage", "cohort", "recall", F.round(F.col("initial") - F.col("recall"), 6).alias("fallen"))


def secrets_stored(planted: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ``planted(secret_id, secret, token)`` those that a text has to the letter, but for case.

    Secrets and texts meet by a token that a text must have to hold the secret, so no
    text is compared with every secret; tokens move with a hash of their text, and only
    texts that have a secret's token are looked at again.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    keyed = texts.select("content", F.xxhash64("content").alias("_key"))
    held = keyed.select("_key", F.explode(words).alias("token")).join(planted.hint("merge"), "token").select("_key", "secret_id", "secret")
    met = held.join(keyed, "_key").where(F.contains(F.lower("content"), F.lower("secret"))).select("secret_id").distinct().withColumn("stored", F.lit(True))
    return planted.select("secret_id").distinct().join(met.hint("merge"), "secret_id", "left").agg(F.count("*").alias("planted"), F.count("stored").alias("stored"))


def verdicts(candidate: DataFrame, baseline: DataFrame, secrets: DataFrame) -> DataFrame:
    """One row: what a candidate's summary costs in recall, and which goals it meets."""
    c = candidate.select(F.col("answerable_recall").alias("recall"), "fabricated_with_rows", "expired_served")
    joined = c.crossJoin(F.broadcast(baseline.select(F.col("answerable_recall").alias("before")))).crossJoin(F.broadcast(secrets))
    cost = F.round((F.col("before") - F.col("recall")) * 100, 4)
    none = (F.col("fabricated_with_rows") == 0) & F.coalesce(cost <= 1.0, F.lit(True))
    return joined.select(cost.alias("recall_cost"), none.alias("fabricated_zero"), (F.col("expired_served") == 0).alias("expired_zero"), (F.col("stored") == 0).alias("secrets_zero"))


def composite(active: Column, over_returned: Column, missing: Column) -> Column:
    """A research run's score: 100 for each pass, less what was returned too much and ten times what was missing."""
    return active * 100 - over_returned - 10 * missing
