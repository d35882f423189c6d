"""Evidence of memories and the ledger of their reviews: references, verdicts, outcomes, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import single_line

VERDICTS = ("supported", "contradicted", "insufficient")
OUTCOMES = ("accepted", "rejected", "corrected_again")
OBSERVED = ("matches_original", "matches_proposal", "changed_otherwise", "missing")
MOST_CHARACTERS = 4000


def with_reference(rows: DataFrame, provenance: DataFrame) -> DataFrame:
    """Rows ``(id, reference, ...)`` with the reference of their metadata, else that of ``provenance(id, session_id, turn_id)``.

    ``source_origin`` tells which it is.  Of several provenance rows the first turn counts.
    """
    usable = provenance.where("trim(session_id) <> '' and trim(turn_id) <> ''")
    first = usable.groupBy("id").agg(F.min(F.struct("session_id", "turn_id")).alias("p"))
    joined = rows.join(first, "id", "left")
    origin = F.when(F.col("reference").isNotNull(), "metadata").when(F.col("p").isNotNull(), "provenance")
    found = F.coalesce("reference", F.when(F.col("p").isNotNull(), F.concat_ws("/", "p.session_id", "p.turn_id")))
    return joined.withColumns({"source_origin": origin, "reference": found}).drop("p")


def host_messages(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """Captured ``turns(session_id, turn, role, content)`` with the id of the one host message they are a copy of.

    ``messages(session_id, message_id, role, content)``; null where none or several have
    the role and text, or where the session uses the id twice.
    """
    key = ["session_id", "role", "digest"]
    said = messages.withColumn("digest", F.sha2("content", 256))
    unique = said.groupBy("session_id", "message_id").agg(F.count("*").alias("uses")).where("uses = 1 and trim(message_id) <> ''").drop("uses")
    one = said.groupBy(*key).agg(F.count("*").alias("n"), F.min("message_id").alias("message_id")).where("n = 1").drop("n").join(unique, ["session_id", "message_id"], "left_semi")
    return turns.withColumn("digest", F.sha2("content", 256)).join(one, key, "left").drop("digest")


def review_reasons(rows: DataFrame) -> DataFrame:
    """``id, reasons`` of rows that want a look: no source, unreadable metadata, lost originals, a long text, a copy of an earlier one.

    ``rows(id, content, reference, has_lineage, metadata_readable, lineage_lost)``.  Copies
    are told by a digest of the text without case and white space; a long text's
    digest says nothing.
    """
    long = F.length("content") > MOST_CHARACTERS
    plain = F.lower(single_line(F.coalesce("content", F.lit(""))))
    keyed = rows.withColumn("long", F.coalesce(long, F.lit(False))).withColumn("digest", F.when((plain != "") & ~F.coalesce(long, F.lit(False)), F.sha2(plain, 256)))
    first = keyed.where("digest is not null").groupBy("digest").agg(F.max("id").alias("first"))
    marked = keyed.join(first, "digest", "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("reference").isNull() & ~F.col("has_lineage"), "source_unavailable"),
            F.when(~F.col("metadata_readable"), "metadata_unreadable"),
            F.when(F.col("lineage_lost"), "originals_unavailable"),
            F.when(F.col("long"), "content_requires_full_read"),
            F.when(F.col("first") != F.col("id"), "exact_duplicate"),
        )
    )
    return marked.select("id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def first_reviews(ledger: DataFrame) -> DataFrame:
    """Each review once, as first recorded: a repeated check is the same review."""
    order = Window.partitionBy("review_id").orderBy("seq")
    return ledger.where("event = 'review'").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def latest_outcomes(ledger: DataFrame) -> DataFrame:
    """The last outcome of each proposal."""
    return ledger.where("event = 'outcome'").groupBy("proposal_id").agg(F.max_by(F.struct("outcome", "observed"), "seq").alias("last")).select("proposal_id", "last.outcome", "last.observed")


def summarize(ledger: DataFrame) -> DataFrame:
    """One row of counts and rates, null where there is nothing to rate."""
    reviews = first_reviews(ledger)
    proposals = reviews.where("proposal_id is not null").select("proposal_id").distinct().join(latest_outcomes(ledger), "proposal_id", "left")
    counted = reviews.agg(F.count("*").alias("reviews"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    accepted = F.col("outcome") == "accepted"
    decided = proposals.agg(
        F.count("*").alias("proposals"),
        F.count("outcome").alias("decided"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
        F.count_if(accepted & (F.col("observed") == "matches_proposal")).alias("accepted_verified"),
    )
    rate = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 4)
    joined = counted.crossJoin(F.broadcast(decided))
    return joined.select(
        "*",
        (F.col("proposals") - F.col("decided")).alias("pending"),
        rate(F.col("proposals"), F.col("reviews")).alias("proposal_rate"),
        rate(F.col("accepted"), F.col("decided")).alias("acceptance_rate"),
        rate(F.col("accepted_verified"), F.col("decided")).alias("verified_acceptance_rate"),
        rate(F.col("rejected") + F.col("corrected_again"), F.col("decided")).alias("false_correction_rate"),
    )


def pending(ledger: DataFrame, limit: int = 20) -> DataFrame:
    """Proposals without an outcome, the oldest first."""
    order = Window.partitionBy("proposal_id").orderBy("seq")
    own = ledger.where("event = 'review' and proposal_id is not null").withColumn("n", F.row_number().over(order)).where("n = 1")
    left = own.join(latest_outcomes(ledger).select("proposal_id"), "proposal_id", "left_anti")
    return left.select("proposal_id", "memory_id", "verdict", "recorded_at").orderBy("recorded_at", "proposal_id").limit(limit)


def superseded(ledger: DataFrame, added: DataFrame) -> DataFrame:
    """``proposal_id`` of earlier contradictions whose replacement a new contradiction of the same memory starts from.

    They were applied and are corrected again; those known as such are left out.
    """
    prior = first_reviews(ledger).where("verdict = 'contradicted'").select("memory_id", F.col("review_id").alias("prior_review"), "proposal_id", F.col("replacement_sha256").alias("applied"))
    new = added.where("verdict = 'contradicted'").select("memory_id", "review_id", "original_sha256", "replacement_sha256")
    met = prior.join(new, "memory_id").where("prior_review <> review_id and applied = original_sha256 and applied <> replacement_sha256")
    known = latest_outcomes(ledger).where("outcome = 'corrected_again'").select("proposal_id")
    return met.select("proposal_id").distinct().join(known, "proposal_id", "left_anti")


def observe(proposals: DataFrame, memories: DataFrame) -> DataFrame:
    """Proposals with what their memory says now: the original, the proposal, something else, or nothing."""
    now = memories.select(F.col("id").alias("memory_id"), F.when(F.length("content") <= MOST_CHARACTERS, F.sha2("content", 256)).otherwise("long").alias("digest"))
    joined = proposals.join(now, "memory_id", "left")
    seen = F.when(F.col("digest").isNull(), "missing").when(F.col("digest") == F.col("original_sha256"), "matches_original").when(F.col("digest") == F.col("replacement_sha256"), "matches_proposal").otherwise("changed_otherwise")
    return joined.withColumn("observed", seen).drop("digest")


def outcome_warning(outcome: Column, observed: Column) -> Column:
    """What an outcome claims that the memory doesn't bear out; null if it does."""
    return (
        F.when((outcome == "accepted") & (observed == "matches_original"), "accepted, but still the original")
        .when((outcome == "accepted") & observed.isin("changed_otherwise", "missing"), "accepted, but not the proposal")
        .when((outcome == "rejected") & (observed == "matches_proposal"), "rejected, but already applied")
        .when((outcome == "corrected_again") & (observed == "matches_original"), "corrected again, but still the original")
    )


def check_judgments(judgments: DataFrame, messages: DataFrame) -> DataFrame:
    """``judgments(case_id, verdict, reason, original, replacement, citations)`` with ``error``, null for those that hold.

    Citations are ``(message_id, quote)``; each must be a literal part of a message
    ``(case_id, message_id, content)`` of its case.
    """
    cited = judgments.select("case_id", F.explode("citations").alias("c")).select("case_id", "c.message_id", "c.quote")
    found = cited.join(messages.select("case_id", "message_id", "content"), ["case_id", "message_id"], "left")
    wrong = found.groupBy("case_id").agg(F.bool_or(F.col("content").isNull()).alias("unknown"), F.bool_or((F.trim("quote") == "") | ~F.coalesce(F.contains("content", F.col("quote")), F.lit(True))).alias("inexact"))
    joined = judgments.join(wrong, "case_id", "left")
    contradicted, blank = F.col("verdict") == "contradicted", F.trim(F.coalesce("replacement", F.lit(""))) == ""
    error = (
        F.when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)) | (F.trim(F.coalesce("reason", F.lit(""))) == ""), "invalid verdict or reason")
        .when(contradicted & (blank | (F.trim("replacement") == F.trim("original"))), "a contradiction needs another text")
        .when(~contradicted & F.col("replacement").isNotNull(), "only a contradiction proposes a text")
        .when((F.col("verdict") != "insufficient") & (F.size("citations") == 0), "citations are needed")
        .when(F.coalesce("unknown", F.lit(False)), "unknown message")
        .when(F.coalesce("inexact", F.lit(False)), "no exact quote")
    )
    return joined.select("case_id", "verdict", error.alias("error"))


def check_rates(results: DataFrame) -> DataFrame:
    """One row: cases, passes, the share of contradictions that passed and of the others that got a proposal."""
    wrong = F.col("expected") == "contradicted"
    rate = lambda a, b: F.round(F.try_divide(F.count_if(a).cast("double"), F.count_if(b).cast("double")), 4)
    return results.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), rate(wrong & F.col("passed"), wrong).alias("correction_pass_rate"), rate(~wrong & F.col("proposal"), ~wrong).alias("false_proposal_rate"))
