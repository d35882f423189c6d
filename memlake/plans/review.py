"""Queries of evidence and of the review ledger, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import scalars as S
from memlake.operators import review as R
from memlake.operators.grading import number
from memlake.plans.scalars import metadata_of
from memlake.sources.tables import events, table, texts, turns


def evidence_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the reference of their metadata, else the event that told them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    reference = S.source_reference(metadata_of(F.col("id"), F.col("source"), F.col("lang")))
    rows = docs.select("id", F.concat_ws("/", reference["session_id"], reference["message_id"]).alias("r"), reference.isNotNull().alias("has")).select("id", F.when(F.col("has"), F.col("r")).alias("reference"))
    told = events(spark, sf_dir).select((F.col("event_id") % 300).alias("id"), F.when(F.col("event_id") % 300 % 4 == 1, "").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("session_id"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("turn_id"))
    return R.with_reference(rows, told)


EVIDENCE_SOURCES = """WITH d AS (SELECT doc_id AS id, doc_id % 11 < 7 AND doc_id % 17 <> 3 AS ok FROM documents), p AS (SELECT event_id % 300 AS id, min(struct_pack(s := 'u' || user_id, t := lpad(CAST(event_id AS VARCHAR), 9, '0'))) AS p FROM events WHERE event_id % 300 % 4 <> 1 GROUP BY 1)
SELECT d.id, CASE WHEN ok THEN 's' || d.id % 10 || '/m' || d.id WHEN p IS NOT NULL THEN p.s || '/' || p.t END AS reference, CASE WHEN ok THEN 'metadata' WHEN p IS NOT NULL THEN 'provenance' END AS source_origin FROM d LEFT JOIN p USING (id)"""


def host_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured turns against a host's messages: ids repeat now and then, and some messages are sent twice."""
    said = turns(spark, sf_dir)
    own = F.concat(F.lit("m"), F.when(F.col("turn") % 5 == 4, F.col("turn") - 1).otherwise(F.col("turn")).cast("string"))
    messages = said.select("session_id", own.alias("message_id"), "role", "content")
    twice = messages.where("session_id % 7 = 3").withColumn("message_id", F.concat("message_id", F.lit("b")))
    return R.host_messages(said, messages.unionByName(twice)).select("session_id", "turn", "role", "message_id")


HOST_REFERENCES = """WITH m AS (SELECT conv_id, 'm' || CASE WHEN turn % 5 = 4 THEN turn - 1 ELSE turn END AS mid, role, text FROM conversations), a AS (SELECT * FROM m UNION ALL SELECT conv_id, mid || 'b', role, text FROM m WHERE conv_id % 7 = 3),
u AS (SELECT conv_id, mid FROM a GROUP BY ALL HAVING count(*) = 1), o AS (SELECT conv_id, role, text, min(mid) AS mid FROM a GROUP BY conv_id, role, text HAVING count(*) = 1)
SELECT c.conv_id AS session_id, turn, c.role, u.mid AS message_id FROM conversations c LEFT JOIN o ON o.conv_id = c.conv_id AND o.role = c.role AND o.text = c.text LEFT JOIN u ON u.conv_id = o.conv_id AND u.mid = o.mid"""


def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).select("id", "content", F.when(F.col("id") % 3 > 0, "s/m").alias("reference"), (F.col("id") % 6 == 0).alias("has_lineage"), (F.col("id") % 13 != 1).alias("metadata_readable"), (F.col("id") % 12 == 0).alias("lineage_lost"))
    return R.review_reasons(rows).select("id", F.array_join("reasons", ",").alias("reasons"))


REVIEW_REASONS = """WITH d AS (SELECT doc_id AS id, length(text) > 4000 AS long, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS p FROM documents), k AS (SELECT *, max(id) FILTER (NOT long AND p <> '') OVER (PARTITION BY CASE WHEN long THEN '' ELSE p END) AS f FROM d)
SELECT * FROM (SELECT id, concat_ws(',', CASE WHEN id % 3 = 0 AND id % 6 <> 0 THEN 'source_unavailable' END, CASE WHEN id % 13 = 1 THEN 'metadata_unreadable' END, CASE WHEN id % 12 = 0 THEN 'originals_unavailable' END, CASE WHEN long THEN 'content_requires_full_read' END,
CASE WHEN NOT long AND p <> '' AND f <> id THEN 'exact_duplicate' END) AS reasons FROM k) WHERE reasons <> ''"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reviews and outcomes: a review is one of a user's values, told again with each repeat."""
    e, i = events(spark, sf_dir), F.col("event_id")
    group = (F.floor(i / 2) % 40).cast("string")
    user = F.col("user_id").cast("string")
    key = F.concat(user, F.lit("-"), group)
    verdict = F.element_at(F.array(*[F.lit(v) for v in R.VERDICTS]), (number(key) % 3 + 1).cast("int"))
    outcome = F.element_at(F.array(*[F.lit(v) for v in R.OUTCOMES]), (i % 3 + 1).cast("int"))
    observed = F.element_at(F.array(*[F.lit(v) for v in R.OBSERVED]), (i % 4 + 1).cast("int"))
    step = F.floor(i / 2) % 40
    return e.select(
        i.alias("seq"),
        F.when(i % 3 == 2, "outcome").otherwise("review").alias("event"),
        F.concat(F.lit("r"), key).alias("review_id"),
        F.when(verdict == "contradicted", F.concat(F.lit("p"), key)).alias("proposal_id"),
        F.col("user_id").alias("memory_id"),
        verdict.alias("verdict"),
        outcome.alias("outcome"),
        observed.alias("observed"),
        step.alias("original_sha256"),
        (step + 1).alias("replacement_sha256"),
        F.col("ts").alias("recorded_at"),
    )


_LEDGER = """lg AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 2 THEN 'outcome' ELSE 'review' END AS event, user_id || '-' || (event_id // 2) % 40 AS k, user_id AS memory_id, ['accepted', 'rejected', 'corrected_again'][event_id % 3 + 1] AS outcome,
['matches_original', 'matches_proposal', 'changed_otherwise', 'missing'][event_id % 4 + 1] AS observed, (event_id // 2) % 40 AS step, ts FROM events),
lv AS (SELECT *, ['supported', 'contradicted', 'insufficient'][CAST('0x' || substr(md5(k), 1, 8) AS BIGINT) % 3 + 1] AS verdict FROM lg), rv AS (SELECT * FROM lv WHERE event = 'review' QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1),
oc AS (SELECT k, arg_max(outcome, seq) AS outcome, arg_max(observed, seq) AS observed FROM lv WHERE event = 'outcome' AND verdict = 'contradicted' GROUP BY k), pp AS (SELECT rv.k, oc.outcome, oc.observed FROM rv LEFT JOIN oc USING (k) WHERE verdict = 'contradicted')"""


def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summarize(_ledger(spark, sf_dir))


REVIEW_SUMMARY = f"""WITH {_LEDGER}, a AS (SELECT count(*) AS reviews, {', '.join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in R.VERDICTS)} FROM rv),
b AS (SELECT count(*) AS proposals, count(outcome) AS decided, {', '.join(f"count(*) FILTER (outcome = '{v}') AS {v}" for v in R.OUTCOMES)}, count(*) FILTER (outcome = 'accepted' AND observed = 'matches_proposal') AS accepted_verified FROM pp)
SELECT *, proposals - decided AS pending, round(proposals / nullif(reviews, 0), 4) AS proposal_rate, round(accepted / nullif(decided, 0), 4) AS acceptance_rate, round(accepted_verified / nullif(decided, 0), 4) AS verified_acceptance_rate, round((rejected + corrected_again) / nullif(decided, 0), 4) AS false_correction_rate FROM a, b"""


def pending_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pending(_ledger(spark, sf_dir), 100)


PENDING_PROPOSALS = f"WITH {_LEDGER} SELECT 'p' || k AS proposal_id, memory_id, verdict, ts AS recorded_at FROM rv WHERE verdict = 'contradicted' AND k NOT IN (SELECT k FROM oc) ORDER BY ts, proposal_id LIMIT 100"


def superseded_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _ledger(spark, sf_dir)
    return R.superseded(ledger, R.first_reviews(ledger).where("seq % 5 = 0"))


SUPERSEDED_PROPOSALS = f"""WITH {_LEDGER} SELECT DISTINCT 'p' || a.k AS proposal_id FROM rv a JOIN rv b ON b.memory_id = a.memory_id AND b.seq % 5 = 0 AND b.k <> a.k AND a.step + 1 = b.step AND a.step <> b.step
WHERE a.verdict = 'contradicted' AND b.verdict = 'contradicted' AND a.k NOT IN (SELECT k FROM oc WHERE outcome = 'corrected_again')"""


def observed_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each text says now, by whether its proposal stands in it, is its copy, or it is gone; with a warning for its outcome."""
    docs = texts(spark, sf_dir)
    i = F.col("id")
    proposals = docs.select(i.alias("memory_id"), F.when(i % 4 == 0, F.sha2("content", 256)).otherwise(F.lit("a")).alias("original_sha256"), F.when(i % 4 == 1, F.sha2("content", 256)).otherwise(F.lit("b")).alias("replacement_sha256"), F.element_at(F.array(*[F.lit(v) for v in R.OUTCOMES]), (i % 3 + 1).cast("int")).alias("outcome"))
    seen = R.observe(proposals, docs.where("id % 9 <> 5"))
    return seen.select("memory_id", "outcome", "observed", R.outcome_warning(F.col("outcome"), F.col("observed")).alias("warning"))


OBSERVED_PROPOSALS = """WITH d AS (SELECT doc_id AS id, ['accepted', 'rejected', 'corrected_again'][doc_id % 3 + 1] AS outcome, CASE WHEN doc_id % 9 = 5 THEN 'missing' WHEN length(text) > 4000 THEN 'changed_otherwise' WHEN doc_id % 4 = 0 THEN 'matches_original' WHEN doc_id % 4 = 1 THEN 'matches_proposal' ELSE 'changed_otherwise' END AS observed FROM documents)
SELECT id AS memory_id, outcome, observed, CASE WHEN outcome = 'accepted' AND observed = 'matches_original' THEN 'accepted, but still the original' WHEN outcome = 'accepted' AND observed IN ('changed_otherwise', 'missing') THEN 'accepted, but not the proposal'
WHEN outcome = 'rejected' AND observed = 'matches_proposal' THEN 'rejected, but already applied' WHEN outcome = 'corrected_again' AND observed = 'matches_original' THEN 'corrected again, but still the original' END AS warning FROM d"""


def _judgments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as cases: a verdict that cites the middle of a turn, sometimes wrongly."""
    said = turns(spark, sf_dir).select(F.col("session_id").alias("case_id"), F.concat_ws("-", F.col("turn").cast("string"), "role").alias("message_id"), "content", "turn")
    c = F.col("case_id")
    first = said.groupBy("case_id").agg(F.min(F.struct("turn", "message_id", "content")).alias("m"))
    quote = F.when(c % 8 == 5, F.lit("never said")).otherwise(F.substring("m.content", 3, 20))
    cited = F.struct(F.when(c % 8 == 4, "none").otherwise(F.col("m.message_id")).alias("message_id"), quote.alias("quote"))
    none = F.array().cast("array<struct<message_id:string,quote:string>>")
    verdict = F.when(c % 8 == 6, "maybe").otherwise(F.element_at(F.array(*[F.lit(v) for v in R.VERDICTS]), (c % 3 + 1).cast("int")))
    replacement = F.when((verdict == "contradicted") & (c % 8 == 1), "same text ").when((verdict == "contradicted") | (c % 8 == 2), "new text")
    return first.select("case_id", verdict.alias("verdict"), F.lit("because").alias("reason"), F.lit("same text").alias("original"), replacement.alias("replacement"), F.when(c % 8 == 3, none).otherwise(F.array(cited)).alias("citations")), said


_JUDGED = """j AS (SELECT conv_id AS c, CASE WHEN conv_id % 8 = 6 THEN 'maybe' ELSE ['supported', 'contradicted', 'insufficient'][conv_id % 3 + 1] END AS verdict FROM conversations GROUP BY 1),
e AS (SELECT *, CASE WHEN verdict = 'maybe' THEN 'invalid verdict or reason' WHEN verdict = 'contradicted' AND c % 8 = 1 THEN 'a contradiction needs another text' WHEN verdict <> 'contradicted' AND c % 8 = 2 THEN 'only a contradiction proposes a text'
WHEN verdict <> 'insufficient' AND c % 8 = 3 THEN 'citations are needed' WHEN c % 8 = 4 THEN 'unknown message' WHEN c % 8 = 5 THEN 'no exact quote' END AS error FROM j)"""


def source_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.check_judgments(*_judgments(spark, sf_dir))


SOURCE_CHECKS = f"WITH {_JUDGED} SELECT c AS case_id, verdict, error FROM e"


def source_check_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = source_checks(spark, sf_dir)
    wanted = F.element_at(F.array(*[F.lit(v) for v in R.VERDICTS]), (F.col("case_id") % 3 + 1).cast("int"))
    results = checked.select(wanted.alias("expected"), (F.col("error").isNull() & (F.col("verdict") == wanted)).alias("passed"), (F.col("error") == "only a contradiction proposes a text").alias("proposal")).fillna(False)
    return R.check_rates(results)


SOURCE_CHECK_RATES = f"""WITH {_JUDGED}, r AS (SELECT ['supported', 'contradicted', 'insufficient'][c % 3 + 1] AS x, error IS NULL AND verdict = ['supported', 'contradicted', 'insufficient'][c % 3 + 1] AS passed, coalesce(error = 'only a contradiction proposes a text', false) AS p FROM e)
SELECT count(*) AS cases, count(*) FILTER (passed) AS passed, round(count(*) FILTER (x = 'contradicted' AND passed) / nullif(count(*) FILTER (x = 'contradicted'), 0), 4) AS correction_pass_rate, round(count(*) FILTER (x <> 'contradicted' AND p) / nullif(count(*) FILTER (x <> 'contradicted'), 0), 4) AS false_proposal_rate FROM r"""

NAMES = "evidence_sources host_references review_reasons review_summary pending_proposals superseded_proposals observed_proposals source_checks source_check_rates".split()
