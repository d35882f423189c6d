"""Queries of writers' cases, precise recall, rehearsals and predictions, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import evaluate
from memlake.operators import scoring as S
from memlake.operators.grading import composite
from memlake.plans.grading import _BOTH, _grades
from memlake.sources.tables import events, table, texts


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def scope_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results of kind relation: their suppliers that are current and in one of the wanted regions."""
    items = table(spark, sf_dir, "lineitem")
    relations = items.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("participants"))
    i = F.col("s_suppkey")
    beliefs = table(spark, sf_dir, "supplier").select(i.alias("id"), F.array((F.col("s_nationkey") % 5).cast("string"), F.lit("all")).alias("scope"), F.when(i % 7 == 0, "x").otherwise("").alias("superseded_by"), F.when(i % 11 == 3, "done").alias("resolved_at"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.array((F.col("o_custkey") % 6).cast("string")).alias("scope"), F.col("o_orderkey").alias("id"))
    excluded = items.where("l_linenumber = 1").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("id")).distinct()
    return S.expand_in_scope(orders, relations, beliefs, excluded)


SCOPE_RELATIONS = """SELECT DISTINCT o_orderkey AS query_id, s_suppkey AS id FROM orders JOIN lineitem l ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
WHERE s_nationkey % 5 = o_custkey % 6 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 3 AND NOT EXISTS (SELECT 1 FROM lineitem f WHERE f.l_orderkey = o_orderkey AND f.l_linenumber = 1 AND f.l_suppkey = l.l_suppkey)"""


def precision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases: parts wanted, pinned, allowed and forbidden by their line and key."""
    items = table(spark, sf_dir, "lineitem")
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    of = lambda c: F.coalesce(F.collect_set(F.when(c, p)), F.array().cast("array<bigint>"))
    cases = items.groupBy("l_orderkey").agg(of(n <= 2).alias("expected"), of((n == 2) & (p % 3 == 0)).alias("pinned"), of((n == 3) & (p % 4 == 0)).alias("forbidden"), of((n == 3) & (p % 4 == 1)).alias("allowed"), of((n == 1) | (n == 3) | (p % 2 == 0)).alias("got"))
    return S.precision_summary(cases)


PRECISION_SUMMARY = """WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS n FROM lineitem), s AS (SELECT o, p, bool_or(n <= 2) AS e, bool_or(n = 2 AND p % 3 = 0) AS pin, bool_or(n = 3 AND p % 4 = 0) AS f, bool_or(n = 3 AND p % 4 = 1) AS a, bool_or(n IN (1, 3) OR p % 2 = 0) AS g FROM l GROUP BY ALL),
c AS (SELECT o, count(*) FILTER (e AND NOT pin AND NOT g) AS missing, count(*) FILTER (g AND NOT e AND NOT pin AND NOT a) AS extra, count(*) FILTER (g AND f) AS forbidden, count(*) FILTER (g AND e AND NOT pin) AS hit, count(*) FILTER (g) AS got, count(*) FILTER (e AND NOT pin) AS wanted FROM s GROUP BY o)
SELECT count(*) AS cases, count(*) FILTER (missing = 0 AND extra = 0 AND forbidden = 0) AS passes, CAST(sum(missing) AS BIGINT) AS missing, count(*) FILTER (extra > 0) AS over_return, round(avg(hit / nullif(got, 0)), 6) AS precision, round(avg(hit / nullif(wanted, 0)), 6) AS recall FROM c"""


def _writer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as cases, their lines as what a writer made and as claims: parts by name, evidence by supplier."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    o, n, p, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey").cast("string")
    trace = table(spark, sf_dir, "lineitem").groupBy(o.alias("case_id")).agg(F.collect_set(F.when(F.col("l_suppkey") % 13 != 5, s)).alias("trace"))
    cases = trace.select("case_id", _pick(("a", "b", "c"), F.col("case_id")).alias("domain"), F.when(F.col("case_id") % 2 == 0, "dev").otherwise("test").alias("split"), "trace", (F.col("case_id") % 29 == 3).alias("quiet"), F.array(F.lit("seed0"), F.concat(F.lit("seed"), (F.col("case_id") % 5).cast("string"))).alias("seeds"))
    made = items.where("l_linenumber <= 3").select(o.alias("case_id"), n.cast("string").alias("memory"), F.concat(F.upper("p_name"), F.lit(" of "), "p_brand").alias("content"), F.when(p % 5 > 0, F.col("p_type")).otherwise("none").alias("subject"), F.array(s).alias("evidence"))
    none = F.array().cast("array<string>")
    kind = F.when(n <= 2, "required").when(n == 3, "allowed").otherwise("forbidden")
    words = F.split("p_name", " ")
    claims = items.where("l_linenumber <= 4").select(
        o.alias("case_id"),
        n.cast("string").alias("claim_id"),
        kind.alias("kind"),
        F.when(n <= 3, F.slice(words, 1, 1)).otherwise(none).alias("all_terms"),
        F.slice(words, 2, 1).alias("any_terms"),
        F.when(n == 4, F.array(F.lit("brand#1"))).otherwise(none).alias("exempt"),
        F.when(p % 10 == 1, F.col("p_type")).alias("subject"),
        F.array(s, F.lit("extra")).alias("evidence"),
        F.when((n == 1) & (p % 3 == 0), "add").when((n == 2) & (p % 3 == 1), "update").alias("want_op"),
        F.when((n == 2) & (p % 3 == 1), F.concat(F.lit("seed"), (o % 7).cast("string"))).alias("want_target"),
    )
    operations = items.where("l_linenumber <= 2 and l_partkey % 4 < 3").select(o.alias("case_id"), F.when(n == 1, "add").otherwise("update").alias("op"), F.when(n == 2, F.concat(F.lit("seed"), (o % 7).cast("string"))).alias("target"), n.cast("string").alias("memory"))
    return cases, made, claims, operations


_TYPE = "CASE WHEN m.p % 5 > 0 THEN m.p_type ELSE 'none' END"
_WRITER = f"""it AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, CAST(l_suppkey AS VARCHAR) AS s, l_suppkey % 13 <> 5 AS traced, lower(p_name || ' of ' || p_brand) AS low, p_type, string_split(p_name, ' ') AS w FROM lineitem JOIN part ON p_partkey = l_partkey),
mt AS (SELECT m.o, m.n AS mem, c.n AS cl FROM it m JOIN it c USING (o) WHERE m.n <= 3 AND c.n <= 4 AND (c.n = 4 OR contains(m.low, c.w[1])) AND (len(c.w) < 2 OR contains(m.low, c.w[2])) AND (c.p % 10 <> 1 OR {_TYPE} = c.p_type) AND CASE WHEN c.n = 4 THEN NOT contains(m.low, 'brand#1') ELSE m.s = c.s END),
op AS (SELECT o, n FROM it WHERE n <= 2 AND p % 4 < 3),
cl AS (SELECT i.o, i.n, CASE WHEN i.n = 1 AND p % 3 = 0 THEN 'add' WHEN i.n = 2 AND p % 3 = 1 THEN 'update' END AS want, count(DISTINCT mt.mem) AS k, coalesce(bool_or(op.n = i.n), false) AS fits FROM it i LEFT JOIN mt ON mt.o = i.o AND mt.cl = i.n LEFT JOIN op ON op.o = i.o AND op.n = mt.mem WHERE i.n <= 2 GROUP BY ALL),
c1 AS (SELECT o, count(*) AS required_claims, count(*) FILTER (k > 0) AS required_found, count(*) FILTER (k > 1) AS duplicate_claims, count(*) FILTER (k > 0 AND want IS NOT NULL AND NOT fits) AS unmatched, bool_or(want = 'update') AS wants FROM cl GROUP BY o),
tr AS (SELECT o, list(DISTINCT s) FILTER (traced) AS trace FROM it GROUP BY o),
m1 AS (SELECT i.o, count(*) AS memories, count(*) FILTER (NOT EXISTS (SELECT 1 FROM mt WHERE mt.o = i.o AND mt.mem = i.n AND mt.cl <= 3)) AS unsupported_memories, count(*) FILTER (NOT coalesce(list_contains(trace, s), false)) AS evidence_failures, CAST(sum(length(low)) AS BIGINT) AS content_chars FROM it i JOIN tr USING (o) WHERE n <= 3 GROUP BY i.o),
b1 AS (SELECT o, count(*) AS forbidden_violations FROM mt WHERE cl = 4 GROUP BY o), o1 AS (SELECT o, count(*) AS operations, bool_or(n = 2) AS mutates FROM op GROUP BY o),
ws AS (SELECT tr.o AS case_id, ['a', 'b', 'c'][tr.o % 3 + 1] AS domain, CASE WHEN tr.o % 2 = 0 THEN 'dev' ELSE 'test' END AS split, tr.o % 29 = 3 AS quiet, coalesce(required_claims, 0) AS required_claims, coalesce(required_found, 0) AS required_found, coalesce(duplicate_claims, 0) AS duplicate_claims,
  coalesce(unmatched, 0) + CASE WHEN coalesce(mutates, false) AND NOT coalesce(wants, false) THEN 1 ELSE 0 END AS operation_failures, coalesce(unsupported_memories, 0) AS unsupported_memories, coalesce(evidence_failures, 0) AS evidence_failures, coalesce(forbidden_violations, 0) AS forbidden_violations,
  CASE WHEN coalesce(mutates, false) AND tr.o % 7 IN (0, tr.o % 5) THEN 1 ELSE 0 END AS preserved_seed_violations, coalesce(content_chars, 0) AS content_chars, coalesce(memories, 0) + coalesce(operations, 0) > 0 AND tr.o % 29 = 3 AS noisy
  FROM tr LEFT JOIN c1 USING (o) LEFT JOIN m1 USING (o) LEFT JOIN b1 USING (o) LEFT JOIN o1 USING (o)),
wc AS (SELECT case_id, domain, split, required_claims, required_found, required_claims - required_found AS missing_required, duplicate_claims, operation_failures, unsupported_memories, evidence_failures, forbidden_violations, preserved_seed_violations, noisy, content_chars,
  NOT noisy AND required_claims = required_found AND duplicate_claims + operation_failures + unsupported_memories + evidence_failures + forbidden_violations + preserved_seed_violations = 0 AS passed FROM ws)"""


def writer_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.writer_cases(*_writer(spark, sf_dir))


WRITER_CASES = f"WITH {_WRITER} SELECT * FROM wc"


def writer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.writer_metrics(writer_cases(spark, sf_dir))


_SUMS = ("required_claims", "required_found", "unsupported_memories", "forbidden_violations", "duplicate_claims", "operation_failures", "evidence_failures", "preserved_seed_violations", "content_chars")
WRITER_METRICS = f"""WITH {_WRITER} SELECT domain, split, count(*) FILTER (passed) AS passed_cases, count(*) FILTER (NOT passed) AS failed_cases, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMS)}, round(coalesce(sum(required_found) / nullif(sum(required_claims), 0), 1.0), 6) AS required_claim_recall
FROM wc GROUP BY GROUPING SETS ((domain), (split), ())"""


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as held-out records: parts expected and found, priorities forbidden."""
    items = table(spark, sf_dir, "lineitem")
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    of = lambda c: F.coalesce(F.collect_set(F.when(c, p)), F.array().cast("array<bigint>"))
    o = F.col("l_orderkey")
    records = items.groupBy(o.alias("o")).agg(of(n <= 2).alias("expected"), of(n == 3).alias("forbidden"), of(p % 3 > 0).alias("found"), of((n == 3) & (p % 7 == 0)).alias("found_forbidden"))
    return S.label_metrics(records.withColumn("oversized", F.col("o") % 10 == 3).withColumn("failed", F.col("o") % 50 == 7))


LABEL_METRICS = """WITH s AS (SELECT l_orderkey AS o, l_partkey AS p, bool_or(l_linenumber <= 2) AS e, bool_or(l_linenumber = 3) AS f, bool_or(l_linenumber = 3 AND l_partkey % 7 = 0) AS b FROM lineitem GROUP BY ALL),
c AS (SELECT o, count(*) FILTER (e) AS e, count(*) FILTER (f) AS f, count(*) FILTER (e AND p % 3 > 0) AS h, count(*) FILTER (b) AS b FROM s GROUP BY o), g AS (SELECT * FROM c WHERE o % 50 <> 7)
SELECT count(*) AS cases, round(sum(h) / nullif(sum(e), 0), 6) AS task_recall, round(sum(b) / nullif(sum(f), 0), 6) AS forbidden_label_rate, round(count(*) FILTER (b > 0) / count(*), 6) AS forbidden_case_rate, round(count(*) FILTER (o % 10 <> 3) / count(*), 6) AS budget_pass_rate, (SELECT count(*) FROM c WHERE o % 50 = 7) AS errors FROM g"""


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users as attempts, their events as cases: what passed before and after."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("attempt_id"), F.col("event_id").alias("case_id"), "value")
    before = e.select("attempt_id", "case_id", (F.col("value") > 30).alias("passed"))
    after = e.select("attempt_id", "case_id", (F.col("value") * (1 + F.col("case_id") % 3) > 40).alias("passed"))
    return e.where("case_id % 4 = 1").select("attempt_id", "case_id"), before, after


def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.attempt_outcomes(*_runs(spark, sf_dir))


_RUNS = "r AS (SELECT user_id AS attempt_id, event_id % 4 = 1 AS f, value > 30 AS w, value * (1 + event_id % 3) > 40 AS n FROM events), a AS (SELECT attempt_id, count(*) FILTER (f AND NOT w AND n) AS fixed, count(*) FILTER (f AND NOT n) AS missed, count(*) FILTER (f AND w AND n) AS already, count(*) FILTER (NOT f AND w AND NOT n) AS collateral, count(*) FILTER (n) AS passed, count(*) AS total, count(*) FILTER (f) AS predicted FROM r GROUP BY 1)"
ATTEMPT_OUTCOMES = f"WITH {_RUNS} SELECT attempt_id, fixed, missed, already, collateral, passed, total FROM a"


def prediction_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted, before, after = _runs(spark, sf_dir)
    i = F.col("attempt_id")
    attempts = S.attempt_outcomes(predicted, before, after).join(predicted.groupBy("attempt_id").agg(F.count("*").alias("predicted")), "attempt_id", "left")
    return S.calibration(attempts.select(F.when(i % 4 > 0, _pick(("recall", "precision"), i)).alias("objective"), F.when(i % 3 > 0, i % 3 == 1).alias("backfilled"), F.coalesce("predicted", F.lit(0)).alias("predicted"), "fixed", F.when(i % 9 > 0, i).alias("evaluated_at")))


PREDICTION_CALIBRATION = f"""WITH {_RUNS} SELECT CASE WHEN attempt_id % 4 > 0 THEN ['recall', 'precision'][attempt_id % 2 + 1] ELSE 'unknown' END AS objective, CASE WHEN attempt_id % 3 = 1 THEN 'backfilled' ELSE 'fresh' END AS written, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(fixed) AS BIGINT) AS fixed, count(*) AS attempts,
round(sum(fixed) / sum(predicted), 6) AS hit_rate FROM a WHERE predicted > 0 AND attempt_id % 9 > 0 GROUP BY 1, 2"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", F.when(F.col("id") % 9 > 0, F.col("namespace")).alias("canonical_name"), "content", F.try_element_at(T.tokens("content"), F.lit(3)).alias("alias"))


def rehearsal_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rehearsal_probes(_items(spark, sf_dir)).select("probe_id", "query", "split")


_KEYS = "list_filter(regexp_extract_all(text, '" + T.KEY_TOKEN + "'), lambda t: regexp_matches(t, '[0-9A-Z]'))"
_REHEARSED = f"""rk AS (SELECT doc_id AS id, source, text, list_filter({_KEYS}, lambda t: lower(t) <> lower(source)) AS o FROM documents WHERE doc_id % 9 > 0),
rp AS (SELECT id, source || ' ' || coalesce(list_filter(o, lambda t: regexp_matches(t, '[0-9]'))[1], o[1]) AS query, CASE WHEN substr(sha256(CAST(id AS VARCHAR)), 64, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'fit' ELSE 'held' END AS split FROM rk WHERE len(o) > 0)"""
REHEARSAL_PROBES = f"WITH {_REHEARSED} SELECT id AS probe_id, query, split FROM rp"


def rehearsal_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = S.rehearsal_probes(_items(spark, sf_dir))
    return S.rehearsal_controls(probes, evaluate.numbered(probes, "probe_id")).select("probe_id", "target")


REHEARSAL_CONTROLS = f"WITH {_REHEARSED} SELECT 'control:' || id AS probe_id, coalesce(lead(id) OVER (ORDER BY id), min(id) OVER ()) AS target FROM rp"


def alias_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from every tenth item's alias, applied to all items of its label."""
    items = _items(spark, sf_dir)
    return S.alias_fixes(items.where("id % 10 = 1").select("canonical_name", "alias"), items).select("target", F.md5(F.col("content").cast("binary")).alias("digest"))


_TOKENS = f"regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+')"
ALIAS_FIXES = f"""WITH r AS (SELECT DISTINCT source AS c, {_TOKENS}[3] AS a FROM documents WHERE doc_id % 10 = 1 AND doc_id % 9 > 0 AND length({_TOKENS}[3]) >= 2)
SELECT DISTINCT doc_id AS target, md5(source || ': ' || text) AS digest FROM documents JOIN r ON c = source AND list_contains(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), a) WHERE doc_id % 9 > 0"""


def _rehearsed(spark: SparkSession, sf_dir: str, fixed: bool) -> DataFrame:
    """What probes got: their own item now and then, and its neighbours; more often once fixes are in."""
    i = F.col("probe_id")
    hit = (i % 3 == 0) | ((i % 5 == 1) & F.lit(fixed))
    got = F.concat(F.when(i % 4 == 2, F.array(i + 1)).otherwise(F.array().cast("array<bigint>")), F.when(hit, F.array(i)).otherwise(F.array().cast("array<bigint>")))
    return S.rehearsal_probes(_items(spark, sf_dir)).select("probe_id", "target", "split", (i % 8 == 7).alias("control"), got.alias("got"))


def rehearsal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rehearsal_summary(_rehearsed(spark, sf_dir, True))


def _scored(fixed: str) -> str:
    hit = f"(id % 3 = 0 OR (id % 5 = 1 AND {fixed}))"
    return f"SELECT split, count(*) AS probes, count(*) FILTER ({hit}) AS hits, count(*) FILTER (id % 4 = 2) AS wrong_top1, count(*) FILTER (id % 4 = 2) AS over_return FROM rp WHERE id % 8 <> 7 GROUP BY split"


REHEARSAL_SUMMARY = f"WITH {_REHEARSED} {_scored('true')}"


def rehearsal_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = alias_fixes(spark, sf_dir).agg(F.count("*").alias("fixes")).select(F.lit(3).alias("before"), F.lit(3).alias("after"), "fixes")
    return S.keeps_batch(S.rehearsal_summary(_rehearsed(spark, sf_dir, False)), rehearsal_summary(spark, sf_dir), fixes)


REHEARSAL_DECISION = f"WITH {_REHEARSED}, b AS ({_scored('false')}), a AS ({_scored('true')}) SELECT a.hits > b.hits AND a.over_return <= b.over_return AS keep FROM a, b WHERE a.split = 'held' AND b.split = 'held'"


def backtest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of recall over the same probes against the newest one, by metric."""
    long = None
    for state, strict in (("plain", False), ("strict", True)):
        g = _grades(spark, sf_dir, strict)
        rows = g.select(F.lit(state).alias("state"), "probe_id", F.explode(F.map_from_arrays(F.array(F.lit("fabricated"), F.lit("recall"), F.lit("expired")), F.array(F.col("answered_fabricated").cast("int"), F.col("answer_hit").cast("int"), F.col("expired_served").cast("int")))).alias("metric", "value"))
        long = rows if long is None else long.unionByName(rows)
    return S.states_against_reference(long, "strict")


BACKTEST_STATES = (
    _BOTH
    + """, d AS (SELECT CAST(b.answered_fabricated AS INT) - CAST(a.answered_fabricated AS INT) AS fabricated, CAST(b.answer_hit AS INT) - CAST(a.answer_hit AS INT) AS recall, b.expired_served - a.expired_served AS expired FROM gr a JOIN gr2 b USING (probe_id)),
u AS (UNPIVOT d ON fabricated, recall, expired INTO NAME metric VALUE x) SELECT 'plain' AS state, metric, count(*) AS n, round(avg(x), 6) AS mean FROM u GROUP BY metric"""
)


def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each user's events as a research run."""
    e = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("active"), F.count_if(F.col("event_type") == "error").alias("over"), F.count_if(F.col("value") < 5).alias("missing"))
    return e.select("user_id", composite(F.col("active"), F.col("over"), F.col("missing")).alias("score"))


COMPOSITE_SCORES = "SELECT user_id, 100 * count(*) FILTER (event_type = 'purchase') - count(*) FILTER (event_type = 'error') - 10 * count(*) FILTER (value < 5) AS score FROM events GROUP BY user_id"


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules of percentiles over each type's values: interpolated, and at the whole place below."""
    e = events(spark, sf_dir)
    exact = evaluate.order_statistics(e, ["event_type"], "value", {"median": (0.5, "linear"), "p95": (0.95, "linear"), "p95_floor": (0.95, "floor")})
    empty = e.groupBy("event_type").agg(F.count_if(F.col("value") == 0).alias("empty"))
    return exact.join(empty, "event_type").select("event_type", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "p95_floor", "empty")


LATENCY_PERCENTILES = "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95_floor, count(*) FILTER (value = 0) AS empty FROM events GROUP BY event_type"

NAMES = (
    "scope_relations precision_summary writer_cases writer_metrics label_metrics attempt_outcomes prediction_calibration rehearsal_probes rehearsal_controls alias_fixes rehearsal_summary rehearsal_decision backtest_states "
    "composite_scores latency_percentiles"
).split()
