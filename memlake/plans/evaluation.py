"""Evaluation and review queries over the driver tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import evaluate, rerank, search
from memlake.operators.store import duplicate_members
from memlake.plans.retrieval import _BATCH, _probes, recall, recall_batch
from memlake.sources.tables import events, table, texts

# Events stand for graded probes: a user is a life, the type tells what happened, the value a score.
_KIND = "CASE WHEN event_id % 4 = 3 THEN 'fabricated' ELSE 'answerable' END"
_GRADES = f"""g AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'tool' ELSE 'prefetch' END AS surface, event_id AS probe_id, user_id AS life_id, ts, {_KIND} AS kind,
event_type <> 'error' AND value > 20 AS answer_hit, CAST(floor(value) AS BIGINT) % 5 AS returned_rows, event_type = 'click' AND value > 50 AS stale_first, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS expired FROM events)"""


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        F.when(F.col("event_id") % 2 == 0, "tool").otherwise("prefetch").alias("surface"),
        F.col("event_id").alias("probe_id"),
        F.col("user_id").alias("life_id"),
        "ts",
        F.when(F.col("event_id") % 4 == 3, "fabricated").otherwise("answerable").alias("kind"),
        ((F.col("event_type") != "error") & (F.col("value") > 20)).alias("answer_hit"),
        (F.floor("value") % 5).alias("returned_rows"),
        ((F.col("event_type") == "click") & (F.col("value") > 50)).alias("stale_first"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("expired"),
    )


def surface_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.surface_summary(_grades(spark, sf_dir))


SURFACE_SUMMARY = f"""WITH {_GRADES} SELECT surface, count(*) AS probes, count(*) FILTER (kind = 'answerable') AS answerable,
round(CAST(count(*) FILTER (kind = 'answerable' AND answer_hit) AS DOUBLE) / nullif(count(*) FILTER (kind = 'answerable'), 0), 6) AS answer_recall,
count(*) FILTER (kind = 'fabricated' AND returned_rows > 0) AS fabricated_with_rows, count(*) FILTER (stale_first) AS stale_above_current, CAST(sum(expired) AS BIGINT) AS expired_served FROM g GROUP BY surface"""


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two arms over each user's events: mean value before and after a doubling of odd types."""
    e = events(spark, sf_dir)
    a = e.groupBy(F.col("user_id").alias("probe_id")).agg(F.avg("value").alias("score"))
    b = e.groupBy(F.col("user_id").alias("probe_id")).agg(F.avg(F.when(F.length("event_type") % 2 == 1, F.col("value") * 1.1).otherwise(F.col("value"))).alias("score"))
    return a, b


_ARMS = "p AS (SELECT user_id AS probe_id, avg(value) AS a, avg(CASE WHEN length(event_type) % 2 = 1 THEN value * 1.1 ELSE value END) AS b FROM events GROUP BY user_id)"


def arm_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _arms(spark, sf_dir)
    rows = evaluate.paired(a, b, "probe_id", "score")
    return rows.agg(
        F.count("*").alias("n"),
        F.round(F.avg("a"), 6).alias("mean_a"),
        F.round(F.avg("b"), 6).alias("mean_b"),
        F.round(F.avg("diff"), 6).alias("mean_diff"),
        F.count_if(F.col("diff") > 1e-9).alias("better"),
        F.count_if(F.col("diff") < -1e-9).alias("worse"),
    )


ARM_COMPARE = f"WITH {_ARMS} SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(b - a), 6) AS mean_diff, count(*) FILTER (b - a > 1e-9) AS better, count(*) FILTER (b - a < -1e-9) AS worse FROM p"


def aa_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one measure: whether a user's events are worth more than 45 on the whole, with every event and without one of 97."""
    e = events(spark, sf_dir).withColumn("probe_id", F.floor(F.col("event_id") / 20))
    score = lambda rows: rows.groupBy("probe_id").agg((F.avg("value") > 45).cast("int").alias("score"))
    return evaluate.aa_control(score(e), score(e.where("event_id % 97 > 0 or event_id % 20 = 0")), "probe_id", "score")


AA_CONTROL = """WITH a AS (SELECT event_id // 20 AS p, avg(value) > 45 AS s FROM events GROUP BY 1), b AS (SELECT event_id // 20 AS p, avg(value) > 45 AS s FROM events WHERE event_id % 97 > 0 OR event_id % 20 = 0 GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (a.s <> b.s) AS differing, count(*) FILTER (a.s <> b.s) <= greatest(1.0, count(*) / 100) AS flat FROM a JOIN b USING (p)"""


def stage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts"))
    return evaluate.stage_of(e, "user_id", "day").groupBy("user_id", F.col("stage").cast("long").alias("stage")).agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"))


_STAGED = """r AS (SELECT *, date_trunc('day', ts) AS day, dense_rank() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) - 1 AS r FROM events),
st AS (SELECT *, r * 4 // (max(r) OVER (PARTITION BY user_id) + 1) AS stage FROM r)"""
STAGE_BUCKETS = f"WITH {_STAGED} SELECT user_id, CAST(stage AS BIGINT) AS stage, count(*) AS n, count(DISTINCT day) AS days FROM st GROUP BY ALL"


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event probed at its own stage and all later ones; it is forgotten at stage s if its value is low."""
    e = evaluate.stage_of(events(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts")), "user_id", "day").withColumnRenamed("stage", "cohort")
    probed = e.select(F.col("user_id").alias("life_id"), F.col("event_id").alias("probe_id"), "cohort", "value", F.explode(F.sequence("cohort", F.lit(3))).alias("stage"))
    return probed.withColumn("hit", F.col("value") > 10 * (F.col("stage") - F.col("cohort")))


_PROBED = f"{_STAGED}, pr AS (SELECT user_id AS life_id, event_id AS probe_id, stage AS cohort, value, unnest(range(stage, 4)) AS stage FROM st), hs AS (SELECT *, value > 10 * (stage - cohort) AS hit FROM pr)"


def retention_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.retention_matrix(_staged(spark, sf_dir))
    return out.select(F.col("stage").cast("long").alias("stage"), *[F.col(str(c)).alias(f"cohort_{c}") for c in range(4)])


RETENTION_MATRIX = f"WITH {_PROBED} SELECT CAST(stage AS BIGINT) AS stage, " + ", ".join(f"round(avg(CAST(hit AS INT)) FILTER (cohort = {c}), 6) AS cohort_{c}" for c in range(4)) + " FROM hs GROUP BY stage"


def backward_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.backward_transfer(_staged(spark, sf_dir))


BACKWARD_TRANSFER = f"WITH {_PROBED} SELECT a.life_id, round(avg(CAST(b.hit AS INT) - CAST(a.hit AS INT)), 6) AS transfer, count(*) AS probes FROM hs a JOIN hs b USING (life_id, probe_id) WHERE a.stage = a.cohort AND b.stage = 3 GROUP BY a.life_id"


def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One test for each event type: a made-up p from its share of high values."""
    p = F.round(F.count_if(F.col("value") > 50) / F.count("*") / 20, 6)
    return evaluate.holm(events(spark, sf_dir).groupBy(F.col("event_type").alias("name")).agg(p.alias("p")))


HOLM = """WITH t AS (SELECT event_type AS name, round(count(*) FILTER (value > 50) / count(*) / 20, 6) AS p FROM events GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM t)
SELECT name, p, round(max(least(1.0, p * (m - k + 1))) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM k"""


#: Rounds of the paired interval and of the resampling of whole users.
ROUNDS, CLUSTER_ROUNDS = 10_000, 2_000


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _arms(spark, sf_dir)
    rows = evaluate.numbered(evaluate.paired(a, b, "probe_id", "score"), "probe_id")
    values = rows.select("i", F.round("diff", 9).alias("x"), F.lit(1).alias("w"))
    return evaluate.interval(evaluate.bootstrap_means(values, ROUNDS), evaluate.mean_of(values))


#: A round's draws go down the tree of blocks of 64 units: ``nd`` has the draws of each node, down to those of 64 units.
_MIX = """(SELECT *, (z5 * 2147483647 + z4) % width AS u FROM (SELECT *, (z4 * 69621 + z2) % 2147483647 AS z5 FROM (SELECT *, (z3 * z3 + 7) % 2147483647 AS z4 FROM (SELECT *, (z2 * 48271 + z1) % 2147483647 AS z3
FROM (SELECT *, (z1 * z1 + t * 69621 + 11) % 2147483647 AS z2 FROM (SELECT *, (b * 48271 + node * 16807 + (level + 1)) % 2147483647 AS z1 FROM {})))))) """
_BOOT = f"""c AS (SELECT count(*) AS n FROM v), lv AS (SELECT greatest(0, min(k)) AS depth FROM (SELECT unnest(range(0, 8)) AS k), c WHERE CAST(pow(64, k + 1) AS BIGINT) >= n),
nd AS (SELECT b, CAST(0 AS BIGINT) AS node, n AS c, depth AS level FROM c, lv, (SELECT unnest(range(0, ROUNDS)) AS b) UNION ALL
  SELECT b, (node * size + u) // (size // 64) AS node, count(*) AS c, level - 1 AS level FROM {_MIX.format("(SELECT nd.b, node, level, CAST(pow(64, level + 1) AS BIGINT) AS size, least(CAST(pow(64, level + 1) AS BIGINT), n - node * CAST(pow(64, level + 1) AS BIGINT)) AS width, unnest(range(0, nd.c)) AS t FROM nd, c WHERE level > 0)")} GROUP BY b, (node * size + u) // (size // 64), level),
d AS (SELECT b, node * 64 + u AS i FROM {_MIX.format("(SELECT nd.b, node, level, least(64, n - node * 64) AS width, unnest(range(0, nd.c)) AS t FROM nd, c WHERE level = 0)")}),
m AS (SELECT b, sum(x) / sum(w) AS mean FROM d JOIN v USING (i) GROUP BY b), o AS (SELECT sum(x) / sum(w) AS seen FROM v)
SELECT round(any_value(seen), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, quantile_cont(mean, 0.025) > 0 OR quantile_cont(mean, 0.975) < 0 AS excludes_zero,
round(avg(CAST(CASE WHEN seen > 0 THEN mean <= 0 ELSE mean >= 0 END AS INT)), 6) AS other_side, count(*) AS rounds FROM m, o"""
BOOTSTRAP_CI = f"WITH RECURSIVE {_ARMS}, v AS (SELECT row_number() OVER (ORDER BY probe_id) - 1 AS i, round(b - a, 9) AS x, 1 AS w FROM p), {_BOOT}".replace("ROUNDS", str(ROUNDS))


def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampling of users with all their events."""
    sums = events(spark, sf_dir).groupBy("user_id").agg(F.round(F.sum(F.col("value") - 50), 6).alias("x"), F.count("*").alias("w"))
    values = evaluate.numbered(sums, "user_id").select("i", "x", "w")
    return evaluate.interval(evaluate.bootstrap_means(values, CLUSTER_ROUNDS), evaluate.mean_of(values))


CLUSTER_BOOTSTRAP = f"WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS i, round(sum(value - 50), 6) AS x, count(*) AS w FROM events GROUP BY user_id), {_BOOT}".replace("ROUNDS", str(CLUSTER_ROUNDS))


def power_mde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least difference that each event type's number of events detects, and the number that 0.1 would take."""
    rows = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.stddev_samp("value").alias("sd"))
    return rows.select(
        "event_type",
        "n",
        F.round(evaluate.paired_mde(F.col("n"), F.col("sd")), 5).alias("mde"),
        evaluate.sample_size(F.lit(0.1), F.lit(1.0)).alias("needed"),
        F.round(evaluate.inverse_normal(F.least(F.lit(0.99), F.col("n") / 10000)), 6).alias("z"),
    )


def _acklam(p: str) -> str:
    def poly(x: str, cs: tuple[float, ...]) -> str:
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out} * {x} + ({c!r}))"
        return out

    tail, mid = f"sqrt(-2 * ln(least({p}, 1 - ({p}))))", f"(({p}) - 0.5)"
    outer = f"({poly(tail, evaluate.ACKLAM_C)} / {poly(tail, (*evaluate.ACKLAM_D, 1.0))})"
    inner = f"({poly(f'({mid} * {mid})', evaluate.ACKLAM_A)} * {mid} / {poly(f'({mid} * {mid})', (*evaluate.ACKLAM_B, 1.0))})"
    return f"(CASE WHEN {p} < 0.02425 THEN {outer} WHEN {p} > 0.97575 THEN -{outer} ELSE {inner} END)"


_Z = f"({_acklam('CAST(0.975 AS DOUBLE)')} + {_acklam('CAST(0.8 AS DOUBLE)')})"
POWER_MDE = f"""WITH r AS (SELECT event_type, count(*) AS n, stddev_samp(value) AS sd FROM events GROUP BY 1)
SELECT event_type, n, round({_Z} * sd / sqrt(n), 5) AS mde, CAST(greatest(2, ceil(pow({_Z} / 0.1, 2))) AS BIGINT) AS needed, round({_acklam('least(CAST(0.99 AS DOUBLE), n / 10000)')}, 6) AS z FROM r"""


def set_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalled texts of a probe against those that have its passage, the first ten ids being allowed and the next ten forbidden."""
    got = recall_batch(spark, sf_dir).groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("got"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    ids = lambda lo, hi: F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))
    cases = items.join(got, "query_id", "left").select(F.col("query_id").alias("id"), F.array("query_id").alias("expected"), ids(0, 99).alias("allowed"), ids(100, 499).alias("forbidden"), F.coalesce("got", F.array().cast("array<bigint>")).alias("got"))
    out = evaluate.set_grades(cases)
    return out.select("id", *[F.col(c).cast("long").alias(c) for c in ("missing", "forbidden", "extra")], "precision", "recall")


SET_GRADES = _BATCH + """, g AS (SELECT query_id, list_sort(list(id)) AS got FROM r GROUP BY 1), c AS (SELECT item_id AS id, [item_id] AS expected, coalesce(got, []) AS got FROM benchmark LEFT JOIN g ON query_id = item_id),
h AS (SELECT *, len(list_intersect(got, expected)) AS hit FROM c)
SELECT id, len(list_filter(expected, lambda x: NOT list_contains(got, x))) AS missing, len(list_filter(got, lambda x: x BETWEEN 100 AND 499)) AS forbidden,
len(list_filter(got, lambda x: x > 99 AND NOT list_contains(expected, x))) AS extra, round(hit / nullif(len(got), 0), 6) AS precision, round(hit / nullif(len(expected), 0), 6) AS recall FROM h"""


def writer_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a writer's case: what its user turns need, what its assistant turns cite, what they make up."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", F.array_distinct(T.tokens("text")).alias("tokens"))
    need = turns.groupBy("conv_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == "user", F.col("tokens")))))).alias("required"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") != "user", F.col("tokens")))))).alias("written"),
    )
    return need.select(
        "conv_id",
        F.size(F.array_except("required", "written")).cast("long").alias("missing"),
        F.size(F.array_except("written", "required")).cast("long").alias("unsupported"),
        F.arrays_overlap("required", "written").alias("grounded"),
    )


_TOK = f"regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+')"
WRITER_SCORE = f"""WITH t AS (SELECT conv_id, role = 'user' AS u, unnest({_TOK}) AS t FROM conversations), d AS (SELECT conv_id, t, bool_or(u) AS r, bool_or(NOT u) AS w FROM t GROUP BY ALL)
SELECT c.conv_id, count(*) FILTER (r AND NOT w) AS missing, count(*) FILTER (w AND NOT r) AS unsupported, coalesce(bool_or(r AND w), false) AS grounded FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN d USING (conv_id) GROUP BY 1"""


def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of first reviews and the latest outcome, by day; rates are null without reviews."""
    e = events(spark, sf_dir)
    first = e.groupBy(F.date_trunc("day", "ts").alias("day"), "user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("verdict"), F.max_by("event_type", F.struct("ts", "event_id")).alias("outcome"))
    share = lambda c: F.round(F.try_divide(F.count_if(c).cast("double"), F.count("*").cast("double")), 4)
    return first.groupBy("day").agg(F.count("*").alias("reviews"), share(F.col("verdict") == "click").alias("contradicted"), share(F.col("outcome") == "purchase").alias("accepted"))


REVIEW_STATS = """WITH f AS (SELECT date_trunc('day', ts) AS day, user_id, arg_min(event_type, struct_pack(a := ts, b := event_id)) AS verdict, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS outcome FROM events GROUP BY ALL)
SELECT CAST(day AS TIMESTAMP) AS day, count(*) AS reviews, round(count(*) FILTER (verdict = 'click') / count(*), 4) AS contradicted, round(count(*) FILTER (outcome = 'purchase') / count(*), 4) AS accepted FROM f GROUP BY 1"""


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to look at and why: exact copies but the first, over-long ones, those without a label."""
    rows = texts(spark, sf_dir)
    copies = duplicate_members(rows).select("id", "namespace", F.col("digest").alias("d"))
    later = copies.withColumn("n", F.row_number().over(Window.partitionBy("namespace", "d").orderBy("id"))).where("n > 1").select("id", F.lit("exact_duplicate").alias("copy"))
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("known"))
    facts = rows.select("id", F.length("content").alias("n")).join(later, "id", "left").join(labelled, "id", "left")
    reasons = F.array_compact(F.array(F.col("copy"), F.when(F.col("n") > 8000, "content_requires_full_read"), F.when(F.col("known").isNull(), "source_unavailable")))
    return facts.select("id", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


REVIEW_QUEUE = """WITH c AS (SELECT doc_id, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS n, length(text) AS size FROM documents)
SELECT * FROM (SELECT c.doc_id AS id, concat_ws(',', CASE WHEN n > 1 THEN 'exact_duplicate' END, CASE WHEN size > 8000 THEN 'content_requires_full_read' END, CASE WHEN l.doc_id IS NULL THEN 'source_unavailable' END) AS reasons
FROM c LEFT JOIN labels l ON l.doc_id = c.doc_id) WHERE reasons <> ''"""


def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 rows of each of two stores, merged newest first."""
    e = events(spark, sf_dir).select(F.col("ts").alias("seen_at"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "episodic").otherwise("working").alias("store"))
    ranked = e.withColumn("n", F.row_number().over(Window.partitionBy("store").orderBy(F.desc("seen_at"), F.desc("id")))).where("n <= 100").drop("n")
    return ranked.orderBy(F.desc("seen_at"), F.desc("id"))


EVIDENCE_UNION = "SELECT seen_at, id, store FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY seen_at DESC, id DESC) AS n FROM (SELECT ts AS seen_at, event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'episodic' ELSE 'working' END AS store FROM events)) WHERE n <= 100"


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of several scopes interleaved by rank, each id once, five ids a query."""
    hits = recall_batch(spark, sf_dir).select((F.col("query_id") % 10).alias("q"), (F.col("query_id") / 10).cast("int").alias("scope"), "id", "rank")
    first = hits.groupBy("q", "id").agg(F.min(F.struct("rank", "scope")).alias("f"))
    order = Window.partitionBy("q").orderBy("f.rank", "f.scope", "id")
    return first.withColumn("position", F.row_number().over(order).cast("long")).where("position <= 5").select("q", "id", "position")


ROUND_ROBIN = _BATCH + """, x AS (SELECT query_id % 10 AS q, CAST(query_id // 10 AS INT) AS scope, id, rank FROM r), f AS (SELECT q, id, min(struct_pack(a := rank, b := scope)) AS f FROM x GROUP BY ALL)
SELECT q, id, position FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY f.a, f.b, id) AS position FROM f) WHERE position <= 5"""


def _hit_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.with_texts(recall(spark, sf_dir, 12), _probes(spark, sf_dir), texts(spark, sf_dir))
    return hits.withColumn("tokens", F.array_distinct(T.tokens("content"))).drop("content")


def near_dup_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each probe's first 12 texts without those that say much the same as an earlier one."""
    return rerank.collapse_near_duplicates(_hit_tokens(spark, sf_dir).select("query_id", "id", "rank", "tokens"))


_WIDE = _BATCH.replace("rank <= 5", "rank <= 12").replace("WITH t AS", "WITH RECURSIVE t AS", 1)
#: Rows ``fx(query_id, pos, id, tok)`` folded in the order of ``pos``: kept unless they are near a kept one.
COLLAPSE_SQL = """fk AS (SELECT DISTINCT query_id, 0 AS pos, CAST([] AS VARCHAR[][]) AS kept, false AS added FROM fx UNION ALL
SELECT query_id, pos, CASE WHEN fresh THEN list_append(kept, tok) ELSE kept END, fresh FROM (
  SELECT fx.query_id, fx.pos, fk.kept, fx.tok, len(fx.tok) > 0 AND len(list_filter(fk.kept, lambda o: len(list_intersect(o, fx.tok)) / (len(o) + len(fx.tok) - len(list_intersect(o, fx.tok))) >= 0.72
    OR len(list_intersect(o, fx.tok)) / least(len(o), len(fx.tok)) >= 0.86)) = 0 AS fresh FROM fk JOIN fx ON fx.query_id = fk.query_id AND fx.pos = fk.pos + 1))"""
NEAR_DUP_COLLAPSE = _WIDE + f""", fx AS (SELECT query_id, rank AS pos, r.id, list_distinct(ts) AS tok FROM r JOIN t USING (id)), {COLLAPSE_SQL}
SELECT fx.query_id, fx.id, fx.pos AS rank FROM fk JOIN fx USING (query_id, pos) WHERE added"""


def coverage_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each probe's first 12 texts, the five that together have most of its words first."""
    hits = _hit_tokens(spark, sf_dir).join(_probes(spark, sf_dir).withColumn("terms", F.array_distinct("terms")), "query_id")
    return rerank.coverage_rerank(hits.select("query_id", "id", "rank", F.size("terms").alias("words"), F.array_intersect("terms", "tokens").alias("hits")))


COVERAGE_RERANK = _WIDE + """, qt AS (SELECT query_id, list(DISTINCT term) AS terms FROM q GROUP BY 1),
cx AS (SELECT query_id, rank AS pos, r.id, len(terms) AS words, list_intersect(terms, ts) AS hits, count(*) OVER (PARTITION BY query_id) AS m FROM r JOIN t USING (id) JOIN qt USING (query_id)),
cl AS (SELECT query_id, list(struct_pack(pos := pos, id := id, hits := hits) ORDER BY pos) AS lst FROM cx WHERE words >= 4 AND m > 5 GROUP BY 1),
cg AS (SELECT query_id, 0 AS n, lst AS lft, CAST([] AS VARCHAR[]) AS cov, CAST(NULL AS BIGINT) AS id FROM cl UNION ALL
SELECT query_id, n + 1, list_filter(lft, lambda e: e.pos <> b.row.pos), list_concat(cov, b.row.hits), b.row.id FROM (
  SELECT query_id, n, lft, cov, list_min(list_transform(lft, lambda e: struct_pack(less := -len(list_filter(e.hits, lambda h: NOT list_contains(cov, h))), pos := e.pos, row := e))) AS b FROM cg WHERE n < 5))
SELECT query_id, id, CAST(n AS BIGINT) AS position FROM cg WHERE n > 0 UNION ALL SELECT query_id, id, pos FROM cx WHERE (words < 4 OR m <= 5) AND pos <= 5"""


def budget_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns in order while they fit 600 characters."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat("role", F.lit(": "), "text").alias("line"))
    return rerank.budget_blocks(lines, "conv_id", ["turn", "role", "line"], 600).select("conv_id", "turn", "role", "used")


BUDGET_BLOCKS = """SELECT conv_id, turn, role, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(length(role || ': ' || text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, role, role || ': ' || text ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used - 1 <= 600"""

NAMES = (
    "surface_summary arm_compare aa_control stage_buckets retention_matrix backward_transfer holm bootstrap_ci cluster_bootstrap power_mde set_grades writer_score review_stats review_queue evidence_union "
    "round_robin near_dup_collapse coverage_rerank budget_blocks"
).split()
