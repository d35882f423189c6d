"""Retrieval queries over the driver tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import search, store
from memlake.sources.tables import events, importance, shared_folder, table, texts, turns, with_importance
from memlake.streaming import capture

TERMS = "the that"
_FOLD = "strip_accents(lower({}))"
_TOKENS = "regexp_extract_all(" + _FOLD.format("coalesce(text, '')") + ", '[\\p{L}\\p{N}]+')"
_IMPORTANCE = "CASE WHEN quality = 1 THEN 8 WHEN quality IS NULL THEN 5 ELSE 2 END"
_MEM = f"mem AS (SELECT d.doc_id AS id, d.text AS content, d.source AS namespace, CAST(d.n_chars AS DOUBLE) AS created_at, {_IMPORTANCE} AS importance FROM documents d LEFT JOIN labels USING (doc_id))"
_WEIGHT = "greatest(ln((n - {d} + 0.5) / ({d} + 0.5)), 1e-6) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * dl / avgdl))"


#: One index for each session and state of the tables: written once, read by every query.
_INDEXES: dict[tuple[str, str, int, int], search.Index] = {}


def index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The index of the documents as they are now: another time or size of a file is another index."""
    files = table(spark, sf_dir, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("*")), F.lit(0))).first()
    key = (spark.sparkContext.applicationId, sf_dir, *state)
    if key not in _INDEXES:
        _INDEXES[key] = search.build_index(texts(spark, sf_dir), shared_folder(spark, "index"))
    return _INDEXES[key]


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's terms with the texts that have them."""
    return index(spark, sf_dir).terms


INDEX_TERMS = f"SELECT term, count(DISTINCT id) AS df FROM (SELECT doc_id AS id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term"


def _scored(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Narrow scored rows: the texts themselves are never read."""
    hits = search.score(index(spark, sf_dir), query).withColumn("score", F.round("score", 6))
    plain = texts(spark, sf_dir).drop("content")
    return with_importance(hits.join(plain, "id"), importance(spark, sf_dir))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("score"), F.desc("importance"), F.desc("created_at"), F.asc("id")).limit(k)


def fts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_scored(spark, sf_dir, TERMS), 10).select("id", "score", "importance", "created_at")


_FTS = f"""
WITH {_MEM}, t AS (SELECT doc_id AS id, {_TOKENS} AS ts FROM documents),
c AS (SELECT id, len(ts) AS dl, len(list_filter(ts, lambda x: x = 'the')) AS f0, len(list_filter(ts, lambda x: x = 'that')) AS f1 FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM c),
h AS (SELECT id, round({_WEIGHT.format(d='d0', f='f0')} + {_WEIGHT.format(d='d1', f='f1')}, 6) AS score FROM c, s WHERE f0 > 0 AND f1 > 0)
"""
FTS_TOPK = _FTS + "SELECT h.id, score, importance, created_at FROM h JOIN mem USING (id) ORDER BY score DESC, importance DESC, created_at DESC, id LIMIT 10"


def fts_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir, TERMS).where(search.predicate("src3", 5))
    return _ranked(rows, 20).select("id", "score", "importance", "namespace")


FTS_FILTERED = _FTS + "SELECT h.id, score, importance, namespace FROM h JOIN mem USING (id) WHERE namespace = 'src3' AND importance >= 5 ORDER BY score DESC, importance DESC, created_at DESC, id LIMIT 20"


def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word with a sign inside is a phrase of two tokens."""
    return _ranked(_scored(spark, sf_dir, "of-the"), 10).select("id", "score")


FTS_PHRASE = f"""
WITH {_MEM}, t AS (SELECT doc_id AS id, {_TOKENS} AS ts FROM documents),
c AS (SELECT id, len(ts) AS dl, len(list_filter(range(1, len(ts)), lambda i: ts[i] = 'of' AND ts[i + 1] = 'the')) AS f FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (f > 0) AS d FROM c)
SELECT c.id, round({_WEIGHT.format(d='d', f='f')}, 6) AS score FROM c, s JOIN mem ON true WHERE mem.id = c.id AND f > 0
ORDER BY score DESC, importance DESC, created_at DESC, c.id LIMIT 10
"""


def literal_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.literal(texts(spark, sf_dir), "+++").unionByName(search.literal(texts(spark, sf_dir), "$$$ "))
    rows = with_importance(hits.select("id", "created_at").distinct(), importance(spark, sf_dir))
    return rows.orderBy(F.desc("importance"), F.desc("created_at"), F.asc("id")).limit(50).select("id", "importance", "created_at")


LITERAL_RECALL = f"WITH {_MEM} SELECT id, importance, created_at FROM mem WHERE contains(content, '+++') OR contains(content, '$$$ ') ORDER BY importance DESC, created_at DESC, id LIMIT 50"


def count_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, TERMS).where(search.predicate(None, 5)).groupBy("namespace").agg(F.count("*").alias("n"))


COUNT_MATCHING = _FTS + "SELECT namespace, count(*) AS n FROM h JOIN mem USING (id) WHERE importance >= 5 GROUP BY namespace"


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_importance(texts(spark, sf_dir).drop("content"), importance(spark, sf_dir))


def list_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.list_memories(_plain(spark, sf_dir), "created_at", 25).select("id", "namespace", "created_at")


LIST_RECENT = f"WITH {_MEM} SELECT id, namespace, created_at FROM mem ORDER BY created_at DESC, id LIMIT 25"


def list_by_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.list_memories(_plain(spark, sf_dir), "importance", 25, "src0").select("id", "importance")


LIST_BY_IMPORTANCE = f"WITH {_MEM} SELECT id, importance FROM mem WHERE namespace = 'src0' ORDER BY importance DESC, id LIMIT 25"


def describe_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.describe(texts(spark, sf_dir).drop("content"))


DESCRIBE_STORE = f"""WITH {_MEM} SELECT namespace, count(*) AS n, min(created_at) AS oldest, max(created_at) AS newest,
CAST(sum(count(*)) OVER () AS BIGINT) AS total, min(min(created_at)) OVER () AS first_at, max(max(created_at)) OVER () AS last_at FROM mem GROUP BY namespace"""


def count_by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.count_by_namespace(texts(spark, sf_dir))


COUNT_BY_NAMESPACE = "SELECT source AS namespace, count(*) AS n FROM documents GROUP BY source"


def dedup_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.dedup_proposals(texts(spark, sf_dir))


DEDUP_PROPOSALS = f"SELECT source AS namespace, substr(translate(text, '{T.UPPER}', '{T.LOWER}'), 1, 50) AS head, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1"


def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.exact_duplicates(texts(spark, sf_dir))
    return found.select("namespace", "digest", "n", "first_id")


DEDUP_EXACT = "SELECT source AS namespace, sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY source, text HAVING count(*) > 1"


def dedup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.duplicate_members(texts(spark, sf_dir)).select("id", "namespace")


DEDUP_MEMBERS = "SELECT doc_id AS id, source AS namespace FROM documents WHERE (source, text) IN (SELECT source, text FROM documents GROUP BY source, text HAVING count(*) > 1)"


def dedup_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.consolidate_preview(texts(spark, sf_dir))


DEDUP_PREVIEW = "SELECT namespace, first_id, n, substr(text, 1, 80) AS preview FROM (SELECT source AS namespace, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY source, text HAVING count(*) > 1 ORDER BY n DESC, first_id LIMIT 50) JOIN documents ON doc_id = first_id"


def dedup_losers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_importance(texts(spark, sf_dir), importance(spark, sf_dir))
    return store.duplicate_losers(rows).select("id", "namespace", "importance", "rank")


DEDUP_LOSERS = f"""WITH {_MEM} SELECT id, namespace, importance, rank FROM (SELECT *, row_number() OVER (PARTITION BY namespace, content ORDER BY importance DESC, created_at, id) AS rank FROM mem) WHERE rank > 1"""


def access_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffered accesses of users, folded and applied to a counter table."""
    log = events(spark, sf_dir)
    batches = log.select(F.array("user_id").alias("ids"), F.col("ts").alias("at"))
    base = log.select(F.col("user_id").alias("id")).distinct().withColumns({"access_count": F.lit(0), "last_accessed": F.lit(None).cast("timestamp")})
    return store.apply_accesses(base, store.fold_accesses(batches)).select("id", F.col("access_count").cast("long").alias("access_count"), "last_accessed")


ACCESS_FOLD = "SELECT user_id AS id, count(*) AS access_count, max(ts) AS last_accessed FROM events GROUP BY user_id"


def ring_last3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.last_of(events(spark, sf_dir), "user_id", F.col("ts"), 3).select("user_id", "event_id", "event_type", "rank")


RING_LAST3 = "SELECT user_id, event_id, event_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 3"


def latest_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("outcome"), F.count("*").alias("n"))


LATEST_OUTCOME = "SELECT user_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS outcome, count(*) AS n FROM events GROUP BY user_id"


def audit_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows that session 7 sees: its own ones and the global ones (purchases)."""
    scope = F.when(F.col("event_type") == "purchase", "global").otherwise("session")
    rows = events(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("session_id"), scope.alias("scope"), "event_type", "value")
    return rows.where(store.visible("7")).orderBy(F.desc("event_id")).limit(200)


AUDIT_SCOPED = """WITH r AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, CASE WHEN event_type = 'purchase' THEN 'global' ELSE 'session' END AS scope, event_type, value FROM events)
SELECT * FROM r WHERE scope = 'global' OR session_id = '7' ORDER BY event_id DESC LIMIT 200"""


def turn_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that are kept as memories, with their importance."""
    return capture.capture_turns(turns(spark, sf_dir)).select("session_id", "turn", "role", "importance", "content")


TURN_CAPTURE = """SELECT * FROM (SELECT conv_id AS session_id, turn, role, CASE WHEN role = 'user' AND length(text) > 5 THEN CAST(0.5 AS DOUBLE) WHEN role = 'assistant' AND length(text) > 10 THEN 0.15 WHEN role = 'tool' THEN 0.2 END AS importance,
text AS content FROM conversations WHERE trim(text) <> '') WHERE importance IS NOT NULL"""


def identity_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).where("role = 'user'")
    return rows.groupBy("session_id").agg(F.count_if(T.has_identity_signal("content")).alias("signals"), F.count("*").alias("turns"))


IDENTITY_SIGNALS = "SELECT conv_id AS session_id, count(*) FILTER (" + " OR ".join("contains(lower(text), '{}')".format(p.replace("'", "''")) for p in T.IDENTITY_SIGNALS) + ") AS signals, count(*) AS turns FROM conversations WHERE role = 'user' GROUP BY conv_id"


def fallback_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("session_id", "turn", F.array_join(search.fallback_terms(F.col("content")), " ").alias("terms"))


_TERMS_SQL = "list_transform(list_sort(list_transform(list_distinct(x), lambda v: struct_pack(p := list_position(x, v), v := v)))[1:8], lambda s: s.v)"
FALLBACK_TERMS = f"SELECT session_id, turn, array_to_string({_TERMS_SQL}, ' ') AS terms FROM (SELECT conv_id AS session_id, turn, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{4,}}') AS x FROM conversations)"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.transform(search.fallback_terms(F.col("text")), T.fold).alias("terms"))


def recall(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return search.recall_batch(index(spark, sf_dir), _probes(spark, sf_dir), k)


def recall_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall(spark, sf_dir, 5)


_BATCH = f"""
WITH t AS (SELECT doc_id AS id, {_TOKENS} AS ts FROM documents),
s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
q0 AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{4,}}') AS x FROM benchmark),
q AS (SELECT DISTINCT query_id, {_FOLD.format('term')} AS term FROM (SELECT query_id, unnest({_TERMS_SQL}) AS term FROM q0)),
p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT query_id, id, round(sum({_WEIGHT.format(d='df', f='tf')}), 6) AS score FROM q JOIN p USING (term) JOIN d USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM w QUALIFY rank <= 5)
"""
RECALL_BATCH = _BATCH + "SELECT query_id, id, score, rank FROM r"


def recall_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all probes were answered with, counted as accesses of the texts: probes ask at times of their own."""
    hits = recall_batch(spark, sf_dir).withColumn("at", (F.col("query_id") % 50).cast("double"))
    base = texts(spark, sf_dir).select("id", F.lit(0).alias("access_count"), F.lit(None).cast("double").alias("last_accessed"))
    counted = store.apply_accesses(base, store.fold_accesses(search.accesses(hits, F.col("at"))))
    return counted.select("id", F.col("access_count").cast("long").alias("access_count"), "last_accessed")


RECALL_ACCESSES = _BATCH + "SELECT doc_id AS id, count(r.query_id) AS access_count, CAST(max(r.query_id % 50) AS DOUBLE) AS last_accessed FROM documents LEFT JOIN r ON r.id = doc_id GROUP BY doc_id"


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each probe the rank of the first recalled text that has the probe's passage, and a category of its length."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    hits = search.with_texts(recall_batch(spark, sf_dir), _probes(spark, sf_dir), texts(spark, sf_dir)).join(items, "query_id")
    first = hits.where(F.contains("content", "passage")).groupBy("query_id").agg(F.min("rank").alias("rank"))
    category = F.when(F.length("passage") >= 200, "long").otherwise("short")
    return items.join(first, "query_id", "left").select("query_id", category.alias("category"), "rank")


_RANKS = _BATCH + """, f AS (SELECT r.query_id, min(rank) AS rank FROM r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.id WHERE contains(d.text, b.text) GROUP BY 1),
k AS (SELECT item_id AS query_id, CASE WHEN length(text) >= 200 THEN 'long' ELSE 'short' END AS category, rank FROM benchmark LEFT JOIN f ON f.query_id = item_id)
"""


def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir).select("query_id", "rank", F.round(F.coalesce(1 / F.col("rank"), F.lit(0.0)), 6).alias("reciprocal"))


RECALL_MRR = _RANKS + "SELECT query_id, rank, round(coalesce(1.0 / rank, 0.0), 6) AS reciprocal FROM k"


def hit_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates and mean reciprocal rank, overall (null category) and by category in one pass."""
    rows = _ranks(spark, sf_dir)
    return rows.groupingSets([["category"], []], "category").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("rank") == 1).alias("hit1"),
        F.count("rank").alias("hit5"),
        F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
    )


HIT_BY_CATEGORY = _RANKS + "SELECT category, count(*) AS n, count(*) FILTER (rank = 1) AS hit1, count(rank) AS hit5, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM k GROUP BY GROUPING SETS ((category), ())"


def score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalled rows that score at least 0.7 of their query's best."""
    rows = recall_batch(spark, sf_dir)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return rows.withColumn("best", best).where("best <= 0 or score >= 0.7 * best").select("query_id", "id", "score", "rank")


SCORE_FLOOR = _BATCH + "SELECT query_id, id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM r) WHERE best <= 0 OR score >= 0.7 * best"


def abstain_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that name an identifier which none of their candidates has: nothing is returned for them."""
    probes = _probes(spark, sf_dir).withColumn("terms", F.concat("terms", F.array(F.concat(F.lit("item"), F.col("query_id").cast("string")))))
    hits = search.with_texts(recall_batch(spark, sf_dir), _probes(spark, sf_dir), texts(spark, sf_dir)).withColumn("own", T.tokens("content")).drop("content")
    known = probes.select("query_id", F.explode("terms").alias("term")).join(hits, "query_id", "left")
    has = F.coalesce(F.bool_or(F.array_contains("own", F.col("term"))), F.lit(False))
    odd = F.regexp_like("term", F.lit("[0-9]")) & (F.length("term") >= 4)
    per_term = known.groupBy("query_id", "term").agg(has.alias("has"))
    return per_term.groupBy("query_id").agg(F.bool_or(odd & ~F.col("has")).alias("abstains"), F.count_if(F.col("has")).alias("found_terms"))


ABSTAIN_IDENTIFIERS = _BATCH + """, q2 AS (SELECT * FROM q UNION SELECT item_id, 'item' || item_id FROM benchmark),
o AS (SELECT q2.query_id, q2.term, coalesce(bool_or(list_contains(t.ts, q2.term)), false) AS has FROM q2 LEFT JOIN r ON r.query_id = q2.query_id LEFT JOIN t ON t.id = r.id GROUP BY 1, 2)
SELECT query_id, bool_or(regexp_matches(term, '[0-9]') AND length(term) >= 4 AND NOT has) AS abstains, count(*) FILTER (has) AS found_terms FROM o GROUP BY query_id
"""

NAMES = (
    "index_terms fts_topk fts_filtered fts_phrase literal_recall count_matching list_recent list_by_importance describe_store count_by_namespace dedup_proposals dedup_exact dedup_members dedup_preview dedup_losers access_fold ring_last3 "
    "latest_outcome audit_scoped turn_capture identity_signals fallback_terms recall_batch recall_accesses recall_mrr hit_by_category score_floor abstain_identifiers"
).split()
