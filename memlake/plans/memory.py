"""Queries of memory states over the driver tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import memory as M
from memlake.operators.store import visible
from memlake.sources.tables import events, importance, table, texts, turns, with_importance

_SCOPE = "CASE WHEN doc_id % 7 = 3 THEN 'hidden' WHEN doc_id % 5 = 0 THEN 'global' ELSE 'session' END"


def _scope(i: Column) -> Column:
    return F.when(i % 7 == 3, "hidden").when(i % 5 == 0, "global").otherwise("session")


def _stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts in two stores: even ids are working rows, every third one is an episodic one."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("session_id"), _scope(F.col("doc_id")).alias("scope"), F.col("n_chars").alias("n"))
    return rows.where("id % 2 = 0"), rows.where("id % 3 = 0")


_STORES = f"""d AS (SELECT doc_id AS id, source AS session_id, {_SCOPE} AS scope, n_chars AS n FROM documents),
b AS (SELECT *, 'working' AS store FROM d WHERE id % 2 = 0 UNION ALL SELECT *, 'episodic' FROM d WHERE id % 3 = 0)"""
_SEEN = "((scope = 'session' AND session_id = asker) OR scope = 'global')"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "src0").otherwise(F.col("source")).alias("asker"))


_REQUESTS = "rq AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'src0' ELSE source END AS asker FROM documents)"


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.lookup(_requests(spark, sf_dir), *_stores(spark, sf_dir)).select("id", "asker", "store", "n")


POINT_LOOKUP = f"WITH {_STORES}, {_REQUESTS} SELECT id, asker, store, n FROM (SELECT *, row_number() OVER (PARTITION BY id, asker ORDER BY store DESC) AS k FROM rq JOIN b USING (id) WHERE {_SEEN}) WHERE k = 1"


def insert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), F.col("text").alias("content"), F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("importance"), (F.col("doc_id") * 7 % 100).alias("timestamp"), F.col("lang").alias("source"))
    return M.insert_folding(rows.withColumn("veracity", F.when(F.col("id") % 3 == 0, "unknown").when(F.col("id") % 3 == 1, "stated").otherwise("derived")))


INSERT_DEDUP = """WITH r AS (SELECT source AS session_id, sha256(text) AS digest, doc_id AS id, doc_id % 10 AS importance, doc_id * 7 % 100 AS t, lang, CASE doc_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'stated' ELSE 'derived' END AS v FROM documents)
SELECT session_id, digest, arg_min(id, struct_pack(a := t, b := id)) AS id, max(importance) AS importance, max(t) AS timestamp, arg_max(lang, struct_pack(a := t, b := id)) AS source,
coalesce(arg_max(v, struct_pack(a := t, b := id)) FILTER (v <> 'unknown'), 'unknown') AS veracity, count(*) AS writes FROM r GROUP BY session_id, digest"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    op = F.element_at(F.array(*[F.lit(x) for x in ("remember", "update", "forget", "invalidate", "remember", "update", "attach")]), F.when(F.col("event_id") % 90 == 89, 7).otherwise(F.col("event_id") % 6 + 1).cast("int"))
    content = F.when(F.col("event_id") % 50 == 4, " ").when(F.col("event_id") % 6 == 1, F.lit(None)).otherwise(F.col("event_type"))
    return e.select("event_id", F.floor(F.col("event_id") / 8).alias("batch"), op.alias("op"), F.when(F.col("event_id") % 70 != 8, F.col("user_id")).alias("id"), content.alias("content"), F.when(F.col("event_id") % 100 == 1, F.lit(None)).otherwise(F.col("value") / 100).alias("importance"))


_BATCHES = """o AS (SELECT event_id, event_id // 8 AS batch, CASE WHEN event_id % 90 = 89 THEN 'attach' ELSE ['remember', 'update', 'forget', 'invalidate', 'remember', 'update'][event_id % 6 + 1] END AS op, CASE WHEN event_id % 70 <> 8 THEN user_id END AS id,
CASE WHEN event_id % 50 = 4 THEN ' ' WHEN event_id % 6 = 1 THEN NULL ELSE event_type END AS content, CASE WHEN event_id % 100 <> 1 THEN value / 100 END AS importance FROM events),
k AS (SELECT *, CASE WHEN op = 'attach' THEN 'unknown operation' WHEN op <> 'remember' AND id IS NULL THEN 'id is required' WHEN op = 'remember' AND trim(coalesce(content, '')) = '' THEN 'content is required'
WHEN op = 'update' AND trim(coalesce(content, '')) = '' AND importance IS NULL THEN 'nothing to update' WHEN NOT coalesce(importance BETWEEN 0 AND 1, true) THEN 'importance must be 0 to 1' END AS error FROM o)"""


def batch_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.check_operations(_batches(spark, sf_dir)).select("event_id", "batch", "op", "error")


BATCH_PREVIEW = f"WITH {_BATCHES} SELECT event_id, batch, op, error FROM k"


def batch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.applicable(_batches(spark, sf_dir)).select("event_id", "batch", "op")


BATCH_APPLY = f"WITH {_BATCHES} SELECT event_id, batch, op FROM k WHERE batch NOT IN (SELECT batch FROM k WHERE error IS NOT NULL)"


def invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    working, episodic = _stores(spark, sf_dir)
    rows = working.withColumn("store", F.lit("working")).unionByName(episodic.withColumn("store", F.lit("episodic")))
    rows = rows.withColumn("valid_until", F.when(F.col("id") % 10 == 0, F.lit(5)).cast("long")).withColumn("superseded_by", F.lit(None).cast("long"))
    asked = _requests(spark, sf_dir).where("id % 8 < 5").withColumn("at", F.col("id") + 1000).withColumn("replacement", F.when(F.col("id") % 3 == 1, F.col("id") + 1))
    return M.invalidate(rows, asked).select("id", "store", "valid_until", "superseded_by")


INVALIDATED = f"""WITH {_STORES}, {_REQUESTS}, h AS (SELECT id, store FROM (SELECT *, row_number() OVER (PARTITION BY id, asker ORDER BY store DESC) AS k FROM rq JOIN b USING (id) WHERE {_SEEN} AND id % 8 < 5) WHERE k = 1)
SELECT b.id, b.store, CASE WHEN h.id IS NOT NULL THEN b.id + 1000 WHEN b.id % 10 = 0 THEN 5 END AS valid_until, CASE WHEN h.id IS NOT NULL AND b.id % 3 = 1 THEN b.id + 1 END AS superseded_by FROM b LEFT JOIN h ON h.id = b.id AND h.store = b.store"""


def forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and vectors left after every fourth row was asked to be forgotten."""
    working, _ = _stores(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    rows, left = M.forget(working, vectors, _requests(spark, sf_dir).where("id % 4 = 0"))
    return rows.select("id", F.lit("row").alias("kind")).unionByName(left.select("id", F.lit("vector").alias("kind")))


FORGOTTEN = f"""WITH {_STORES}, {_REQUESTS}, g AS (SELECT id FROM b JOIN rq USING (id) WHERE store = 'working' AND id % 4 = 0 AND {_SEEN})
SELECT id, 'row' AS kind FROM b WHERE store = 'working' AND id NOT IN (SELECT id FROM g) UNION ALL SELECT vec_id, 'vector' FROM embeddings WHERE vec_id NOT IN (SELECT id FROM g)"""


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    action = F.when(F.col("event_id") % 97 == 5, "delete").when(F.col("event_id") % 9 == 1, "update").when(F.col("event_id") % 9 == 2, "invalidate").otherwise("attest")
    log = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.col("event_type").alias("validator"), action.alias("action"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("new_content"), F.col("event_id").alias("at"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("content"), F.lit(None).cast("long").alias("valid_until"))
    return M.validations(rows, log)


VALIDATED = """WITH l AS (SELECT event_id AS seq, user_id AS id, event_type AS v, CASE WHEN event_id % 97 = 5 THEN 'delete' WHEN event_id % 9 = 1 THEN 'update' WHEN event_id % 9 = 2 THEN 'invalidate' ELSE 'attest' END AS a FROM events),
m AS (SELECT *, min(seq) FILTER (a = 'delete') OVER (PARTITION BY id) AS e FROM l), s AS (SELECT id, arg_max(v, seq) AS validator, max(seq) AS validated_at, count(*) AS n, max(seq) FILTER (a = 'update') AS u, max(seq) FILTER (a = 'invalidate') AS i, bool_or(a = 'delete') AS gone FROM m WHERE e IS NULL OR seq <= e GROUP BY id)
SELECT c_custkey AS id, CASE WHEN u IS NOT NULL THEN 'text ' || u ELSE c_name END AS content, i AS valid_until, validator, validated_at, coalesce(n, 0) AS validation_count FROM customer LEFT JOIN s ON id = c_custkey WHERE NOT coalesce(gone, false)"""


def _slot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    action = F.when(F.col("o_orderkey") % 13 == 4, "forget").otherwise("remember")
    category = F.when(F.col("o_orderkey") % 2 == 0, "task:progress").otherwise("model:user")
    return o.select((F.col("o_custkey") % 50).alias("owner_id"), category.alias("category"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("seq"), action.alias("action"), F.concat("o_orderstatus", F.lit(" state")).alias("body"), F.col("o_orderkey").alias("at"))


_SLOT_LOG = """l AS (SELECT o_custkey % 50 AS owner_id, CASE WHEN o_orderkey % 2 = 0 THEN 'task:progress' ELSE 'model:user' END AS category, o_orderpriority AS name, o_orderkey AS seq, o_orderkey % 13 = 4 AS gone, o_orderstatus || ' state' AS body FROM orders),
p AS (SELECT *, lag(CASE WHEN NOT gone THEN body END) OVER (PARTITION BY owner_id, category, name ORDER BY seq) AS before FROM l), c AS (SELECT * FROM p WHERE gone OR before IS NULL OR before <> body),
e AS (SELECT *, lead(seq) OVER (PARTITION BY owner_id, category, name ORDER BY seq) AS valid_until FROM c), v AS (SELECT *, row_number() OVER (PARTITION BY owner_id, category, name ORDER BY seq) AS version FROM e WHERE NOT gone)"""
_SLOT = ["owner_id", "category", "name"]


def slot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.slot_versions(_slot_log(spark, sf_dir), _SLOT).select(*_SLOT, "version", "body", "at", "valid_until")


SLOT_HISTORY = f"WITH {_SLOT_LOG} SELECT owner_id, category, name, version, body, seq AS at, valid_until FROM v"


def slot_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.live(M.slot_versions(_slot_log(spark, sf_dir), _SLOT)).select(*_SLOT, "version", "body")


SLOT_RECALL = f"WITH {_SLOT_LOG} SELECT owner_id, category, name, version, body FROM v WHERE valid_until IS NULL"


def slot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.search_slots(M.slot_versions(_slot_log(spark, sf_dir), _SLOT), "F STATE", 20).select(*_SLOT, "at")


SLOT_SEARCH = f"WITH {_SLOT_LOG} SELECT owner_id, category, name, seq AS at FROM v WHERE valid_until IS NULL AND (contains(lower(body), 'f state') OR contains(lower(name), 'f state')) ORDER BY seq DESC, name, owner_id LIMIT 20"


def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.task_list(M.slot_versions(_slot_log(spark, sf_dir), _SLOT))


TASK_PROGRESS = f"WITH {_SLOT_LOG} SELECT owner_id, name AS task, substr(body, 1, 200) AS state, seq AS valid_from FROM v WHERE valid_until IS NULL AND category = 'task:progress'"


def triple_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as statements on customers: most replace what was said, some stand beside it, some end it."""
    o = table(spark, sf_dir, "orders")
    log = o.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("subject"), F.lit("has").alias("predicate"), F.col("o_orderstatus").alias("object"), F.col("o_orderkey").alias("at"), (F.col("o_orderkey") % 4 != 0).alias("supersede"), (F.col("o_orderkey") % 9 == 2).alias("ends"))
    return M.add_triples(log).select("seq", "subject", "object", "valid_until")


TRIPLE_STATES = """WITH l AS (SELECT o_orderkey AS seq, o_custkey AS s, o_orderstatus AS o, o_orderkey % 4 <> 0 AND o_orderkey % 9 <> 2 AS sup, o_orderkey % 9 = 2 AS e FROM orders)
SELECT a.seq, a.s AS subject, a.o AS object, min(b.seq) AS valid_until FROM l a LEFT JOIN l b ON b.s = a.s AND b.seq > a.seq AND (b.sup OR (b.e AND b.o = a.o)) WHERE NOT a.e GROUP BY ALL"""


def persona_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    action = F.when(F.col("event_id") % 10 == 0, "promote").when(F.col("event_id") % 29 == 7, "demote").otherwise("reinforce")
    tier = F.element_at(F.array(*[F.lit(t) for t in ("permanent", "long_term", "working", "draft")]), (F.col("event_id") % 4 + 1).cast("int"))
    log = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("memory_id"), action.alias("action"), tier.alias("tier"), F.col("event_id").alias("at"))
    found = M.personas(log).orderBy(*M.persona_order())
    return found.select("memory_id", "tier", "reinforcement_count", "last_reinforced_at")


PERSONA_LIST = """WITH l AS (SELECT event_id AS seq, user_id AS m, CASE WHEN event_id % 10 = 0 THEN 'promote' WHEN event_id % 29 = 7 THEN 'demote' ELSE 'reinforce' END AS a, ['permanent', 'long_term', 'working', 'draft'][event_id % 4 + 1] AS t FROM events),
s AS (SELECT *, max(seq) FILTER (a = 'promote') OVER (PARTITION BY m) AS b FROM l)
SELECT m AS memory_id, CASE WHEN bool_or(a = 'demote') THEN 'demoted' ELSE arg_max(t, seq) FILTER (a = 'promote') END AS tier, count(*) FILTER (a = 'reinforce') AS reinforcement_count, max(seq) FILTER (a = 'reinforce') AS last_reinforced_at FROM s WHERE seq >= b GROUP BY m"""


def native_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts mirrored from a host: a fifth of them is new, a seventh has changed, some are gone."""
    rows = texts(spark, sf_dir)
    entries = rows.where("id % 11 <> 0").select(F.col("namespace").alias("target"), F.col("id").alias("native_id"), "content")
    mapped = rows.where("id % 5 <> 0").select(F.col("namespace").alias("target"), F.col("id").alias("native_id"), F.when(F.col("id") % 7 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("content", 256)).alias("digest"))
    made, retired = M.mirror(entries, mapped)
    return made.select("native_id", "digest", F.lit("made").alias("change")).unionByName(retired.select("native_id", "digest", F.lit("retired").alias("change")))


NATIVE_MIRROR = """SELECT doc_id AS native_id, sha256(text) AS digest, 'made' AS change FROM documents WHERE doc_id % 11 <> 0 AND (doc_id % 5 = 0 OR doc_id % 7 = 0)
UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256('old') ELSE sha256(text) END, 'retired' FROM documents WHERE doc_id % 5 <> 0 AND (doc_id % 11 = 0 OR doc_id % 7 = 0)"""


def _summaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as working rows, suppliers as summaries of the parts that follow their key."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("consolidated_at"))
    s = table(spark, sf_dir, "supplier")
    lineage = F.array_join(F.transform(F.sequence(F.col("s_suppkey") * 10, F.col("s_suppkey") * 10 + 5), lambda k: k.cast("string")), ",")
    made = s.select(F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).alias("id"), lineage.alias("summary_of"), F.when(F.col("s_suppkey") % 4 > 0, 1).alias("coverage_version"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 3 == 1).alias("verified"))
    return parts, made


_SUMMARIES = """e AS (SELECT s_suppkey AS k, s_suppkey % 4 > 0 AND NOT coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 = 1 END, false) AS bad FROM supplier), x AS (SELECT k, bad, k * 10 + unnest(range(0, 6)) AS id FROM e)"""


def unconsolidated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unconsolidated(*_summaries(spark, sf_dir)).select("id")


UNCONSOLIDATED_ROWS = f"WITH {_SUMMARIES} SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey % 3 = 0 OR p_partkey IN (SELECT id FROM x WHERE bad)"


def cross_tier_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as results: parts as working rows, suppliers as summaries."""
    _, made = _summaries(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem")
    found = items.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").cast("string").alias("id"), F.lit("working").alias("tier")).union(items.select("l_orderkey", F.concat(F.lit("e"), F.col("l_suppkey").cast("string")), F.lit("episodic"))).distinct()
    return M.cross_tier(found, made).select("query_id", "id", "tier")


CROSS_TIER_RESULTS = f"""WITH {_SUMMARIES}, f AS (SELECT DISTINCT l_orderkey AS q, l_suppkey AS k FROM lineitem WHERE l_suppkey NOT IN (SELECT k FROM e WHERE bad))
SELECT DISTINCT l_orderkey AS query_id, CAST(l_partkey AS VARCHAR) AS id, 'working' AS tier FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM f JOIN x ON x.k = f.k WHERE f.q = l.l_orderkey AND x.id = l.l_partkey) UNION ALL SELECT q, 'e' || k, 'episodic' FROM f"""


def expired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"))
    return M.expired(rows, F.to_timestamp(F.lit("2024-01-20 00:00:00")), 48).select("id")


EXPIRED_ROWS = "SELECT event_id AS id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 48 HOUR"


def degradation_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).select("id", "created_at", (F.col("id") % 3 + 1).cast("int").alias("tier"))
    return M.degradation_batch(rows, F.lit(3000.0), 100).select("id", "created_at")


DEGRADATION_BATCH = "SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS created_at FROM documents WHERE doc_id % 3 < 2 AND n_chars < 3000 ORDER BY n_chars, doc_id LIMIT 100"


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.when(F.col("event_type") == "purchase", "global").otherwise("session")
    log = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("session_id"), scope.alias("scope"))
    return M.audit_count(log, visible("7"))


AUDIT_COUNTS = "SELECT count(*) AS n FROM events WHERE event_type = 'purchase' OR user_id = 7"


def store_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.store_report({n: table(spark, sf_dir, n) for n in ("documents", "conversations", "events", "embeddings", "labels")})


STORE_REPORT = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in ("documents", "conversations", "events", "embeddings", "labels"))


def known_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct names that annotations mention."""
    return table(spark, sf_dir, "part").where("p_name is not null").select(F.col("p_name").alias("value")).distinct()


KNOWN_ENTITIES = "SELECT DISTINCT p_name AS value FROM part WHERE p_name IS NOT NULL"


def bootstrap_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bootstrap(with_importance(texts(spark, sf_dir).drop("content"), importance(spark, sf_dir)), 20)


BOOTSTRAP_LIST = """SELECT doc_id AS id, CASE WHEN quality = 1 THEN 8 WHEN quality IS NULL THEN 5 ELSE 2 END AS importance, 'memory:' || source || '/' || doc_id AS provenance FROM documents LEFT JOIN labels USING (doc_id) ORDER BY importance DESC, n_chars DESC, doc_id LIMIT 20"""


def inspect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.inspect(texts(spark, sf_dir))
    return found.select("id", "content_truncated", F.md5(F.col("content").cast("binary")).alias("digest"))


INSPECT_ROWS = "SELECT doc_id AS id, length(text) > 4000 AS content_truncated, md5(substr(text, 1, 4000)) AS digest FROM documents"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("session_id", F.struct("turn", "role", "content").alias("seq"), "role", "content")


def compression_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.compression_excerpt(_messages(spark, sf_dir), 6, 5000, 3, 400).select("session_id", F.md5(F.col("excerpt").cast("binary")).alias("digest"))


COMPRESSION_EXCERPT = """WITH m AS (SELECT conv_id, role, trim(text) AS c, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations), s AS (SELECT * FROM m WHERE n <= 6 AND role IN ('user', 'assistant') AND c <> ''),
u AS (SELECT *, sum(strlen(c)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS b FROM s), e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM u WHERE b <= 5000),
r AS (SELECT *, 400 - coalesce(sum(length(c)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM e WHERE k <= 3)
SELECT conv_id AS session_id, md5(string_agg('[' || role || '] ' || substr(c, 1, CAST(room AS BIGINT)), chr(10) ORDER BY turn, role, text)) AS digest FROM r WHERE room > 0 GROUP BY conv_id"""


def checkpoint_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose evidence isn't written yet: those of even ids are."""
    plain = turns(spark, sf_dir).select("session_id", F.struct("turn", "role", "content").alias("seq"), F.col("role"), F.md5(F.col("content").cast("binary")).alias("content"))
    keys = M.checkpoint_keys(plain)
    return M.unwritten(keys, keys.where("session_id % 2 = 0")).select("session_id", "name")


CHECKPOINT_NAMES = """WITH m AS (SELECT conv_id, turn, role, text, sha256('{"content":"' || md5(text) || '","role":"' || role || '"}') AS d FROM conversations)
SELECT conv_id AS session_id, sha256(CAST(conv_id AS VARCHAR)) || '-' || sha256(string_agg(d, '' ORDER BY turn, role, text)) AS name FROM m WHERE conv_id % 2 = 1 GROUP BY conv_id"""

NAMES = (
    "point_lookup insert_dedup batch_preview batch_apply invalidated forgotten validated slot_history slot_recall slot_search task_progress triple_states persona_list native_mirror unconsolidated_rows "
    "cross_tier_results expired_rows degradation_batch audit_counts store_report known_entities bootstrap_list inspect_rows compression_excerpt checkpoint_names"
).split()
