"""Consolidation, degradation and streaming queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.text import KEY_TOKEN, LOWER, UPPER
from memlake.operators import consolidate, plugins
from memlake.operators.store import fold_operations
from memlake.sources import strict
from memlake.sources.tables import events, shared_folder, table, texts, turns
from memlake.streaming import capture, ledger, sync, working


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    until = F.when(F.col("turn") % 2 == 1, 1000 - F.col("turn"))
    return rows.select("session_id", F.struct("turn", "role", "content").alias("seq"), F.concat_ws("-", F.col("turn").cast("string"), "role").alias("id"), "content", until.alias("valid_until"), F.when(F.col("role") == "system", "session").otherwise("global").alias("scope"))


def consolidate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations consolidated; verified are those whose turns have one end and one scope."""
    rows = _sources(spark, sf_dir)
    made = consolidate.consolidate(rows)
    checked = made.join(consolidate.covered(made, rows), ["session_id", "part"])
    return checked.select("session_id", F.md5(F.col("summary").cast("binary")).alias("digest"), "valid_until", "scope", "sources", "verified")


CONSOLIDATE_SOURCES = """SELECT conv_id AS session_id, md5(string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' | ' ORDER BY turn, role, text)) AS digest,
min(CASE WHEN turn % 2 = 1 THEN 1000 - turn END) AS valid_until, CASE WHEN bool_and(role <> 'system') THEN 'global' ELSE 'session' END AS scope, count(*) AS sources,
count(DISTINCT coalesce(CASE WHEN turn % 2 = 1 THEN 1000 - turn END, -1)) = 1 AND count(DISTINCT role = 'system') = 1 AND bool_and(trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '') AS verified FROM conversations GROUP BY conv_id"""


def _covered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in parts of three: ends, scopes and labels differ within some conversations."""
    rows = turns(spark, sf_dir).where("length(trim(content)) > 0")
    i, turn = F.col("session_id"), F.col("turn")
    metadata = (
        F.when((i % 7 == 1) & (turn % 2 == 0), '{"canonical_name": "nowhere said"}')
        .when(i % 7 == 2, F.to_json(F.struct(F.array(F.substring(F.regexp_replace("content", r"[^A-Za-z ]", ""), 1, 3)).alias("aliases"))))
        .when(i % 7 == 3, "{broken")
        .when(i % 7 == 4, '{"aliases": "no list"}')
        .when(i % 7 == 5, '{"canonical_name": ""}')
    )
    until = F.when(i % 5 == 0, turn % 2).when(i % 5 == 1, 7)
    scope = F.when((i % 3 == 0) & (turn % 4 == 3), "global").otherwise("session")
    # Roles of one turn number come in their order.
    return rows.select("session_id", F.struct("turn", "role", "content").alias("seq"), F.concat_ws("-", turn.cast("string"), "role").alias("id"), "content", until.alias("valid_until"), scope.alias("scope"), metadata.alias("metadata"))


def coverage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which summaries, some of them cut, put in capitals or with thoughts in them, say what their sources say."""
    rows = _covered_sources(spark, sf_dir)
    made = consolidate.consolidate(rows, most=3)
    told = F.when(F.col("session_id") % 11 == 0, F.expr("substring(summary, 1, length(summary) - 1)")).when(F.col("session_id") % 11 == 1, F.translate("summary", LOWER, UPPER)).when(F.col("session_id") % 11 == 2, F.concat(F.lit("<think>so\nit is</think> "), "summary")).otherwise(F.col("summary"))
    return consolidate.covered(made.withColumn("summary", told), rows, most=3)


COVERAGE_CHECKS = """WITH s AS (SELECT conv_id AS i, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS line, substr(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 1, 3) AS alias,
CASE WHEN conv_id % 5 = 0 THEN turn % 2 WHEN conv_id % 5 = 1 THEN 7 END AS until, CASE WHEN conv_id % 3 = 0 AND turn % 4 = 3 THEN 'global' ELSE 'session' END AS scope, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 3 AS INT) AS part,
row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations WHERE length(trim(text)) > 0),
g AS (SELECT i, part, string_agg(line, ' | ' ORDER BY k) AS txt, bool_and(line <> '') AS said, count(DISTINCT coalesce(until, -1)) = 1 AS one_end, count(DISTINCT scope) = 1 AS one_scope,
CASE i % 7 WHEN 1 THEN bool_and(turn % 2 = 1) WHEN 2 THEN count(DISTINCT alias) = 1 WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS one_label, lower(trim(regexp_replace(min(alias), '\\s+', ' ', 'g'))) AS al FROM s GROUP BY i, part)
SELECT i AS session_id, part, i % 11 <> 0 AND said AND one_end AND one_scope AND one_label AND (i % 7 <> 2 OR contains(txt, al)) AS verified FROM g"""


def consolidated_veracity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What most of a conversation's turns rest on, in parts of four; ties go to the more careful label."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("stated", "Inferred", "tool", "imported", "made up")]), ((F.col("turn") * F.col("turn") + F.col("session_id")) % 5 + 1).cast("int"))
    rows = _sources(spark, sf_dir).withColumn("turn", F.col("seq.turn")).withColumn("veracity", F.when(F.col("turn") % 9 < 8, kinds))
    return consolidate.veracity(rows, most=4)


CONSOLIDATED_VERACITY = """WITH s AS (SELECT conv_id AS i, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 4 AS INT) AS part, CASE WHEN turn % 9 < 8 THEN CAST((turn * turn + conv_id) % 5 AS INT) ELSE 4 END AS v FROM conversations),
c AS (SELECT i, part, v, count(*) AS n FROM s GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY i, part ORDER BY n DESC, [5, 4, 3, 2, 1][v + 1]) AS k FROM c)
SELECT i AS session_id, part, ['stated', 'inferred', 'tool', 'imported', 'unknown'][v + 1] AS veracity FROM o WHERE k = 1"""


def degrade_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).select("id", "content", (F.col("id") % 3 + 1).cast("int").alias("tier"))
    return consolidate.degrade(rows).select("id", F.col("tier").cast("long").alias("tier"), "copy_id", "size", "lost_keys", "accepted", F.md5(F.col("copy").cast("binary")).alias("digest"))


_KEYS = "list_distinct(list_transform(list_filter(regexp_extract_all({}, '" + KEY_TOKEN + "'), lambda t: regexp_matches(t, '[0-9A-Z]')), lambda t: lower(t)))"
DEGRADE_TIERS = f"""WITH a AS (SELECT doc_id AS id, text, doc_id % 3 + 1 AS tier, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents WHERE doc_id % 3 < 2),
b AS (SELECT *, CASE WHEN tier = 1 THEN 800 ELSE 300 END AS m FROM a), c AS (SELECT *, CASE WHEN length(f) <= m THEN f ELSE rtrim(substr(f, 1, m - 1)) || '…' END AS s FROM b),
d AS (SELECT *, {_KEYS.format('s')} AS ks FROM c), e AS (SELECT *, len(list_filter({_KEYS.format('text')}, lambda x: NOT list_contains(ks, x))) AS lost FROM d)
SELECT id, tier + 1 AS tier, substr(sha256(id || '|' || (tier + 1)), 1, 32) AS copy_id, length(s) AS size, lost AS lost_keys, lost = 0 AS accepted, CASE WHEN lost = 0 THEN md5(s) END AS digest FROM e"""


def operation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as operations on one memory, folded to its state."""
    e = events(spark, sf_dir)
    kinds = F.when(F.col("event_id") % 11 == 0, "forget").when(F.col("event_id") % 5 == 0, "invalidate").when(F.col("event_id") % 2 == 0, "update").otherwise("remember")
    ops = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), kinds.alias("op"), F.col("event_type").alias("content"), F.floor("value").alias("importance"), F.col("ts").alias("at"))
    return fold_operations(ops)


OPERATION_LOG = """WITH o AS (SELECT user_id AS id, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'forget' WHEN event_id % 5 = 0 THEN 'invalidate' WHEN event_id % 2 = 0 THEN 'update' ELSE 'remember' END AS op,
event_type AS content, CAST(floor(value) AS BIGINT) AS importance, ts FROM events), s AS (SELECT *, max(seq) FILTER (op IN ('remember', 'forget')) OVER (PARTITION BY id) AS b FROM o), l AS (SELECT * FROM s WHERE b IS NULL OR seq >= b)
SELECT id, arg_max(content, seq) FILTER (op IN ('remember', 'update')) AS content, arg_max(importance, seq) FILTER (op IN ('remember', 'update')) AS importance, max(ts) FILTER (op = 'invalidate') AS valid_until
FROM l GROUP BY id HAVING bool_or(op = 'remember') AND NOT bool_or(op = 'forget')"""


def stream_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_folder(spark, "stream")
    source = table(spark, sf_dir, "conversations")
    stream = capture.stream_parquet(spark, f"{sf_dir}/conversations.parquet*", source.schema).select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))
    capture.run_available(capture.capture_turns(stream), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select("session_id", "turn", "role", "importance", "content")


STREAM_CAPTURE = """SELECT * FROM (SELECT conv_id AS session_id, turn, role, CASE WHEN role = 'user' AND length(text) > 5 THEN CAST(0.5 AS DOUBLE) WHEN role = 'assistant' AND length(text) > 10 THEN 0.15 WHEN role = 'tool' THEN 0.2 END AS importance,
text AS content FROM conversations WHERE trim(text) <> '') WHERE importance IS NOT NULL"""


def stream_access_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_folder(spark, "stream")
    stream = capture.stream_parquet(spark, f"{sf_dir}/events.parquet*", events(spark, sf_dir).schema).select(F.col("user_id").alias("id"), F.col("ts").alias("at"))
    capture.run_counts(capture.access_counts(stream), f"{at}/out", f"{at}/state")
    batches = spark.read.parquet(f"{at}/out")
    return batches.groupBy("id").agg(F.max_by("hits", "batch").alias("hits"), F.max_by("last_accessed", "batch").alias("last_accessed"))


STREAM_ACCESS_COUNTS = "SELECT user_id AS id, count(*) AS hits, max(ts) AS last_accessed FROM events GROUP BY user_id"


def session_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.session_spans(events(spark, sf_dir), "6 hours")


SESSION_SPANS = """WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, min(ts) AS begins, max(ts) + INTERVAL 6 HOUR AS ends, count(*) AS n FROM s GROUP BY user_id, s"""


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.col("event_type").alias("op"))
    return capture.change_feed(changes, 1000, 500)


CHANGE_FEED = "SELECT event_id AS seq, user_id AS id, event_type AS op FROM events WHERE event_id > 1000 ORDER BY event_id LIMIT 500"

def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed as a stream, run twice over the same table: the second run finds nothing new."""
    at = shared_folder(spark, "stream")
    for _ in range(2):
        stream = capture.stream_parquet(spark, f"{sf_dir}/events.parquet*", events(spark, sf_dir).schema)
        capture.run_change_feed(stream.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.col("event_type").alias("op")), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


STREAM_CHANGES = "SELECT event_id AS seq, user_id AS id, event_type AS op FROM events"


def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_folder(spark, "stream")
    stream = capture.stream_parquet(spark, f"{sf_dir}/events.parquet*", events(spark, sf_dir).schema)
    rows = capture.audit_rows(stream.select("event_id", F.col("ts").alias("at"), F.col("event_type").alias("action"), F.col("user_id").alias("memory_id"), F.col("props").alias("detail")))
    capture.run_available(rows, f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


STREAM_AUDIT = "SELECT event_id, ts AS at, event_type AS action, user_id AS memory_id, sha256(coalesce(props, '')) AS detail_sha256 FROM events"


def stream_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of four turns or more, consolidated as they arrive."""
    at = shared_folder(spark, "stream")
    source = table(spark, sf_dir, "conversations")
    stream = capture.stream_parquet(spark, f"{sf_dir}/conversations.parquet*", source.schema)
    rows = stream.select(F.col("conv_id").alias("session_id"), F.struct("turn", "role", "text").alias("seq"), F.concat_ws("-", F.col("turn").cast("string"), "role").alias("id"), F.col("text").alias("content"), F.lit(None).cast("long").alias("valid_until"), F.lit("session").alias("scope"))
    capture.run_consolidation(rows, f"{at}/out", f"{at}/state", 4)
    return spark.read.parquet(f"{at}/out").select("session_id", F.md5(F.col("summary").cast("binary")).alias("digest"), "sources")


STREAM_CONSOLIDATION = "SELECT conv_id AS session_id, md5(string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' | ' ORDER BY turn, role, text)) AS digest, count(*) AS sources FROM conversations GROUP BY conv_id HAVING count(*) >= 4"


def kept_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by context and speaker: those that an agent says to itself aren't kept."""
    rows = turns(spark, sf_dir)
    context = F.element_at(F.array(*[F.lit(c) for c in ("chat", "cron", "chat", "subagent")]), (F.col("turn") % 4 + 1).cast("int"))
    marked = rows.select("session_id", "turn", "role", "content", context.alias("context"), F.when(F.col("role") == "user", "user").otherwise("agent").alias("speaker"), F.when(F.col("session_id") % 3 == 0, "other").alias("owner"))
    return capture.worth_keeping(marked, "me").select("session_id", "turn", "role")


KEPT_TURNS = "SELECT conv_id AS session_id, turn, role FROM conversations WHERE turn % 2 = 0 AND role = 'user' AND conv_id % 3 <> 0 AND trim(text) <> ''"


def identity_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth turn says who its user is."""
    rows = turns(spark, sf_dir).withColumn("content", F.when(F.col("turn") % 5 == 0, F.concat(F.lit("I'm proud of this. "), "content")).otherwise(F.col("content")))
    return capture.identity_memories(rows).select("session_id", "turn", "importance", "scope", F.md5(F.col("content").cast("binary")).alias("digest"))


IDENTITY_TURNS = "SELECT conv_id AS session_id, turn, CAST(0.85 AS DOUBLE) AS importance, 'global' AS scope, md5(substr('I''m proud of this. ' || text, 1, 400)) AS digest FROM conversations WHERE role = 'user' AND turn % 5 = 0"

def json_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, some with a double key, some broken, some lists."""
    i = F.col("event_id")
    text = F.when(i % 7 == 1, F.lit('{"k": 1, "k": 2}')).when(i % 7 == 2, F.lit("{no")).when(i % 7 == 3, F.lit("[1]")).otherwise(F.col("props"))
    return strict.json_faults(events(spark, sf_dir).select("event_id", text.alias("j")), "j").select("event_id", "fault")


JSON_FAULTS = "SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'double key' WHEN 2 THEN 'not JSON' WHEN 3 THEN 'no object' END AS fault FROM events"


def evidence_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as sections, and which of them a bounded index names."""
    rows = texts(spark, sf_dir).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("title"), "content")
    return strict.evidence_markdown(rows, 1000).select("id", "indexed", F.md5(F.col("section").cast("binary")).alias("digest"))


EVIDENCE_SECTIONS = """SELECT doc_id AS id, sum(length('- text ' || doc_id) + 1) OVER (ORDER BY doc_id) <= 1000 AS indexed, md5('## text ' || doc_id || chr(10) || chr(10) || text || chr(10)) AS digest FROM documents"""


def migrated_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a store of the second version, brought to the present one."""
    old = texts(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "content", "namespace", "created_at", F.lit(7).alias("importance"))
    return strict.migrate(old, 1).select("id", "namespace", "importance", "context", "access_count", "last_accessed", "created_at")


MIGRATED_STORE = "SELECT CAST(doc_id AS VARCHAR) AS id, source AS namespace, 7 AS importance, CAST(NULL AS VARCHAR) AS context, 0 AS access_count, CAST(NULL AS DOUBLE) AS last_accessed, CAST(n_chars AS DOUBLE) AS created_at FROM documents"


def plugin_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the default summariser gives for each turn, and the judgment of a rule where no model is injected."""
    rows = turns(spark, sf_dir).withColumn("summary", plugins.apply("summarise", "content"))
    judged = plugins.judged(rows, F.col("content"), F.when(F.length("content") > 200, "long").otherwise("short"))
    return judged.select("session_id", "turn", "role", F.md5(F.col("summary").cast("binary")).alias("digest"), "judgment")


PLUGIN_SUMMARIES = "SELECT conv_id AS session_id, turn, role, md5(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), '. ')[1]) AS digest, CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS judgment FROM conversations"



def _pushed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as a store, orders as changes of their customer's text: on the first text, on a later one, or on none."""
    store = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("content"), F.lit(0).cast("long").alias("seq")).where("id % 5 > 0")
    text = lambda status: F.concat(F.lit("status "), status)
    key = F.col("o_orderkey")
    base = F.when(key % 4 == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).when(key % 4 == 1, text(F.lit("F"))).when(key % 4 == 2, text(F.lit("O")))
    changes = table(spark, sf_dir, "orders").select(key.alias("seq"), F.col("o_custkey").alias("id"), sync.digest(base).alias("base_digest"), text(F.col("o_orderstatus")).alias("content"))
    return store, changes


def sync_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, changes = _pushed(spark, sf_dir)
    return sync.judge(changes, store).select("seq", "id", "outcome", "digest")


_SYNC = """ch AS (SELECT o_orderkey AS seq, o_custkey AS id, CASE o_orderkey % 4 WHEN 0 THEN sha256('Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')) WHEN 1 THEN sha256('status F') WHEN 2 THEN sha256('status O') END AS base,
  sha256('status ' || o_orderstatus) AS digest, 'status ' || o_orderstatus AS content, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
st AS (SELECT c_custkey AS id, sha256(c_name) AS held, c_name AS content FROM customer WHERE c_custkey % 5 > 0),
fo AS (SELECT DISTINCT ch.id, CAST(0 AS BIGINT) AS k, st.held, CAST(NULL AS BIGINT) AS seq, '' AS outcome, '' AS digest, '' AS content FROM ch LEFT JOIN st USING (id) UNION ALL
  SELECT id, k, CASE WHEN outcome = 'accepted' THEN digest ELSE held END, seq, outcome, digest, content FROM (SELECT ch.id, ch.k, ch.seq, ch.digest, ch.content, fo.held, CASE WHEN ch.digest IS NOT DISTINCT FROM fo.held THEN 'duplicate' WHEN ch.base IS NOT DISTINCT FROM fo.held THEN 'accepted' ELSE 'conflict' END AS outcome
  FROM fo JOIN ch ON ch.id = fo.id AND ch.k = fo.k + 1))"""
SYNC_PUSH = f"WITH RECURSIVE {_SYNC} SELECT seq, id, outcome, digest FROM fo WHERE k > 0"


def stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes pushed as a stream, twice over the same files: the store afterwards, each text with its number."""
    store, changes = _pushed(spark, sf_dir)
    at = shared_folder(spark, "sync")
    sync.open_store(store, at)
    for _ in range(2):
        stream = capture.stream_parquet(spark, f"{sf_dir}/orders.parquet*", table(spark, sf_dir, "orders").schema)
        text = F.concat(F.lit("status "), F.col("o_orderstatus"))
        key = F.col("o_orderkey")
        base = F.when(key % 4 == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).when(key % 4 == 1, "status F").when(key % 4 == 2, "status O")
        sync.run_push(stream.select(key.alias("seq"), F.col("o_custkey").alias("id"), sync.digest(base).alias("base_digest"), text.alias("content")), at)
    versions = spark.read.parquet(f"{at}/store")
    last = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == last).select("id", "content", "seq")


STREAM_SYNC = f"""WITH RECURSIVE {_SYNC}, la AS (SELECT id, arg_max(content, seq) AS content, max(seq) AS seq FROM fo WHERE outcome = 'accepted' GROUP BY id)
SELECT id, content, CAST(0 AS BIGINT) AS seq FROM st WHERE id NOT IN (SELECT id FROM la) UNION ALL SELECT id, content, seq FROM la"""


def _entries(rows: DataFrame) -> DataFrame:
    """Events as entries of a ledger: a user is an attempt, the type tells the kind; some users are never validated."""
    i, kind = F.col("event_id"), F.col("event_type")
    kinds = F.when((i % 7 == 0) & (F.col("user_id") % 3 > 0), "validate").when(kind == "click", "predict").when(kind == "view", "before").otherwise("after")
    return rows.select(F.col("user_id").cast("string").alias("attempt"), F.col("ts").cast("timestamp").alias("at"), i.alias("seq"), kinds.alias("kind"), F.concat(F.lit("case"), (F.floor("value") % 6).cast("string")).alias("case_id"), (F.col("value") % 2 >= 1).alias("passed"))


def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger over all events in one run, every entry twice, and its validated attempts."""
    at = shared_folder(spark, "ledger")
    rows = _entries(events(spark, sf_dir))
    rows.unionByName(rows).write.parquet(f"{at}/in")
    # All files are one batch: an attempt's validation counts what comes with it.
    stream = capture.stream_parquet(spark, f"{at}/in", rows.schema, files_per_batch=2**31 - 1)
    ledger.run_ledger(stream, f"{at}/out", f"{at}/state", hours=24 * 365)
    return spark.read.parquet(f"{at}/out").where("status = 'validated'")


STREAM_LEDGER = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS attempt, event_id AS seq, CASE WHEN event_id % 7 = 0 AND user_id % 3 > 0 THEN 'validate' WHEN event_type = 'click' THEN 'predict' WHEN event_type = 'view' THEN 'before' ELSE 'after' END AS kind,
'case' || (CAST(floor(value) AS BIGINT) % 6) AS case_id, value % 2 >= 1 AS passed FROM events), f AS (SELECT attempt, min(seq) AS first FROM e WHERE kind = 'after' GROUP BY 1),
c AS (SELECT attempt, case_id, bool_or(kind = 'predict' AND (first IS NULL OR seq < first)) AS foretold, arg_max(passed, seq) FILTER (kind = 'before') AS was, arg_max(passed, seq) FILTER (kind = 'after') AS now,
count(*) FILTER (kind = 'predict' AND seq > first) AS late FROM e LEFT JOIN f USING (attempt) WHERE kind <> 'validate' GROUP BY 1, 2),
s AS (SELECT attempt, count(*) FILTER (foretold AND NOT was AND now) AS fixed, count(*) FILTER (foretold AND was IS NOT NULL AND NOT now) AS missed, count(*) FILTER (foretold AND was AND now) AS already, count(*) FILTER (NOT foretold AND was AND NOT now) AS collateral,
CAST(sum(late) AS BIGINT) AS too_late, count(*) FILTER (now) AS passed, count(now) AS total FROM c GROUP BY 1)
SELECT attempt, 'validated' AS status, coalesce(fixed, 0) AS fixed, coalesce(missed, 0) AS missed, coalesce(already, 0) AS already, coalesce(collateral, 0) AS collateral, coalesce(too_late, 0) AS too_late, coalesce(passed, 0) AS passed, coalesce(total, 0) AS total
FROM (SELECT DISTINCT attempt FROM e WHERE kind = 'validate') LEFT JOIN s USING (attempt)"""


def ledger_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the table at once."""
    return ledger.outcomes_of(_entries(events(spark, sf_dir)))


LEDGER_OUTCOMES = STREAM_LEDGER

def stream_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn three times over, as clients send again what wasn't confirmed; each is kept once."""
    at = shared_folder(spark, "turns")
    rows = turns(spark, sf_dir).withColumn("at", (F.lit(1_700_000_000) + F.col("session_id") * 60 + F.col("turn")).cast("timestamp"))
    rows.unionByName(rows).unionByName(rows).write.parquet(f"{at}/in")
    stream = capture.stream_parquet(spark, f"{at}/in", rows.schema, 10_000)
    capture.run_available(working.new_turns(stream).select("session_id", "turn", "role", F.md5(F.col("content").cast("binary")).alias("digest")), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


STREAM_TURNS = "SELECT DISTINCT ON (conv_id, turn, role) conv_id AS session_id, turn, role, md5(text) AS digest FROM conversations"


def stream_expirations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as memories that their events touch: those whose last event is two days or more before the newest one."""
    at = shared_folder(spark, "working")
    rows = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    rows.coalesce(1).write.parquet(f"{at}/in")
    working.run_expirations(capture.stream_parquet(spark, f"{at}/in", rows.schema), f"{at}/out", f"{at}/state", hours=47)
    return spark.read.parquet(f"{at}/out").select("id", F.col("touched").cast("timestamp_ntz").alias("touched"), "touches")


STREAM_EXPIRATIONS = """WITH u AS (SELECT CAST(user_id AS VARCHAR) AS id, max(ts) AS touched, count(*) AS touches FROM events GROUP BY 1), m AS (SELECT max(touched) AS now FROM u)
SELECT id, touched, touches FROM u, m WHERE epoch_ms(touched) + 47 * 3600000 <= epoch_ms(now) - 3600000"""


NAMES = "consolidate_sources coverage_checks consolidated_veracity degrade_tiers operation_log stream_capture stream_access_counts session_spans change_feed stream_changes stream_audit stream_consolidation kept_turns identity_turns json_faults evidence_sections migrated_store plugin_summaries sync_push stream_sync stream_ledger ledger_outcomes stream_turns stream_expirations".split()
