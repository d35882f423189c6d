"""Queries of automatic recall and of labels, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import scalars as S
from memlake.functions import text as T
from memlake.operators import labels as L
from memlake.operators import prefetch as P
from memlake.operators import search
from memlake.plans.evaluation import COLLAPSE_SQL
from memlake.plans.retrieval import _BATCH, _FOLD, _IMPORTANCE, _TOKENS, _WEIGHT, _probes, index
from memlake.sources.tables import importance, shared_folder, table, texts, turns, with_importance

K = P.profile().overfetch
SOURCES = ("fact", "conversation", "conversation_tool", "preference", "memoria_source_1", "note")
HEADS = ("[USER] ", "[ASSISTANT] ", "", "", "[IDENTITY] ")
_HITS = _BATCH.replace("rank <= 5", f"rank <= {K}")


def _pick(values: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each probe's recalled texts with the signals that a hybrid recall gives."""
    hits = search.recall_batch(index(spark, sf_dir), _probes(spark, sf_dir), K)
    best = F.max("score").over(Window.partitionBy("query_id"))
    hits = search.with_texts(hits.withColumn("score", F.round(F.col("score") / best, 6)), _probes(spark, sf_dir), texts(spark, sf_dir))
    # A few texts are single words, as fragments of a captured turn are.
    own = F.when(F.col("id") % 23 == 5, F.lit("almost")).when(F.col("id") % 23 == 6, F.lit("configuration")).otherwise(F.col("content"))
    return hits.select(
        "query_id",
        "id",
        F.concat(_pick(HEADS, F.col("id")), own).alias("content"),
        _pick(SOURCES, F.col("id")).alias("source"),
        (F.col("id") % 10 / 10).alias("importance"),
        "score",
        F.round(F.col("score") * 0.3, 6).alias("keyword_score"),
        F.round(F.col("score") * F.col("score") * 0.5, 6).alias("fts_score"),
        F.lit(None).cast("double").alias("dense_score"),
        (F.col("id") % 9 == 0).alias("matched"),
        F.concat(F.lit("2024-01-0"), (F.col("id") % 9 + 1).cast("string"), F.lit("T08:15:30")).alias("timestamp"),
        "rank",
    )


_CANDIDATES = (
    _HITS
    + f""", c AS (SELECT query_id, r.id, {_sql_list(HEADS)}[r.id % 5 + 1] || CASE WHEN r.id % 23 = 5 THEN 'almost' WHEN r.id % 23 = 6 THEN 'configuration' ELSE d.text END AS content, {_sql_list(SOURCES)}[r.id % 6 + 1] AS source, r.id % 10 / 10 AS importance, rank,
round(score / max(score) OVER (PARTITION BY query_id), 6) AS score, r.id % 9 = 0 AS matched FROM r JOIN documents d ON d.doc_id = r.id),
sg AS (SELECT *, CASE WHEN matched THEN greatest(round(score * 0.3, 6), round(score * score * 0.5, 6), 0.2) ELSE greatest(round(score * 0.3, 6), round(score * score * 0.5, 6)) END AS signal FROM c),
q1 AS (SELECT *, CASE WHEN id % 5 = 1 OR source = 'conversation_tool' THEN 0.0 ELSE CASE WHEN source IN ('fact', 'preference') THEN 1.12 ELSE 1.0 END * CASE WHEN source = 'conversation' THEN 0.72 ELSE 1.0 END
  * CASE WHEN id % 5 = 0 THEN 0.68 WHEN id % 5 = 4 THEN 0.80 WHEN source = 'memoria_source_1' THEN 0.90 ELSE 1.0 END END AS quality,
  CASE WHEN source IN ('conversation', 'conversation_tool') OR id % 5 IN (0, 4) THEN 0.18 ELSE 0.08 END AS needed FROM sg),
g AS (SELECT *, CASE WHEN id % 5 IN (2, 3) AND id % 23 = 5 THEN 'low_quality' WHEN quality <= 0 THEN 'source' WHEN signal < needed OR (score < 0.2 AND importance < 0.65) THEN 'relevance' END AS skipped,
  (0.65 * score + 0.35 * signal + 0.05 * importance) * quality AS adjusted FROM q1)
"""
)


def prefetch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gate(_hits(spark, sf_dir), P.profile()).select("query_id", "id", "skipped", F.round("adjusted", 5).alias("adjusted"))


PREFETCH_GATE = _CANDIDATES + "SELECT query_id, id, skipped, round(adjusted, 5) AS adjusted FROM g"


def prefetch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gate_counts(P.gate(_hits(spark, sf_dir), P.profile()))


PREFETCH_COUNTS = _CANDIDATES + "SELECT query_id, count(*) AS rows_seen, " + ", ".join(f"count(*) FILTER (skipped = '{k}') AS skipped_{k}" for k in ("low_quality", "source", "relevance")) + " FROM g GROUP BY query_id"


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "id", P.admitted("keyword_score").alias("admitted"))


ADMISSION = _CANDIDATES + "SELECT query_id, id, round(score * 0.3, 6) >= 0.15 AS admitted FROM c"


def prefetch_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = P.tokens("content")
    return texts(spark, sf_dir).select("id", F.size(own).cast("long").alias("n"), F.md5(F.array_join(own, " ").cast("binary")).alias("digest"))


PREFETCH_TOKENS = f"""WITH t AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_./:-]*'), lambda t: length(t) > 2 AND NOT list_contains({_sql_list(P.COMMON_WORDS)}, t)) AS x FROM documents),
u AS (SELECT id, list_transform(list_sort(list_transform(list_distinct(x), lambda v: struct_pack(p := list_position(x, v), v := v))), lambda s: s.v) AS y FROM t) SELECT id, len(y) AS n, md5(array_to_string(y, ' ')) AS digest FROM u"""


def _slots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as slots of a model, nations as queries about them."""
    parts = table(spark, sf_dir, "part")
    live = parts.select(F.concat(F.lit("model:"), F.lower("p_type")).alias("category"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), F.col("p_partkey").cast("string")).alias("name"), F.concat("p_type", F.lit(" for the "), "p_brand").alias("body"), (F.col("p_size") / 50).alias("confidence"))
    words = ("how should economy ring be", "What about Small/bolt", "standard_gear", "the hot widget")
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(_pick(words, F.col("n_nationkey")), F.lit(" "), F.lower("n_name")).alias("query"))
    return asked, live


def model_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, live = _slots(spark, sf_dir)
    return P.slots(asked, live).select("query_id", "position", "name", "overlap")


def _slot_sql(text: str) -> str:
    own = f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9_./:-]*'), lambda t: length(t) > 2 AND NOT list_contains({_sql_list(P.SLOT_WORDS)}, t))"
    parts = f"list_filter(flatten(list_transform({own}, lambda t: string_split_regex(t, '[_:/.-]+'))), lambda t: length(t) > 2 AND NOT list_contains({_sql_list(P.SLOT_WORDS)}, t))"
    return f"list_distinct(list_concat({own}, {parts}))"


_SLOT_QUERIES = "['how should economy ring be', 'What about Small/bolt', 'standard_gear', 'the hot widget']"
MODEL_SLOTS = f"""WITH a AS (SELECT n_nationkey AS query_id, unnest({_slot_sql(f"{_SLOT_QUERIES}[n_nationkey % 4 + 1] || ' ' || lower(n_name)")}) AS token FROM nation),
h AS (SELECT 'model:' || lower(p_type) AS category, replace(p_name, ' ', '_') || '-' || p_partkey AS name, p_type || ' for the ' || p_brand AS body, p_size / 50 AS confidence FROM part),
t AS (SELECT *, unnest({_slot_sql("category || ' ' || name || ' ' || body")}) AS token FROM h), m AS (SELECT query_id, category, name, confidence, count(*) AS overlap FROM a JOIN t USING (token) GROUP BY ALL)
SELECT CAST(query_id AS BIGINT) AS query_id, position, name, overlap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, confidence DESC, category, name) AS position FROM m) WHERE position <= 3"""


def _identities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A conversation's user turns as its identity rows; what its assistant said first is shown already."""
    rows = turns(spark, sf_dir)
    asked = rows.select(F.col("session_id").alias("query_id"), "session_id").distinct()
    own = rows.where("role = 'user'").select("session_id", F.col("turn").alias("id"), "content", (F.col("turn") % 3 / 4).alias("importance"), F.concat(F.lit("2024-01-0"), (F.col("turn") + 1).cast("string"), F.lit("T08:15:30")).alias("timestamp"))
    shown = rows.where("role = 'user' and turn = 2").select(F.col("session_id").alias("query_id"), F.concat(F.lit("  "), "content").alias("line"))
    return asked, own, shown


def identity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.identity_lines(*_identities(spark, sf_dir))
    return found.select("query_id", "position", F.md5(F.col("line").cast("binary")).alias("digest"))


IDENTITY_ROWS = """WITH i AS (SELECT conv_id, turn, text, turn % 3 / 4 AS importance, '2024-01-0' || (turn + 1) || 'T08:15' AS moment FROM conversations WHERE role = 'user' AND text <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY importance DESC, moment DESC, turn) AS n FROM i WHERE NOT EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = i.conv_id AND s.role = 'user' AND s.turn = 2 AND contains(s.text, i.text)))
SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY importance DESC, moment DESC, turn) AS position, md5('  [' || moment || '] (importance ' || CASE turn % 3 WHEN 0 THEN '0.00' WHEN 1 THEN '0.25' ELSE '0.50' END || ') [IDENTITY] ' || text) AS digest FROM f WHERE n = 1"""


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's words as lines of two blocks: what was said before goes, headers stay."""
    rows = turns(spark, sf_dir).select(F.col("session_id").alias("query_id"), (F.col("turn") % 2).cast("int").alias("block"), "turn", "role", F.posexplode(F.split("content", "[ \n]+")).alias("at", "word"))
    lines = rows.select("query_id", "block", F.struct("turn", "role", "at").alias("position"), F.when(F.col("at") % 10 == 9, F.concat(F.lit("# "), "word")).otherwise(F.concat(F.lit("[x] "), "word")).alias("line"))
    return P.first_lines(lines).groupBy("query_id", "block").agg(F.count("*").alias("lines"))


LINE_DEDUP = """WITH w AS (SELECT conv_id, turn, role, string_split_regex(text, '[ \n]+') AS ws FROM conversations), l AS (SELECT conv_id, turn % 2 AS block, turn, role, unnest(range(0, len(ws))) AS k0, unnest(ws) AS word FROM w),
n AS (SELECT *, lower(trim(regexp_replace(word, '\\s+', ' ', 'g'))) AS norm, k0 % 10 = 9 AS head FROM l), d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, norm, head OR norm = '' ORDER BY block, turn, role, k0) AS k FROM n)
SELECT conv_id AS query_id, CAST(block AS INT) AS block, count(*) AS lines FROM d WHERE head OR norm = '' OR k = 1 GROUP BY ALL"""


def ignored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by whether a pattern ignores them; one of the patterns is none and is skipped."""
    return turns(spark, sf_dir).select("session_id", "turn", "role", P.ignored("content", ["DIE ", "[broken", r"\bthe\b", "ón$"]).alias("ignored"))


IGNORED_TURNS = "SELECT conv_id AS session_id, turn, role, regexp_matches(text, '(?i)DIE ') OR regexp_matches(text, '(?i)\\bthe\\b') OR regexp_matches(text, '(?i)ón$') AS ignored FROM conversations"


def prefetch_lite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with every token of a probe; for a probe without any, those of its single terms, by importance and time."""
    items = table(spark, sf_dir, "benchmark")
    own = index(spark, sf_dir)
    every = items.select(F.col("item_id").alias("query_id"), F.concat(F.array_distinct(T.tokens("text")), F.when(F.col("item_id") % 3 == 0, F.array(F.lit("nowhere0"))).otherwise(F.array().cast("array<string>"))).alias("terms"))
    facts = with_importance(texts(spark, sf_dir).select("id", "created_at"), importance(spark, sf_dir))
    whole = search.recall_all(own, every, facts, 10)
    single = _probes(spark, sf_dir).select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    # Probes that share a term share its texts.
    each = single.select(F.col("term").alias("query_id"), F.array("term").alias("terms")).distinct()
    best = search.recall_all(own, each, facts, 10).select(F.col("query_id").alias("term"), "id", "importance", "created_at")
    by_term = single.join(best, "term").select("query_id", "id", "importance", "created_at")
    return P.fallback_merge(whole.select("query_id", "id", "importance", "created_at"), by_term, 10).select("query_id", "id", "place", "bounded")


_MEMORIES = f"mem AS (SELECT d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS created_at, {_IMPORTANCE} AS importance FROM documents d LEFT JOIN labels USING (doc_id))"
PREFETCH_LITE = (
    _BATCH.replace("t.ts FROM documents", "t.ts FROM documents")
    + f""", {_MEMORIES},
q3 AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all({_FOLD.format('text')}, '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark UNION SELECT item_id, 'nowhere0' FROM benchmark WHERE item_id % 3 = 0),
n3 AS (SELECT query_id, count(*) AS k FROM q3 GROUP BY 1), p3 AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM t) GROUP BY ALL), d3 AS (SELECT term, count(*) AS df FROM p3 GROUP BY 1),
a3 AS (SELECT query_id, id, round(sum({_WEIGHT.format(d='df', f='tf')}), 6) AS score, count(*) AS k FROM q3 JOIN p3 USING (term) JOIN d3 USING (term), s GROUP BY ALL),
w3 AS (SELECT query_id, id, importance, created_at, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, importance DESC, created_at DESC, id) AS n FROM a3 JOIN n3 USING (query_id, k) JOIN mem USING (id)),
b3 AS (SELECT query_id, id, importance, created_at, row_number() OVER (PARTITION BY query_id, term ORDER BY round({_WEIGHT.format(d='df', f='tf')}, 6) DESC, importance DESC, created_at DESC, id) AS n FROM q JOIN p3 USING (term) JOIN d3 USING (term) JOIN mem USING (id), s),
u3 AS (SELECT query_id, id, importance, created_at, false AS bounded FROM w3 WHERE n <= 10 UNION ALL SELECT DISTINCT query_id, id, importance, created_at, true FROM b3 WHERE n <= 10 AND query_id NOT IN (SELECT query_id FROM w3)),
z3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, created_at DESC, id) AS place FROM u3) SELECT query_id, id, place, bounded FROM z3 WHERE place <= 10"""
)


def shared_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.recall_batch(index(spark, sf_dir), _probes(spark, sf_dir), K).select("query_id", "id", "score")
    return P.shared_merge(hits.where("id % 2 = 0"), hits.where("id % 2 = 1"), 5).select("query_id", "id", "bank", "place")


SHARED_MERGE = _HITS + "SELECT query_id, id, bank, place FROM (SELECT query_id, id, CASE WHEN id % 2 = 0 THEN 'private' ELSE 'surface' END AS bank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id % 2, id) AS place FROM r) WHERE place <= 5"


def fact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalled texts and facts; every third text is a fact of a probe."""
    n = table(spark, sf_dir, "benchmark").select(F.max("item_id").alias("most"))
    own = texts(spark, sf_dir).select("id", "content")
    facts = own.where("id % 3 = 0").join(F.broadcast(n)).select((F.floor(F.col("id") / 3) % (F.col("most") + 1)).alias("query_id"), "id", "content", (F.col("id") % 100 / 10.0).alias("score"))
    hits = search.with_texts(search.recall_batch(index(spark, sf_dir), _probes(spark, sf_dir), 5), _probes(spark, sf_dir), own)
    return P.fact_merge(hits, facts, 8, ratio=0.3).select("query_id", "id", F.round("score", 6).alias("score"), "tier", "place")


FACT_MERGE = (
    _BATCH
    + """, n0 AS (SELECT max(item_id) + 1 AS n FROM benchmark), f0 AS (SELECT (doc_id // 3) % n0.n AS query_id, doc_id AS id, md5(text) AS digest, doc_id % 100 / 10.0 AS score FROM documents, n0 WHERE doc_id % 3 = 0),
f1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, digest ORDER BY score DESC, id) AS k FROM f0 WHERE NOT EXISTS (SELECT 1 FROM r JOIN documents d ON d.doc_id = r.id WHERE r.query_id = f0.query_id AND md5(d.text) = f0.digest)),
b0 AS (SELECT query_id, CAST(id AS VARCHAR) AS id, score, 'memory' AS tier FROM r UNION ALL SELECT query_id, 'cf_' || id, score * 0.9, 'fact' FROM f1 WHERE k = 1), k0 AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM b0),
p0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tier DESC, id) AS place FROM k0 WHERE best <= 0 OR score >= 0.3 * best) SELECT query_id, id, round(score, 6) AS score, tier, place FROM p0 WHERE place <= 8"""
)


def unknown_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes that also name an asset, an opaque name, or a plain unknown word."""
    extra = F.when(F.col("query_id") % 4 == 0, F.concat(F.lit("host-"), F.col("query_id").cast("string"))).when(F.col("query_id") % 4 == 1, "qwertyface").when(F.col("query_id") % 4 == 2, "plainword").otherwise("x1")
    asked = _probes(spark, sf_dir).withColumn("terms", F.concat("terms", F.array(extra)))
    hits = search.recall_batch(index(spark, sf_dir), _probes(spark, sf_dir), 5)
    hits = search.with_texts(hits, _probes(spark, sf_dir), texts(spark, sf_dir))
    return P.unknown_identifiers(asked, hits)


UNKNOWN_IDENTIFIERS = (
    _BATCH
    + """, q5 AS (SELECT * FROM q UNION SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'host-' || item_id WHEN 1 THEN 'qwertyface' WHEN 2 THEN 'plainword' ELSE 'x1' END FROM benchmark),
o5 AS (SELECT * FROM q5 WHERE length(term) >= 4 AND (regexp_full_match(term, '[a-z]{4,}[a-f]{4}') OR (regexp_matches(term, '[0-9]') AND regexp_full_match(term, '[a-z0-9][a-z0-9_-]*'))))
SELECT item_id AS query_id, EXISTS (SELECT 1 FROM o5 WHERE o5.query_id = item_id AND NOT EXISTS (SELECT 1 FROM r JOIN documents d ON d.doc_id = r.id WHERE r.query_id = item_id AND contains(lower(d.text), o5.term))) AS abstains FROM benchmark"""
)


def prefetch_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bank(_hits(spark, sf_dir), P.profile()).select("query_id", "position", "id", F.md5(F.col("line").cast("binary")).alias("digest"))


_BANK = (
    _CANDIDATES.replace("WITH t AS", "WITH RECURSIVE t AS", 1)
    + f""", gp AS (SELECT *, trim(CASE WHEN id % 5 IN (0, 1, 4) THEN substr(content, strpos(content, ']') + 1) ELSE content END) AS bare FROM g WHERE skipped IS NULL),
fx AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, id) AS pos, id, list_distinct(list_filter(regexp_extract_all(lower(bare), '[a-z0-9][a-z0-9_./:-]*'), lambda w: length(w) > 2 AND NOT list_contains({_sql_list(P.COMMON_WORDS)}, w))) AS tok,
  '  [2024-01-0' || (id % 9 + 1) || 'T08:15] (importance 0.' || (id % 10) || '0' || CASE WHEN source = 'conversation' THEN '' ELSE ', source ' || source END || ') ' || trim(regexp_replace(content, '\\s+', ' ', 'g')) AS line FROM gp),
{COLLAPSE_SQL}, bk AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS position, id, line FROM fk JOIN fx USING (query_id, pos) WHERE added QUALIFY position <= 5)
"""
)
PREFETCH_BANK = _BANK + "SELECT query_id, position, id, md5(line) AS digest FROM bk"


def prefetch_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that each probe gets: identity rows, model slots and memories, within the budget."""
    # The memories are a few rows of each probe and are read by two steps: written once, they are recalled once.
    folder = shared_folder(spark, "found")
    P.bank(_hits(spark, sf_dir), P.profile()).write.parquet(folder)
    found = spark.read.parquet(folder)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("session_id"), F.concat(F.lit("economy ring "), "text").alias("query"))
    _, live = _slots(spark, sf_dir)
    model = P.slots(asked, live)
    _, own, _ = _identities(spark, sf_dir)
    identity = P.identity_lines(asked, own, found)
    return P.render(P.first_lines(P.blocks(identity, model, found)), 4000)


_CUT_SQL = "CASE WHEN strpos({c}, ' ') > 0 AND length({c}) - strpos(reverse({c}), ' ') >= greatest(8, ({n}) // 2) THEN regexp_replace(substr({c}, 1, length({c}) - strpos(reverse({c}), ' ')), '\\s+$', '') ELSE {c} END"


def _cut_sql(line: str, room: str) -> str:
    return _CUT_SQL.format(c=f"regexp_replace(substr({line}, 1, CAST(greatest({room}, 0) AS BIGINT)), '\\s+$', '')", n=room)


PREFETCH_BLOCKS = (
    _BANK
    + f""", sa AS (SELECT item_id AS query_id, unnest({_slot_sql("'economy ring ' || text")}) AS token FROM benchmark),
sh AS (SELECT 'model:' || lower(p_type) AS category, replace(p_name, ' ', '_') || '-' || p_partkey AS name, p_type || ' for the ' || p_brand AS body, p_size / 50 AS confidence FROM part),
st AS (SELECT *, unnest({_slot_sql("category || ' ' || name || ' ' || body")}) AS token FROM sh), sm AS (SELECT query_id, category, name, body, confidence, count(*) AS overlap FROM sa JOIN st USING (token) GROUP BY ALL),
sl AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, confidence DESC, category, name) AS position, '  [' || category || '] ' || replace(name, '_', ' ') || ': ' || body AS line FROM sm QUALIFY position <= 3),
ii AS (SELECT conv_id, turn, text, turn % 3 / 4 AS importance, '2024-01-0' || (turn + 1) || 'T08:15' AS moment FROM conversations WHERE role = 'user' AND text <> '' AND conv_id IN (SELECT item_id FROM benchmark)),
im AS (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY importance DESC, moment DESC, turn) AS n FROM ii WHERE NOT EXISTS (SELECT 1 FROM bk WHERE bk.query_id = ii.conv_id AND contains(bk.line, ii.text))),
il AS (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY importance DESC, moment DESC, turn) AS position, '  [' || moment || '] (importance ' || CASE turn % 3 WHEN 0 THEN '0.00' WHEN 1 THEN '0.25' ELSE '0.50' END || ') [IDENTITY] ' || text AS line FROM im WHERE n = 1),
bl AS (SELECT query_id, 0 AS block, position, line FROM il UNION ALL SELECT DISTINCT query_id, 0, 0, '## Identity' FROM il UNION ALL SELECT query_id, 1, position, line FROM sl UNION ALL SELECT DISTINCT query_id, 1, 0, '## Model' FROM sl
  UNION ALL SELECT query_id, 2, position, line FROM bk UNION ALL SELECT DISTINCT query_id, 2, 0, '## Memories' FROM bk),
bn AS (SELECT *, lower(trim(regexp_replace(regexp_replace(trim(line), '^\\s*(?:(?:\\[[^\\]]*\\]|\\([^)]*\\))\\s*)+', ''), '\\s+', ' ', 'g'))) AS norm FROM bl),
bf AS (SELECT *, norm = '' OR regexp_matches(line, '^\\s*(?:#|$)') AS fixed FROM bn), bd AS (SELECT *, row_number() OVER (PARTITION BY query_id, norm, fixed ORDER BY block, position) AS n FROM bf),
ln AS (SELECT query_id, line, row_number() OVER (PARTITION BY query_id ORDER BY block, position) AS pos, row_number() OVER (PARTITION BY query_id, block ORDER BY position) AS k FROM bd WHERE fixed OR n = 1),
lg AS (SELECT query_id, line, pos, CASE WHEN pos = 1 THEN '' WHEN k = 1 THEN chr(10) || chr(10) ELSE chr(10) END AS gap, CASE WHEN length(line) > 1000 THEN {_cut_sql("line", str(1000 - len(P.CUT_MARK)))} || '{P.CUT_MARK}' END AS short FROM ln),
fw AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS pos, '' AS txt, true AS opn, false AS cut FROM lg UNION ALL
SELECT query_id, pos, CASE WHEN whole THEN txt || gap || line WHEN short IS NOT NULL AND room >= {1000 + len(P.CUT_MARK)} THEN txt || gap || short WHEN room - {len(P.CUT_MARK)} > 16 AND trim(line) <> '' THEN txt || gap || ({_cut_sql("line", f"room - {len(P.CUT_MARK)}")}) || '{P.CUT_MARK}' ELSE txt END,
  whole OR (short IS NOT NULL AND room >= {1000 + len(P.CUT_MARK)}), cut OR NOT whole FROM (
  SELECT *, length(line) <= room AS whole FROM (SELECT lg.query_id, lg.pos, txt, cut, gap, line, short, 4000 - length(txt) - length(gap) AS room FROM fw JOIN lg ON lg.query_id = fw.query_id AND lg.pos = fw.pos + 1 WHERE opn))),
fe AS (SELECT query_id, arg_max(txt, pos) AS txt, arg_max(opn, pos) AS opn, arg_max(cut, pos) AS cut FROM fw GROUP BY 1), ft AS (SELECT query_id, cut, CASE WHEN opn THEN txt ELSE ({_cut_sql("txt", str(4000 - len(P.LEFT_OUT_MARK)))}) || '{P.LEFT_OUT_MARK}' END AS txt FROM fe)
SELECT query_id, substr(txt, 1, 4000) AS context, cut OR length(txt) > 4000 AS truncated FROM ft"""
)


def _plain_tokens(text: str) -> Column:
    """Tokens in ASCII, as the SQL's edit distances count bytes."""
    return F.transform(T.tokens(text), lambda t: F.regexp_replace(t, r"[^\x00-\x7F]", "x"))


_PLAIN = "list_transform({}, lambda t: regexp_replace(t, '[^\\x00-\\x7F]', 'x', 'g'))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalled texts with labels: the first words of their text; every seventh query's texts lack some."""
    hits = search.recall_batch(index(spark, sf_dir), _probes(spark, sf_dir), K)
    hits = search.with_texts(hits, _probes(spark, sf_dir), texts(spark, sf_dir)).withColumn("t", _plain_tokens("content")).drop("content")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(_plain_tokens("text"), " ").alias("query"))
    name = F.array_join(F.slice("t", 1, F.when(F.col("id") % 2 == 0, 1).otherwise(2)), " ")
    bare = (F.col("query_id") % 7 == 0) & (F.col("id") % 3 == 0)
    metadata = F.when(~bare, F.to_json(F.struct(name.alias("canonical_name"), F.array(F.element_at("t", -1)).alias("aliases"))))
    return hits.join(asked, "query_id").select("query_id", "query", "id", "rank", S.labels(metadata).alias("labels"))


def label_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.label_evidence(_labelled(spark, sf_dir)).select("query_id", "id", F.size("labels").cast("long").alias("labels"), "kept")


_NEAR = "({a} = {b} OR (length({a}) >= 2 AND length({b}) >= 2 AND (substr({a}, 1, 2) = substr({b}, 1, 2) OR (length({a}) = length({b}) AND substr({a}, 1, 2) = reverse(substr({b}, 1, 2)))) AND damerau_levenshtein({a}, {b}) <= 1))"
_DIFFERS = "list_filter(range(1, len(l) + 1), lambda j: q[i + j - 1] <> l[j])"
_NAMES = f"(len(l) BETWEEN 1 AND 16 AND len(l) <= len(q) AND list_bool_or(list_transform(range(1, len(q) - len(l) + 2), lambda i: len({_DIFFERS}) = 0 OR (len({_DIFFERS}) = 1 AND {_NEAR.format(a=f'q[i + ({_DIFFERS})[1] - 1]', b=f'l[({_DIFFERS})[1]]')}))))"
_LABELS = (
    _HITS
    + f""", bt AS (SELECT item_id AS query_id, {_PLAIN.format(_TOKENS)} AS q FROM benchmark), tp AS (SELECT id, {_PLAIN.format('ts')} AS ts FROM t),
lb AS (SELECT r.query_id, r.id, rank, CASE WHEN r.query_id % 7 = 0 AND r.id % 3 = 0 THEN [] ELSE list_filter([array_to_string(ts[1:CASE WHEN r.id % 2 = 0 THEN 1 ELSE 2 END], ' '), ts[-1]], lambda x: x IS NOT NULL AND x <> '') END AS labels FROM r JOIN tp USING (id)),
lx AS (SELECT lb.query_id, lb.id, q, string_split(unnest(labels), ' ') AS l FROM lb JOIN bt USING (query_id)), ln AS (SELECT query_id, id, bool_or({_NAMES}) AS named FROM lx GROUP BY 1, 2)
"""
)
LABEL_EVIDENCE = _LABELS + "SELECT query_id, id, len(labels) AS labels, coalesce(named, false) OR NOT bool_and(len(labels) > 0) OVER (PARTITION BY query_id) AS kept FROM lb LEFT JOIN ln USING (query_id, id)"


def _index_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to spell by: each text's first token."""
    return texts(spark, sf_dir).select(F.col("id").alias("place"), F.element_at(_plain_tokens("content"), 1).alias("label")).where("label is not null")


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of misspelt labels: a letter of each is left out."""
    known = L.label_index(_index_labels(spark, sf_dir))
    asked = texts(spark, sf_dir).select(F.col("id").alias("query_id"), F.slice(_plain_tokens("content"), 1, 3).alias("t"))
    typed = F.transform("t", lambda w: F.concat(F.substring(w, 1, 3), F.substring(w, 5, 99)))
    return L.expand_queries(asked.select("query_id", F.array_join(typed, " ").alias("query")), known)


QUERY_EXPANSION = f"""WITH t AS (SELECT doc_id AS id, {_PLAIN.format(_TOKENS)} AS ts FROM documents),
x0 AS (SELECT ts[1] AS token, min(id) AS place FROM t WHERE length(ts[1]) >= 4 GROUP BY 1 ORDER BY place, token LIMIT 2048), w AS (SELECT id, unnest(range(1, least(len(ts), 3) + 1)) AS k0, unnest(list_transform(ts[1:3], lambda w: substr(w, 1, 3) || substr(w, 5, 99))) AS word FROM t),
k AS (SELECT DISTINCT word AS a FROM w WHERE word NOT IN (SELECT token FROM x0)), m AS (SELECT a, arg_min(token, struct_pack(p := place, t := token)) AS label FROM k, x0 WHERE abs(length(a) - length(token)) <= 1 AND {_NEAR.format(a='a', b='token')} GROUP BY a)
SELECT t.id AS query_id, coalesce(string_agg(coalesce(m.label, w.word), ' ' ORDER BY k0), '') AS expanded FROM t LEFT JOIN w USING (id) LEFT JOIN m ON m.a = w.word GROUP BY t.id"""


def label_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose first words, one of them misspelt, name a text's label of one or two words."""
    own = texts(spark, sf_dir).select("id", _plain_tokens("content").alias("t")).where("size(t) > 0")
    words = own.select(F.array_join(F.slice("t", 1, F.when(F.col("id") % 2 == 0, 1).otherwise(2)), " ").alias("label")).distinct()
    typed = F.transform(F.slice("t", 1, 3), lambda w, i: F.when(i == 1, F.concat(F.substring(w, 1, 3), F.substring(w, 5, 99))).otherwise(w))
    return L.collisions(own.select(F.col("id").alias("query_id"), F.concat(F.lit("a "), F.array_join(typed, " "), F.lit(" please")).alias("query")), words)


LABEL_COLLISIONS = f"""WITH t AS (SELECT doc_id AS id, {_PLAIN.format(_TOKENS)} AS ts FROM documents), lb AS (SELECT DISTINCT array_to_string(ts[1:CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END], ' ') AS label FROM t WHERE len(ts) > 0),
ll AS (SELECT label, string_split(label, ' ') AS l FROM lb), qs AS (SELECT id AS query_id, list_filter(list_concat(['a'], list_transform(ts[1:3], lambda w, i: CASE WHEN i = 2 THEN substr(w, 1, 3) || substr(w, 5, 99) ELSE w END), ['please']), lambda w: w <> '') AS q FROM t WHERE len(ts) > 0)
SELECT query_id, label FROM qs, ll WHERE {_NAMES}"""


def tool_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalled texts of each probe that its labels bear out, from both banks, best first, with a line on where they come from."""
    kept = L.label_evidence(_labelled(spark, sf_dir)).where("kept").withColumn("score", 1 / F.col("rank"))
    origin = F.to_json(F.struct(F.struct(F.concat(F.lit("model-"), (F.col("id") % 3).cast("string")).alias("model"), F.lit("unknown").alias("engine_version"), F.lit("2024-05-06T00:00").alias("recorded_at")).alias("provenance")))
    merged = P.shared_merge(kept.where("id % 2 = 0").select("query_id", "id", "score"), kept.where("id % 2 = 1").select("query_id", "id", "score"), 5)
    return merged.select("query_id", "id", "bank", "place", S.provenance_line(origin).alias("line"))


TOOL_RECALL = _LABELS + """, kp AS (SELECT query_id, id, rank, coalesce(named, false) OR NOT bool_and(len(labels) > 0) OVER (PARTITION BY query_id) AS kept FROM lb LEFT JOIN ln USING (query_id, id))
SELECT query_id, id, bank, place, 'learned under model model-' || id % 3 || ', 2024-05-06' AS line FROM (SELECT query_id, id, CASE WHEN id % 2 = 0 THEN 'private' ELSE 'surface' END AS bank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM kp WHERE kept) WHERE place <= 5"""

NAMES = (
    "prefetch_gate prefetch_counts admission prefetch_tokens model_slots identity_rows line_dedup ignored_turns prefetch_lite shared_merge fact_merge unknown_identifiers prefetch_bank prefetch_blocks "
    "label_evidence query_expansion label_collisions tool_recall"
).split()
