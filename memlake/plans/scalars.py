"""Queries of the scalar expressions, each with its SQL twin; the SQL states the values, not the JSON they are read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import scalars as S
from memlake.functions import text as T
from memlake.sources.tables import events, table, texts, turns

START, NOW = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def norm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns led by labels in brackets, without them; an open bracket stays."""
    lead = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("[a b] ("), "role", F.lit(")  "))).when(F.col("turn") % 3 == 1, F.lit("[open ")).otherwise(F.lit(" (x)[y]"))
    rows = turns(spark, sf_dir).withColumn("line", F.concat(lead, "content"))
    return rows.select("session_id", "turn", "role", F.md5(S.norm_line("line").cast("binary")).alias("digest"))


NORM_LINES = """SELECT conv_id AS session_id, turn, role, md5(lower(trim(regexp_replace(CASE WHEN turn % 3 = 1 THEN '[open ' ELSE '' END || text, '\\s+', ' ', 'g')))) AS digest FROM conversations"""


def word_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at words, their length in tokens, and how often a word occurs."""
    short = S.word_truncate("content", 120)
    return texts(spark, sf_dir).select("id", F.md5(short.cast("binary")).alias("digest"), F.length(short).cast("long").alias("size"), S.token_estimate("content").alias("tokens"), S.occurrences("content", "the ").alias("times"))


WORD_CUTS = """WITH a AS (SELECT doc_id AS id, text, rtrim(substr(text, 1, 120), ' ') AS c FROM documents), b AS (SELECT *, length(c) - strpos(reverse(c), ' ') AS last, strpos(reverse(c), ' ') > 0 AS spaced FROM a),
d AS (SELECT *, CASE WHEN length(text) <= 120 THEN text WHEN spaced AND last >= 60 THEN rtrim(substr(c, 1, last), ' ') || '...' ELSE c || '...' END AS s FROM b)
SELECT id, md5(s) AS digest, length(s) AS size, (length(text) + 3) // 4 AS tokens, (length(text) - length(replace(text, 'the ', ''))) // 4 AS times FROM d"""


def bonuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonuses of turns that say they correct, and of those that answer what is current."""
    lead = F.element_at(F.array(*[F.lit(x) for x in ("[USER] Correction: ", "user: actually, ", "To correct, ", "Updated ", "update ", "The actually ", "currently ")]), (F.col("turn") % 7 + 1).cast("int"))
    rows = turns(spark, sf_dir).withColumn("line", F.concat(lead, "content"))
    asked = F.array(F.lit("what"), F.when(F.col("session_id") % 2 == 0, "now").otherwise("then"))
    return rows.select("session_id", "turn", "role", S.correction_bonus("line").alias("correction"), S.recency_bonus(asked, T.tokens("line")).alias("recency"))


BONUSES = """SELECT conv_id AS session_id, turn, role, CASE WHEN turn % 7 IN (0, 1, 2, 4) THEN 0.05 ELSE 0.0 END AS correction,
CASE WHEN conv_id % 2 = 0 AND (turn % 7 IN (3, 6) OR regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])(current|currently|latest|newer|updated)($|[^\\p{L}\\p{N}])')) THEN 0.05 ELSE 0.0 END AS recency FROM conversations"""


def event_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and seconds of events read back from ISO text, and a day from a Unix time; what can't be read is null."""
    e = events(spark, sf_dir).withColumn("iso", F.when(F.col("event_id") % 10 == 9, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    seconds = F.when(F.col("event_id") % 7 == 6, F.lit(float("nan"))).when(F.col("event_id") % 7 == 5, F.lit(1e18)).otherwise(F.unix_timestamp("ts").cast("double"))
    return e.select("event_id", S.days_since("iso", START).alias("days"), F.round(S.age_hours("iso", NOW) * 3600).cast("long").alias("seconds"), S.minute_stamp("iso").alias("minute"), S.utc_date(seconds).cast("string").alias("day"))


EVENT_AGES = f"""WITH e AS (SELECT event_id, date_trunc('second', ts) AS t, event_id % 10 = 9 AS bad FROM events)
SELECT event_id, CASE WHEN NOT bad THEN CAST(floor(epoch(t - TIMESTAMP '{START}') / 86400) AS BIGINT) END AS days, CASE WHEN NOT bad THEN CAST(epoch(TIMESTAMP '{NOW}' - t) AS BIGINT) END AS seconds,
CASE WHEN bad THEN 'no time' ELSE strftime(t, '%Y-%m-%dT%H:%M') END AS minute, CASE WHEN event_id % 7 < 5 THEN CAST(CAST(t AS DATE) AS VARCHAR) END AS day FROM e"""


def split_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", S.hash_split("id").alias("split"))


SPLIT_HALVES = "SELECT doc_id AS id, CASE WHEN substr(sha256(CAST(doc_id AS VARCHAR)), 64, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'fit' ELSE 'held' END AS split FROM documents"


def metadata_of(id_col: Column, name: Column, alias: Column) -> Column:
    """Metadata as a writer leaves it: mostly objects, some broken, some lists, some without anything."""
    control = F.when(id_col % 17 == 3, F.concat(F.lit("m"), F.lit("\u0001"))).otherwise(F.concat(F.lit("m"), id_col.cast("string")))
    reference = F.struct(F.concat(F.lit("s"), (id_col % 10).cast("string")).alias("session_id"), control.alias("message_id"), F.when(id_col % 2 == 0, "host").alias("origin"), F.when(id_col % 3 == 0, "platform").when(id_col % 3 == 1, "other").alias("message_id_namespace"))
    provenance = F.struct(F.when(id_col % 4 > 0, F.concat(F.lit("model-"), (id_col % 4).cast("string"))).alias("model"), F.when(id_col % 3 == 0, "unknown").otherwise("1.2").alias("engine_version"), F.when(id_col % 5 == 0, " 9.1 ").alias("agent_version"), F.when(id_col % 2 == 0, "2024-05-06T07:08:09").alias("recorded_at"))
    full = F.to_json(F.struct(name.alias("canonical_name"), F.array(alias, F.lit("***"), F.lit("")).alias("aliases"), reference.alias("source_ref"), provenance.alias("provenance")))
    return F.when(id_col % 11 == 7, F.lit("{broken")).when(id_col % 11 == 8, F.lit("[1, 2]")).when(id_col % 11 == 9, F.lit("{}")).when(id_col % 11 != 10, full)


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return docs.withColumn("metadata", metadata_of(F.col("id"), F.col("source"), F.col("lang")))


def metadata_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metadata(spark, sf_dir).select("id", F.array_join(S.labels("metadata"), "|").alias("labels"), S.json_object("metadata").isNotNull().alias("readable"))


METADATA_LABELS = "SELECT doc_id AS id, CASE WHEN doc_id % 11 < 7 THEN concat_ws('|', source, lang) ELSE '' END AS labels, doc_id % 11 < 7 OR doc_id % 11 = 9 AS readable FROM documents"


def metadata_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metadata(spark, sf_dir).select("id", S.source_reference("metadata").alias("r"), S.provenance_line("metadata").alias("line")).select("id", "r.session_id", "r.message_id", "r.origin", "r.namespace", "line")


METADATA_SOURCES = """WITH d AS (SELECT doc_id AS id, doc_id % 11 < 7 AND doc_id % 17 <> 3 AS ok, doc_id % 11 < 7 AS whole FROM documents)
SELECT id, CASE WHEN ok THEN 's' || id % 10 END AS session_id, CASE WHEN ok THEN 'm' || id END AS message_id, CASE WHEN ok THEN CASE WHEN id % 2 = 0 THEN 'host' ELSE 'caller' END END AS origin, CASE WHEN ok AND id % 3 = 0 THEN 'platform' END AS namespace,
CASE WHEN whole AND NOT (id % 4 = 0 AND id % 3 = 0 AND id % 5 > 0 AND id % 2 = 1) THEN 'learned under ' || concat_ws(', ', CASE WHEN id % 4 > 0 THEN 'model model-' || id % 4 END, CASE WHEN id % 3 > 0 THEN 'engine 1.2' END, CASE WHEN id % 5 = 0 THEN 'agent 9.1' END, CASE WHEN id % 2 = 0 THEN '2024-05-06' END) END AS line FROM d"""


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch laid over metadata: its members win, the others stay, what is no object stays untouched."""
    patch = F.to_json(F.struct(F.lit("kept").alias("canonical_name"), F.col("id").alias("patched")))
    merged = _metadata(spark, sf_dir).select("id", S.json_merge("metadata", patch).alias("m"))
    return merged.select("id", F.get_json_object("m", "$.canonical_name").alias("name"), F.get_json_object("m", "$.patched").cast("long").alias("patched"), F.get_json_object("m", "$.source_ref.session_id").alias("session"), F.when(F.col("id") % 11 == 7, F.col("m")).alias("left_alone"))


METADATA_MERGE = """SELECT doc_id AS id, CASE WHEN doc_id % 11 NOT IN (7, 8) THEN 'kept' END AS name, CASE WHEN doc_id % 11 NOT IN (7, 8) THEN doc_id END AS patched, CASE WHEN doc_id % 11 < 7 THEN 's' || doc_id % 10 END AS session,
CASE WHEN doc_id % 11 = 7 THEN '{broken' END AS left_alone FROM documents"""


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the events' properties: valid or not, the value, its type."""
    broken = F.when(F.col("event_id") % 13 == 5, F.lit("{no")).otherwise(F.col("props"))
    e = events(spark, sf_dir).withColumn("j", F.try_parse_json(broken))
    return e.select("event_id", F.col("j").isNotNull().alias("valid"), F.try_variant_get("j", "$.k", "long").alias("k"), F.schema_of_variant("j").startswith("OBJECT").alias("object"))


JSON_FIELDS = """WITH e AS (SELECT event_id, CASE WHEN event_id % 13 = 5 THEN '{no' ELSE props END AS p FROM events)
SELECT event_id, json_valid(p) AS valid, CASE WHEN json_valid(p) THEN CAST(json_extract(p, '$.k') AS BIGINT) END AS k, CASE WHEN json_valid(p) THEN json_type(p) = 'OBJECT' END AS object FROM e"""

NAMES = "norm_lines word_cuts bonuses event_ages split_halves metadata_labels metadata_sources metadata_merge json_fields".split()
