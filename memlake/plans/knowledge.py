"""Queries over text cards, vectors, facts and graphs, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import facts, graph, rerank
from memlake.sources.tables import importance, shared_folder, table, texts, turns, with_importance


def snippet_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", T.snippet("content", ["ing", "tion"], 80).alias("snippet"))


_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_CUT = "CASE WHEN length(f) <= 80 THEN f ELSE rtrim(substr(f, 1, 79)) || '…' END"
SNIPPET_CARDS = f"""
WITH a AS (SELECT doc_id AS id, {_FLAT} AS f FROM documents),
h AS (SELECT *, least(nullif(strpos(lower(f), 'ing'), 0), nullif(strpos(lower(f), 'tion'), 0)) AS hit, length(f) AS n FROM a),
b AS (SELECT *, greatest(0, least(hit - 1 - 26, greatest(0, n - 80))) AS s FROM h)
SELECT id, CASE WHEN hit IS NULL OR n <= 80 THEN {_CUT}
  ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || trim(substr(f, s + 1, 80)) || CASE WHEN s + 80 < n THEN '…' ELSE '' END END AS snippet FROM b
"""


def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = T.redact("content")
    return texts(spark, sf_dir).select("id", F.md5(clean.cast("binary")).alias("digest"), (clean != F.col("content")).alias("changed"))


_REDACT = "text"
for _p in T.SECRET_FORMATS:
    _REDACT = "regexp_replace({}, '{}', '[REDACTED]', 'g')".format(_REDACT, _p.replace("'", "''"))
_ENTROPY = "-list_sum(list_transform(list_distinct(string_split(t, '')), lambda c: (length(t) - length(replace(t, c, ''))) / length(t) * log2((length(t) - length(replace(t, c, ''))) / length(t))))"
REDACT_SECRETS = f"""WITH a AS (SELECT doc_id AS id, text, {_REDACT} AS c FROM documents), b AS (SELECT id, text, c, list_filter(list_distinct(regexp_extract_all(c, '{T.LONG_TOKEN}')), lambda t: {_ENTROPY} >= 4.0) AS r FROM a),
d AS (SELECT id, text, list_reduce(list_prepend(c, list_reverse_sort(list_transform(r, lambda t: lpad(CAST(length(t) AS VARCHAR), 9, '0') || t))), lambda s, t: replace(s, substr(t, 10), '[REDACTED]')) AS c FROM b)
SELECT id, md5(c) AS digest, c <> text AS changed FROM d"""


def entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long tokens with their entropy in bits a character; those of 4 or more look like secrets."""
    found = texts(spark, sf_dir).select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9_+/=-]{32,}"), F.lit(0)))).alias("token"))
    chars = found.select("id", "token", F.explode(F.split("token", "")).alias("c")).where("c <> ''")
    counts = chars.groupBy("id", "token", "c").agg(F.count("*").alias("n"))
    share = F.col("n") / F.length("token")
    scored = counts.groupBy("id", "token").agg(F.round(-F.sum(share * F.log2(share)), 6).alias("entropy"))
    return scored.withColumn("high", F.col("entropy") >= 4.0)


ENTROPY_TOKENS = """
WITH t AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_+/=-]{32,}'))) AS token FROM documents),
c AS (SELECT id, token, unnest(string_split(token, '')) AS c FROM t),
n AS (SELECT id, token, c, count(*) AS n FROM c GROUP BY ALL),
e AS (SELECT id, token, round(-sum(n / length(token) * log2(n / length(token))), 6) AS entropy FROM n GROUP BY ALL)
SELECT *, entropy >= 4.0 AS high FROM e
"""


def key_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", F.array_join(T.key_tokens("content"), " ").alias("keys"))


KEY_TOKENS = f"""
WITH k AS (SELECT doc_id AS id, list_filter(regexp_extract_all(text, '{T.KEY_TOKEN}'), lambda t: regexp_matches(t, '[0-9A-Z]')) AS x FROM documents)
SELECT id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ' ') AS keys FROM k
"""


def end_date_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end date that an order's note gives, back from text."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    named = F.concat(F.lit("no later than "), F.date_format("o_orderdate", "MMMM d"), F.lit(", "), F.date_format("o_orderdate", "yyyy"))
    form = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("open until "), day))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("EXPIRES ON "), F.translate(day, "-", "/")))
        .when(F.col("o_orderkey") % 5 == 2, named)
        .when(F.col("o_orderkey") % 5 == 3, F.lit("through 2024-02-31"))
        .otherwise(F.concat(F.lit("made "), day))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", T.end_date(form).cast("string").alias("valid_until"))


END_DATE_EXTRACT = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <= 2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS valid_until FROM orders"


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.where("vec_id = 0").select(F.col("embedding").alias("query"))
    # The query is one vector.
    scored = vectors.join(F.broadcast(query)).withColumn("score", F.round(rerank.cosine(F.col("embedding"), F.col("query")), 5))
    return scored.orderBy(F.desc_nulls_last("score"), F.asc("vec_id")).limit(10).select("vec_id", "score", "label")


VECTOR_TOPK = """
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 5) AS score, label FROM embeddings, q ORDER BY score DESC NULLS LAST, vec_id LIMIT 10
"""


def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every twentieth vector, itself among them."""
    vectors = table(spark, sf_dir, "embeddings")
    return rerank.vector_topk_batch(vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


VECTOR_NEIGHBOURS = """
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score IS NOT NULL AND NOT isnan(score) QUALIFY rank <= 10
"""


def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector, keyword, importance and recency signals of the texts that have a vector."""
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.where("vec_id = 1").select(F.col("embedding").alias("query"))
    vec = vectors.join(F.broadcast(query)).select(F.col("vec_id").alias("id"), rerank.cosine(F.col("embedding"), F.col("query")).alias("vec"))
    words = texts(spark, sf_dir).select("id", "created_at", (F.size(F.filter(T.tokens("content"), lambda t: t == "the")) / F.greatest(F.lit(1), F.size(T.tokens("content")))).alias("fts"))
    rows = with_importance(words.join(vec, "id"), importance(spark, sf_dir))
    score = rerank.hybrid(F.col("vec"), F.col("fts"), F.col("importance") / 10, rerank.decay(F.col("created_at") / 100, 24.0))
    return rows.select("id", F.round(score, 5).alias("score"))


_TOKENS = f"regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')"
HYBRID_SCORE = f"""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 1),
v AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS vec FROM embeddings, q),
t AS (SELECT doc_id AS id, n_chars, {_TOKENS} AS ts FROM documents)
SELECT t.id, round((0.5 * coalesce(vec, 0) + 0.3 * len(list_filter(ts, lambda x: x = 'the')) / greatest(1, len(ts)) + 0.2 * (CASE WHEN quality = 1 THEN 8 WHEN quality IS NULL THEN 5 ELSE 2 END) / 10.0)
  * (0.7 + 0.3 * exp(-ln(2) * (n_chars / 100.0) / 24)), 5) AS score
FROM t JOIN v USING (id) LEFT JOIN labels l ON l.doc_id = t.id
"""


def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("role") == "user", "[USER] ").when(F.col("role") == "assistant", "[ASSISTANT] ").otherwise("")
    source = F.when(F.col("turn") % 3 == 0, "fact").when(F.col("turn") % 3 == 1, "conversation").otherwise("memoria_source_x")
    rows = turns(spark, sf_dir).withColumn("quality", rerank.source_quality(F.concat(label, "content"), source))
    signal = F.least(F.lit(1.0), F.length("content") / 1000)
    return rows.select("session_id", "turn", "role", F.round("quality", 6).alias("quality"), F.round(rerank.adjusted(signal, signal, F.lit(0.5), F.col("quality")), 6).alias("adjusted"))


SOURCE_QUALITY = """
WITH r AS (SELECT conv_id AS session_id, turn, role, least(1.0, length(text) / 1000) AS s,
  CASE WHEN role = 'assistant' THEN 0.0 ELSE CASE turn % 3 WHEN 0 THEN 1.12 WHEN 1 THEN 0.72 ELSE 1.0 END * CASE WHEN role = 'user' THEN 0.68 WHEN turn % 3 = 2 THEN 0.9 ELSE 1.0 END END AS q FROM conversations)
SELECT session_id, turn, role, round(CAST(q AS DOUBLE), 6) AS quality, round((0.65 * s + 0.35 * s + 0.05 * 0.5) * CAST(q AS DOUBLE), 6) AS adjusted FROM r
"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slot"), F.col("o_orderkey").alias("fact_id"), F.col("o_orderdate").alias("valid_from"), F.col("o_orderstatus").alias("value"))
    return rows


def version_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.version_intervals(_versions(spark, sf_dir), ["slot"])


_VERSIONS = "v AS (SELECT o_custkey AS slot, o_orderkey AS fact_id, o_orderdate AS valid_from, o_orderstatus AS value, lead(o_orderdate) OVER w AS valid_to, row_number() OVER w AS version FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
VERSION_INTERVALS = f"WITH {_VERSIONS} SELECT * FROM v"


def asof_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order status that held for each customer on a fixed day."""
    probes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slot"), F.lit("1996-07-01").cast("timestamp_ntz").alias("as_of"))
    rows = _versions(spark, sf_dir)
    probes = probes.withColumn("as_of", F.col("as_of").cast(rows.schema["valid_from"].dataType))
    return facts.as_of(probes, rows, ["slot"]).select("slot", "as_of", "fact_id", "value")


ASOF_VALUE = f"""
WITH {_VERSIONS} SELECT c_custkey AS slot, TIMESTAMP '1996-07-01' AS as_of, fact_id, value FROM customer
LEFT JOIN (SELECT * FROM v WHERE valid_from <= TIMESTAMP '1996-07-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-07-01')) f ON f.slot = c_custkey
"""


def current_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.version_intervals(_versions(spark, sf_dir), ["slot"])
    closed = rows.withColumn("valid_until", F.col("valid_to")).withColumn("superseded_by", F.when(F.col("value") == "F", F.col("fact_id")))
    now = F.lit("1997-01-01").cast(rows.schema["valid_from"].dataType)
    return closed.where(facts.is_current(now)).select("slot", "fact_id", "value", "version")


CURRENT_FACTS = f"WITH {_VERSIONS} SELECT slot, fact_id, value, version FROM v WHERE (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01') AND value <> 'F'"


def triple_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.version_intervals(_versions(spark, sf_dir), ["slot"])
    triples = rows.select(F.concat(F.lit("customer:"), "slot").alias("subject"), F.lit("order_status").alias("predicate"), F.col("value").alias("object"), "valid_from", "valid_to")
    moment = F.lit("1996-01-01").cast(rows.schema["valid_from"].dataType)
    return facts.match_triples(triples, predicate="order_status", object_="O", moment=moment).select("subject", "object", "valid_from")


TRIPLE_QUERY = f"WITH {_VERSIONS} SELECT 'customer:' || slot AS subject, value AS object, valid_from FROM v WHERE value = 'O' AND valid_from <= TIMESTAMP '1996-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-01-01')"


def canonical_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots by nation and segment: how many versions each has had, and the live one."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = _versions(spark, sf_dir).join(customers, F.col("slot") == F.col("c_custkey"))
    return rows.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("versions"), F.max_by("fact_id", F.struct("valid_from", "fact_id")).alias("live"), F.max("valid_from").alias("since"))


CANONICAL_HISTORY = """SELECT c_nationkey, c_mktsegment, count(*) AS versions, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS live, max(o_orderdate) AS since
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers to the parts that they sell, both ways; the weight is the share of returns below one."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    there = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    back = there.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return there.unionByName(back).withColumn("weight", F.lit(1.0))


def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("s1",)], "node string")
    return graph.reach(_edges(spark, sf_dir), seeds, 2, 0.5).select("node", F.col("hops").cast("long").alias("hops"))


GRAPH_BFS = """
WITH RECURSIVE l AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p FROM lineitem), e AS (SELECT s AS a, p AS b FROM l UNION SELECT p, s FROM l),
r(node, hops) AS (SELECT 's1', CAST(0 AS BIGINT) UNION SELECT e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node WHERE r.hops < 2)
SELECT node, min(hops) AS hops FROM r GROUP BY node
"""


def _typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to their nations and nations to regions and suppliers, both ways, by type, with weights."""
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("b"), (F.col("c_custkey") % 10 / 10).alias("weight"), F.lit("lives").alias("edge_type"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), (F.col("s_suppkey") % 5 / 5), F.lit("sells"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.lit(1.0), F.lit("part"))
    rows = customers.union(suppliers).union(nations)
    return rows.select(F.col("a").alias("source"), F.col("b").alias("target"), "weight", "edge_type").union(rows.select("b", "a", "weight", "edge_type"))


def graph_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom a customer reaches in four hops over two types of edges, those of others and weak ones aside."""
    seeds = spark.createDataFrame([("c7",), ("c8",), (None,)], "node string")
    return graph.reach(_typed_edges(spark, sf_dir), seeds, 4, 0.3, ("lives", "part")).select("node", F.col("hops").cast("long").alias("hops"))


GRAPH_TYPED = """
WITH RECURSIVE l AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b, c_custkey % 10 / 10 AS w, 'lives' AS t FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey % 5 / 5, 'sells' FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1.0, 'part' FROM nation), e AS (SELECT a, b FROM l WHERE w >= 0.3 AND t IN ('lives', 'part') UNION SELECT b, a FROM l WHERE w >= 0.3 AND t IN ('lives', 'part')),
r(node, hops) AS (SELECT unnest(['c7', 'c8']), CAST(0 AS BIGINT) UNION SELECT e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node WHERE r.hops < 4)
SELECT node, min(hops) AS hops FROM r GROUP BY node
"""


def relation_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions among results stand for their nations."""
    nation = table(spark, sf_dir, "nation")
    relations = nation.groupBy((F.col("n_regionkey") + 1000).cast("long").alias("id")).agg(F.collect_list(F.col("n_nationkey").cast("long")).alias("participants"))
    customers = table(spark, sf_dir, "customer")
    plain = customers.select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").cast("long").alias("id"), F.lit("fact").alias("kind"))
    regions = customers.select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 5 + 1000).alias("id"), F.lit("relation").alias("kind"))
    excluded = nation.where("n_nationkey % 7 = 0").select(F.col("n_nationkey").cast("long").alias("id"))
    return graph.expand_relations(plain.unionByName(regions), relations, excluded)


RELATION_EXPAND = """
SELECT DISTINCT query_id, id FROM (SELECT c_custkey AS query_id, CAST(c_nationkey AS BIGINT) AS id FROM customer
UNION ALL SELECT c_custkey, CAST(n_nationkey AS BIGINT) FROM customer JOIN nation ON n_regionkey = c_custkey % 5) WHERE id % 7 <> 0
"""


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as summaries of their lines' parts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    rows = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    return rows.select("id", F.transform("s", lambda e: e["l_partkey"]).alias("summary_of"))


def lineage_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("id"))
    out = graph.visible_lineage(_summaries(spark, sf_dir), seen)
    return out.select("id", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"), "lost")


LINEAGE_VISIBLE = """
SELECT l_orderkey AS id, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) FILTER (p_partkey IS NOT NULL), '') AS sources, count(p_partkey) < count(*) AS lost
FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 40) ON p_partkey = l_partkey GROUP BY l_orderkey
"""


def lineage_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order that are copies of another line of it go: line n is a copy of line n - 2."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("id"))
    rows = lines.withColumn("degraded_from", F.when(F.col("id") > 2, F.col("id") - 2))
    return graph.collapse_lineage(rows).select("query_id", "id")


LINEAGE_COLLAPSE = "SELECT l_orderkey AS query_id, CAST(l_linenumber AS BIGINT) AS id FROM lineitem l WHERE NOT (l_linenumber > 2 AND EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_linenumber = l.l_linenumber - 2))"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, and the first and last word of every text, in ASCII, as the SQL's edit distances count bytes.

    The texts are read once: their names are written, and every step reads those.
    """
    ends = texts(spark, sf_dir).select(T.tokens("content").alias("t")).select(F.explode(F.array(F.try_element_at("t", F.lit(1)), F.try_element_at("t", F.lit(-1)))).alias("name"))
    words = ends.where("name is not null").distinct().select(F.regexp_replace("name", r"[^\x00-\x7F]", "x").alias("name"))
    folder = shared_folder(spark, "names")
    table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")).union(words).distinct().write.parquet(folder)
    return spark.read.parquet(folder)


_NAMES_SQL = f"""ts AS (SELECT list_transform({_TOKENS}, lambda t: regexp_replace(t, '[^\\x00-\\x7F]', 'x', 'g')) AS t FROM documents),
nm AS (SELECT lower(n_name) AS name FROM nation UNION SELECT t[1] FROM ts WHERE len(t) > 0 UNION SELECT t[-1] FROM ts WHERE len(t) > 0)"""


def _typed(known: DataFrame) -> DataFrame:
    return known.select(F.concat(F.substring("name", 1, 3), F.substring("name", 5, 99)).alias("name"))


def fuzzy_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against the same ones with a letter left out."""
    known = _names(spark, sf_dir)
    return graph.fuzzy_matches(_typed(known), known, 0.8)


_SIM = "CASE WHEN a = b THEN 1.0 WHEN starts_with(a, b) OR starts_with(b, a) THEN 0.7 + 0.3 * r WHEN contains(a, b) OR contains(b, a) THEN 0.5 + 0.3 * r ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END"
FUZZY_ENTITIES = f"""
WITH {_NAMES_SQL}, t AS (SELECT DISTINCT substr(name, 1, 3) || substr(name, 5, 99) AS a FROM nm),
p AS (SELECT a, name AS b, least(length(a), length(name)) / greatest(length(a), length(name)) AS r FROM t, nm)
SELECT a, b, round({_SIM}, 6) AS similarity FROM p WHERE round({_SIM}, 6) >= 0.8
"""


def loose_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations and regions against all names, six letters of ten alike or one within the other."""
    asked = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")).union(table(spark, sf_dir, "region").select(F.lower("r_name")))
    return graph.fuzzy_matches(asked, _names(spark, sf_dir), 0.6)


LOOSE_ENTITIES = f"""
WITH {_NAMES_SQL}, t AS (SELECT lower(n_name) AS a FROM nation UNION SELECT lower(r_name) FROM region),
p AS (SELECT a, name AS b, least(length(a), length(name)) / greatest(length(a), length(name)) AS r FROM t, nm)
SELECT a, b, round({_SIM}, 6) AS similarity FROM p WHERE round({_SIM}, 6) >= 0.6
"""


def one_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against the same with neighbours swapped, one edit apart."""
    names = _names(spark, sf_dir)
    swapped = names.select(F.concat(F.substring("name", 1, 3), F.substring("name", 5, 1), F.substring("name", 4, 1), F.substring("name", 6, 99)).alias("name"))
    return graph.one_edit_pairs(names, swapped)


ONE_EDIT = f"""
WITH {_NAMES_SQL}, n AS (SELECT name AS a FROM nm), s AS (SELECT DISTINCT substr(a, 1, 3) || substr(a, 5, 1) || substr(a, 4, 1) || substr(a, 6, 99) AS b FROM n)
SELECT a, b FROM n, s WHERE a = b OR (length(a) >= 2 AND length(b) >= 2 AND (substr(a, 1, 2) = substr(b, 1, 2) OR (length(a) = length(b) AND substr(a, 1, 2) = reverse(substr(b, 1, 2)))) AND damerau_levenshtein(a, b) <= 1)
"""

NAMES = (
    "snippet_cards redact_secrets entropy_tokens key_tokens end_date_extract vector_topk vector_neighbours hybrid_score source_quality version_intervals asof_value current_facts triple_query canonical_history graph_bfs graph_typed "
    "relation_expand lineage_visible lineage_collapse fuzzy_entities loose_entities one_edit"
).split()
