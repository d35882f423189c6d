"""Queries over generated lives: recall, grades, summaries, retention; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.operators import evaluate
from memlake.operators import grading as G
from memlake.sources.tables import table, texts


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _number(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 8) AS BIGINT)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lives(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("life_id")))


_LIVES = f"""sl AS (SELECT c_custkey AS life_id, unnest(range(0, 5)) AS slot FROM customer),
nm AS (SELECT *, 'unit' || substr(md5(life_id || ':' || slot), 1, 6) AS entity, {_list(G.ATTRIBUTES)}[slot + 1] AS attribute, 1 + {_number('life_id', 'slot', "'n'")} % 3 AS versions FROM sl),
tv AS (SELECT *, unnest(range(0, versions)) AS version FROM nm),
tl AS (SELECT *, {_list(G.VALUES)}[({_number('life_id', 'slot')} + version) % 6 + 1] AS value, version * 30 + {_number('life_id', 'slot', 'version')} % 20 AS day FROM tv),
te AS (SELECT *, CASE WHEN version = versions - 1 AND {_number('life_id', 'slot', "'x'")} % 4 = 0 THEN day + 10 END AS ends FROM tl),
ev AS MATERIALIZED (SELECT *, CASE WHEN version > 0 THEN 'Correction: the ' ELSE 'The ' END || attribute || ' of ' || entity || ' is ' || value || coalesce(' until day ' || ends, '') || '.' AS text FROM te),
gp AS (SELECT life_id, slot, entity, attribute, list(value ORDER BY version) AS v, max(ends) AS ends, max(day) AS day FROM ev GROUP BY ALL),
aw AS (SELECT *, unnest([slot, slot + 5]) AS turn FROM gp), ak AS (SELECT *, {_list(G.KINDS)}[(turn + life_id) % 5 + 1] AS w FROM aw),
ax AS (SELECT *, CASE WHEN w IN ('answerable_current', 'expired') THEN CASE WHEN ends IS NOT NULL THEN 'expired' ELSE 'answerable_current' END ELSE w END AS kind FROM ak),
pb AS MATERIALIZED (SELECT life_id * 10 + turn AS probe_id, life_id, kind, CASE WHEN kind = 'fabricated' THEN 'z' || entity || 'z' ELSE entity END AS entity, attribute, CASE WHEN kind IN ('answerable_current', 'carried_lesson') THEN [v[-1]] WHEN kind = 'answerable_historical' THEN [v[1]] ELSE [] END AS answers,
  CASE WHEN kind = 'expired' THEN v WHEN kind = 'answerable_current' THEN list_filter(v, lambda x: x <> v[-1]) ELSE [] END AS stale, day + 40 AS as_of, CASE WHEN life_id % 5 = 0 THEN 'dev' ELSE 'heldout' END AS split FROM ax)"""


def life_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("life_id", "slot", "version", "day", "ends", "text")


LIFE_EVENTS = f"WITH {_LIVES} SELECT life_id, slot, version, day, ends, text FROM ev"


def life_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.probes(_events(spark, sf_dir)).select("probe_id", "life_id", "kind", "entity", F.array_join("answers", "|").alias("answers"), F.size("stale").cast("long").alias("stale"), "as_of", "split")


LIFE_PROBES = f"WITH {_LIVES} SELECT probe_id, life_id, kind, entity, array_to_string(answers, '|') AS answers, len(list_distinct(stale)) AS stale, as_of, split FROM pb"

_HIT = "(CASE WHEN contains(lower({text}), lower({term})) THEN regexp_matches(' ' || lower({text}) || ' ', '[^\\p{{L}}\\p{{N}}]' || regexp_escape(lower({term})) || '[^\\p{{L}}\\p{{N}}]') ELSE false END)"


def _recalled(strict: bool) -> str:
    best = "WHERE best >= 2" if strict else ""
    return f"""ms AS (SELECT probe_id, ev.slot, version, day, text, CAST(contains(text, pb.entity) AS INT) * 2 + CAST(contains(text, pb.attribute) AS INT) AS score FROM pb JOIN ev USING (life_id)),
mb AS (SELECT *, max(score) OVER (PARTITION BY probe_id) AS best FROM ms WHERE score > 0), rr AS (SELECT probe_id, text, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, day DESC, slot, version) AS rank FROM mb {best} QUALIFY rank <= 5)"""


def _graded(strict: bool) -> str:
    answer = f"list_bool_or(list_transform(answers, lambda a: {_HIT.format(text='text', term='a')}))"
    stale = f"{_HIT.format(text='text', term='entity')} AND coalesce(list_bool_or(list_transform(stale, lambda a: {_HIT.format(text='text', term='a')})), false)"
    return f"""{_recalled(strict)}, gj AS (SELECT pb.*, rank, coalesce({answer}, false) AS a, coalesce({stale}, false) AS s FROM pb LEFT JOIN rr USING (probe_id)),
ga AS (SELECT probe_id, life_id, kind, split, count(rank) AS returned_rows, min(rank) FILTER (a) AS answer, min(rank) FILTER (s) AS stale_rank, count(*) FILTER (s) AS served FROM gj GROUP BY ALL),
gr AS (SELECT probe_id, life_id, kind, split, returned_rows, kind NOT IN ('fabricated', 'expired') AND answer IS NOT NULL AS answer_hit, CASE WHEN kind NOT IN ('fabricated', 'expired') THEN answer END AS answer_rank, CASE WHEN kind = 'fabricated' THEN returned_rows ELSE 0 END AS fabricated_rows,
  CASE WHEN kind = 'expired' THEN served ELSE 0 END AS expired_served, CAST(coalesce(kind = 'answerable_current' AND stale_rank <= answer, false) AS INT) AS stale_above_current, kind = 'fabricated' AND returned_rows > 0 AS answered_fabricated FROM ga)"""


def _grades(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    told = _events(spark, sf_dir)
    asked = G.probes(told)
    return G.grade(asked, G.recall_life(asked, told, strict=strict))


def probe_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grades(spark, sf_dir)


PROBE_GRADES = f"WITH {_LIVES}, {_graded(False)} SELECT * FROM gr"


def grade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.summarize(_grades(spark, sf_dir, True), ["split"])


def _summary(by: str) -> str:
    kinds = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}_probes, count(*) FILTER (kind = '{k}' AND answer_hit) AS {k}_hits, coalesce(CAST(sum(returned_rows) FILTER (kind = '{k}') AS BIGINT), 0) AS {k}_returned" for k in G.KINDS)
    rate = "round(count(*) FILTER (answer_hit AND {c}) / nullif(count(*) FILTER ({c}), 0), 6)"
    return f"""SELECT {by}, count(*) AS probes, {kinds}, {rate.format(c="kind IN ('answerable_current', 'answerable_historical')")} AS answerable_recall, {rate.format(c="kind = 'carried_lesson'")} AS lesson_recall,
count(*) FILTER (answered_fabricated) AS fabricated_with_rows, CAST(sum(fabricated_rows) AS BIGINT) AS fabricated_rows, CAST(sum(expired_served) AS BIGINT) AS expired_served, count(*) FILTER (expired_served > 0) AS expired_probes_served, CAST(sum(stale_above_current) AS BIGINT) AS stale_above_current FROM gr GROUP BY {by}"""


GRADE_SUMMARY = f"WITH {_LIVES}, {_graded(True)} {_summary('split')}"


def prefetch_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the two best rows as one text."""
    told = _events(spark, sf_dir)
    asked = G.probes(told)
    rows = G.recall_life(asked, told, k=2)
    contexts = rows.groupBy("probe_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda e: e["text"]), "\n").alias("context"))
    return G.grade_prefetch(asked, contexts)


_CONTEXT_HIT = _HIT.format(text="ctx", term="a")
PREFETCH_GRADES = f"""WITH {_LIVES}, {_recalled(False)}, cx AS (SELECT probe_id, string_agg(text, chr(10) ORDER BY rank) AS ctx FROM rr WHERE rank <= 2 GROUP BY 1),
cj AS (SELECT pb.*, coalesce(list_bool_or(list_transform(answers, lambda a: {_CONTEXT_HIT})), false) AS a, coalesce(list_bool_or(list_transform(stale, lambda a: {_CONTEXT_HIT})), false) AS s, coalesce({_HIT.format(text='ctx', term='entity')}, false) AS e, ctx IS NOT NULL AS given FROM pb LEFT JOIN cx USING (probe_id))
SELECT probe_id, kind, kind NOT IN ('fabricated', 'expired') AND a AS answer_present, kind = 'fabricated' AND given AS fabricated_present, kind = 'expired' AND e AND s AS expired_present, kind = 'answerable_current' AND s AND NOT a AS stale_present FROM cj"""


def provenance_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons whose rows carry a line on the model they were told under; every third names another one."""
    told = _events(spark, sf_dir)
    asked = G.probes(told).where("kind = 'carried_lesson'").withColumn("model_a", F.lit("model, large"))
    rows = G.recall_life(asked, told, k=3).withColumn("p", F.col("probe_id") + F.col("rank"))
    model = F.when(F.col("p") % 3 == 0, "other").otherwise("model, large")
    line = F.when(F.col("p") % 2 == 0, F.concat(F.lit("\n    learned under model "), model, F.lit(", engine 1.2, 2024-05-06"))).otherwise("")
    lines = rows.select("probe_id", "rank", F.concat(F.lit("  [2024] "), "text", line).alias("t"))
    contexts = lines.groupBy("probe_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "t"))), lambda e: e["t"]), "\n").alias("context"))
    return G.grade_provenance(asked, contexts)


PROVENANCE_GRADES = f"""WITH {_LIVES}, {_recalled(False)}, lx AS (SELECT pb.probe_id, coalesce((pb.probe_id + rank) % 2 = 0, false) AS has, coalesce((pb.probe_id + rank) % 3 = 0, false) AS other, coalesce({_HIT.format(text='text', term='answers[1]')}, false) AS own FROM pb LEFT JOIN rr ON rr.probe_id = pb.probe_id AND rank <= 3 WHERE kind = 'carried_lesson')
SELECT probe_id, bool_or(has AND own) AS provenance_present, count(*) FILTER (has) AS provenance_lines, count(*) FILTER (has AND other) AS wrong_model FROM lx GROUP BY 1"""


def arm_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms on the same probes by kind: how often they differ, their hits, and the share that is the same."""
    a, b = _grades(spark, sf_dir), _grades(spark, sf_dir, True)
    both = a.select("probe_id", "kind", F.col("answer_hit").cast("int").alias("a"), F.col("returned_rows").alias("ra")).join(b.select("probe_id", F.col("answer_hit").cast("int").alias("b"), F.col("returned_rows").alias("rb")), "probe_id")
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.sum(F.col("rb") - F.col("ra")).alias("more_rows"), evaluate.exact_share(F.col("ra"), F.col("rb")).alias("same"))


_BOTH = f"WITH {_LIVES}, {_graded(False)}, {_graded(True).replace('ms AS', 'ms2 AS').replace('FROM ms ', 'FROM ms2 ').replace('mb AS', 'mb2 AS').replace('FROM mb ', 'FROM mb2 ').replace('rr AS', 'rr2 AS').replace('JOIN rr ', 'JOIN rr2 ').replace('gj AS', 'gj2 AS').replace('FROM gj ', 'FROM gj2 ').replace('ga AS', 'ga2 AS').replace('FROM ga)', 'FROM ga2)').replace('gr AS', 'gr2 AS')}"
ARM_GRADES = _BOTH + "SELECT kind, count(*) AS n, round(avg(CAST(a.answer_hit AS INT)), 6) AS mean_a, round(avg(CAST(b.answer_hit AS INT)), 6) AS mean_b, CAST(sum(b.returned_rows - a.returned_rows) AS BIGINT) AS more_rows, round(avg(CAST(a.returned_rows = b.returned_rows AS INT)), 6) AS same FROM gr a JOIN gr2 b USING (probe_id, kind) GROUP BY kind"


def goal_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [G.summarize(_grades(spark, sf_dir, strict).withColumn("all", F.lit(1)), ["all"]) for strict in (True, False)]
    return G.verdicts(both[0], both[1], secret_count(spark, sf_dir))


def secret_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers as planted secrets; some of them stand in texts."""
    planted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("secret_id"), F.concat(F.lit("item"), F.col("c_custkey").cast("string"), F.lit(" passes")).alias("secret"), F.concat(F.lit("item"), F.col("c_custkey").cast("string")).alias("token"))
    kept = texts(spark, sf_dir).select(F.concat("content", F.lit(" ITEM"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, " Passes").otherwise(" fails")).alias("content"))
    return G.secrets_stored(planted, kept)


SECRET_COUNT = "SELECT count(*) AS planted, count(*) FILTER (c_custkey % 3 = 0 AND c_custkey IN (SELECT doc_id FROM documents)) AS stored FROM customer"
_RATE = "count(*) FILTER (answer_hit AND kind IN ('answerable_current', 'answerable_historical')) / count(*) FILTER (kind IN ('answerable_current', 'answerable_historical'))"
GOAL_VERDICTS = _BOTH + f""", x1 AS (SELECT round({_RATE}, 6) AS r, count(*) FILTER (answered_fabricated) AS f, sum(expired_served) AS e FROM gr2), x0 AS (SELECT round({_RATE}, 6) AS r FROM gr), sc AS ({SECRET_COUNT})
SELECT round((x0.r - x1.r) * 100, 4) AS recall_cost, x1.f = 0 AND round((x0.r - x1.r) * 100, 4) <= 1.0 AS fabricated_zero, x1.e = 0 AS expired_zero, stored = 0 AS secrets_zero FROM x1, x0, sc"""


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current-truth probes at their own and all later stages; at each only the newest three events of a life are still held."""
    told = _events(spark, sf_dir)
    asked = G.probes(told)
    staged = evaluate.stage_of(told, "life_id", "day")
    # Lives are made from ids, by whose size Spark judges them: none is broadcast.
    own = asked.join(G.cohorts(asked, staged).hint("merge"), "probe_id").select("probe_id", "life_id", "kind", "split", "entity", "attribute", "answers", "stale", "cohort", F.explode(F.sequence("cohort", F.lit(G.STAGES - 1))).alias("stage"))
    seen = own.select("probe_id", "life_id", "stage", F.col("entity").alias("named"), "answers").join(staged.select("life_id", F.col("stage").alias("told"), "day", "slot", "version", "text").hint("merge"), "life_id").where("told <= stage")
    order = Window.partitionBy("life_id", "probe_id", "stage").orderBy(F.desc("day"), F.asc("slot"), F.asc("version"))
    held = seen.withColumn("n", F.row_number().over(order)).where("n <= 3")
    answer = F.exists("answers", lambda a: G.contains_term("text", a)) & F.contains("text", F.col("named"))
    hits = held.groupBy("probe_id", "stage").agg(F.bool_or(answer).alias("hit"))
    return own.join(hits.hint("merge"), ["probe_id", "stage"]).select("life_id", "probe_id", "cohort", "stage", "hit")


_OBSERVED = f"""WITH {_LIVES}, dr AS (SELECT *, dense_rank() OVER (PARTITION BY life_id ORDER BY day) - 1 AS r FROM ev), sg AS (SELECT *, r * 4 // (max(r) OVER (PARTITION BY life_id) + 1) AS stage FROM dr),
co AS (SELECT probe_id, min(stage) AS cohort FROM pb JOIN sg ON sg.life_id = pb.life_id AND sg.entity = pb.entity AND sg.attribute = pb.attribute AND list_contains(answers, value) WHERE kind = 'answerable_current' GROUP BY 1),
ow AS (SELECT pb.*, cohort, unnest(range(cohort, 4)) AS stage FROM pb JOIN co USING (probe_id)),
hd AS (SELECT ow.life_id, probe_id, cohort, ow.stage, ow.entity, answers, text, row_number() OVER (PARTITION BY probe_id, ow.stage ORDER BY day DESC, slot, version) AS n FROM ow JOIN sg ON sg.life_id = ow.life_id AND sg.stage <= ow.stage),
ob AS (SELECT life_id, probe_id, cohort, stage, bool_or(contains(text, entity) AND list_bool_or(list_transform(answers, lambda a: {_HIT.format(text='text', term='a')}))) AS hit FROM hd WHERE n <= 3 GROUP BY ALL)"""


def staged_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir)


STAGED_OBSERVATIONS = _OBSERVED + " SELECT * FROM ob"


def stage_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = _observed(spark, sf_dir).groupBy("stage", "cohort").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("recall"))
    return G.stage_drop(matrix).select(F.col("stage").cast("long").alias("stage"), F.col("cohort").cast("long").alias("cohort"), "recall", "fallen")


STAGE_DROP = _OBSERVED + ", mx AS (SELECT stage, cohort, round(avg(CAST(hit AS INT)), 6) AS recall FROM ob GROUP BY ALL) SELECT CAST(m.stage AS BIGINT) AS stage, CAST(cohort AS BIGINT) AS cohort, m.recall, round(f.recall - m.recall, 6) AS fallen FROM mx m LEFT JOIN mx f USING (cohort) WHERE f.stage = f.cohort"


def life_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.backward_transfer(_observed(spark, sf_dir))


LIFE_TRANSFER = _OBSERVED + " SELECT a.life_id, round(avg(CAST(b.hit AS INT) - CAST(a.hit AS INT)), 6) AS transfer, count(*) AS probes FROM ob a JOIN ob b USING (life_id, probe_id) WHERE a.stage = a.cohort AND b.stage = 3 GROUP BY a.life_id"


def aa_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms that may differ: the tuples of two recalls of the same probes, the second of which drops its last row now and then."""
    told = _events(spark, sf_dir)
    asked = G.probes(told)
    rows = G.recall_life(asked, told)
    dropped = rows.where(~((F.col("rank") == 5) & (F.col("probe_id") % 97 == 5)))
    a, b = (G.grade(asked, r).select("probe_id", F.struct("returned_rows", "answer_rank", "expired_served").alias("t")) for r in (rows, dropped))
    counted = a.join(b.select("probe_id", F.col("t").alias("u")), "probe_id").agg(F.count("*").alias("n"), F.count_if(~F.col("t").eqNullSafe(F.col("u"))).alias("differing"))
    return counted.withColumn("flat", F.col("differing") <= F.greatest(F.lit(1.0), F.col("n") / 100))


AA_GRADES = f"WITH {_LIVES}, {_recalled(False)}, c AS (SELECT count(*) AS n, (SELECT count(*) FROM rr WHERE rank = 5 AND probe_id % 97 = 5) AS differing FROM pb) SELECT n, differing, differing <= greatest(1.0, n / 100) AS flat FROM c"

NAMES = (
    "life_events life_probes probe_grades grade_summary prefetch_grades provenance_grades arm_grades secret_count goal_verdicts staged_observations stage_drop life_transfer aa_grades"
).split()
