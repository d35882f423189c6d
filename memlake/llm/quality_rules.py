"""Quality rules whose thresholds come from quantile sketches of each language and source.

The sketch is a histogram over logarithmic buckets with a fixed relative error
(as in DDSketch).  Sketches merge by adding counts, in any order and with the
same result, so a language's sketch is the sum of its sources' and the sketch of
everything the sum of all.  A group's quartiles are weighed with those of the next
wider group by their numbers of documents, the wider one counting as
``PARENT_WEIGHT``: one formula from a single document to any number.  A
threshold is a fence around the middle half of a group's documents: ``REACH`` times
the distance of the quartiles beyond them, or ``REACH`` times what one more symbol
or repeated line adds in the document at hand, if this is larger.  Documents beyond
a fence are rejected after a join of the quartiles.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.session import checkpointed

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
#: Buckets grow by this factor: a quantile is within 2 % of the data's.
GROWTH = 1.02


class Rule(NamedTuple):
    """A metric, what one more occurrence adds to it, and whether there is a fence below the quartiles, too."""

    metric: str
    step: str
    below: bool = False


#: Metrics are whole numbers: shares in hundredths of a percent, lengths in hundredths.
RULES = (
    Rule("symbols", "try_divide(10000D, word_chars)"),
    Rule("dup_lines", "try_divide(10000D, n_lines)"),
    Rule("repeats", "try_divide(20000D, n_lines)"),
    Rule("word_length", "try_divide(metrics.word_length, n_words)", below=True),
)
REACH = 3.0
#: Documents as which a group's wider group counts beside its own.
PARENT_WEIGHT = 100


def document_statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang, source`` and counts over the whole text: words, their characters, symbols, lines, repeats."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACE, "") != "").alias("lines"),
    )
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1), F.element_at("words", i + 2))))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # Most texts repeat no window; only the others sort theirs.
    placed = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("placed", placed).drop("windows")
    same = lambda k, j: F.element_at("placed", k)["h"] == F.try_element_at("placed", j)["h"]
    repeated = F.filter(F.sequence(F.lit(1), F.size("placed")), lambda k: F.coalesce(same(k, k + 1), F.lit(False)) | F.coalesce(F.when(k > 1, same(k, k - 1)), F.lit(False)))
    at = F.when(F.col("placed").isNotNull(), F.sort_array(F.transform(repeated, lambda k: F.element_at("placed", k)["i"])))
    rows = rows.withColumn("at", at).drop("placed")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
    )["n"]
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def _metrics() -> Column:
    share = lambda part, whole: F.when(F.col(whole) > 0, F.expr(f"10000 * {part} div {whole}")).otherwise(F.lit(0).cast("long"))
    values = {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "word_length": F.when(F.col("n_words") > 0, F.expr("100 * word_chars div n_words")).otherwise(F.lit(0).cast("long")),
    }
    return F.struct(*[v.alias(k) for k, v in values.items()])


def sketches(statistics: DataFrame) -> DataFrame:
    """``lang, source, level, metric, bucket, n``: level 2 for language and source, 1 for language, 0 for all."""
    long = statistics.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(r.metric).alias("metric"), F.col(f"metrics.{r.metric}").alias("value")) for r in RULES])).alias("m"))
    value = F.col("m.value")
    bucket = F.when(value <= 0, F.lit(0)).otherwise(1 + F.floor(F.log(F.greatest(value, F.lit(1)).cast("double")) / math.log(GROWTH)).cast("int"))
    leaf = long.groupBy("lang", "source", F.col("m.metric").alias("metric"), bucket.alias("bucket")).agg(F.count("*").alias("n"))
    level = [leaf.select("lang", "source", F.lit(2).alias("level"), "metric", "bucket", "n")]
    level.append(leaf.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("source"), F.lit(1).alias("level"), "metric", "bucket", "n"))
    level.append(leaf.groupBy("metric", "bucket").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(0).alias("level"), "metric", "bucket", "n"))
    return level[0].unionByName(level[1]).unionByName(level[2])


def quartiles(sketch: DataFrame) -> DataFrame:
    """``lang, source, level, docs`` and for each metric ``metric_q1, metric_q3``, of each group by itself."""
    keys = ["lang", "source", "level", "metric"]
    whole = Window.partitionBy(*keys)
    running = sketch.withColumn("docs", F.sum("n").over(whole)).withColumn("up_to", F.sum("n").over(whole.orderBy("bucket")))
    # The value of a bucket is its upper end.
    value = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(F.pow(F.lit(GROWTH), F.col("bucket").cast("double")))
    quantile = lambda num: F.min(F.when(4 * F.col("up_to") >= num * F.col("docs"), value))
    found = running.groupBy(*keys).agg(quantile(1).alias("q1"), quantile(3).alias("q3"), F.max("docs").alias("docs"))
    pick = lambda r, q: F.max(F.when(F.col("metric") == r.metric, F.col(q))).alias(f"{r.metric}_{q}")
    return found.groupBy("lang", "source", "level").agg(F.max("docs").alias("docs"), *[pick(r, q) for r in RULES for q in ("q1", "q3")])


def apply_quality_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", parent_weight: float = PARENT_WEIGHT) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` for each row.

    Null, empty and blank texts have no words and fail the base rules, as all of
    fewer than 50 words do.  A null language or source is a group of its own.
    Sketches hold the documents that pass the base rules.  With ``n`` of these in a
    language, its quartiles are ``(n * own + parent_weight * all) / (n +
    parent_weight)``; those of a language's source are weighed alike with the
    language's.  A value at a fence is kept.  Texts of any length are counted whole.
    Repeated rows count and are judged each.  An empty table gives an empty one.
    Other columns are ignored.
    """
    stats = document_statistics(documents, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = checkpointed(stats.withColumn("metrics", _metrics()).withColumn("base_failed", failed))
    limits = checkpointed(quartiles(sketches(stats.where(~F.col("base_failed")))))
    names = [f"{r.metric}_{q}" for r in RULES for q in ("q1", "q3")]
    out = stats
    for level, keys in ((2, ["lang", "source"]), (1, ["lang"]), (0, [])):
        side = limits.where(F.col("level") == level)
        side = side.select(*[F.col(k).alias(f"{k}_{level}") for k in keys], F.struct("docs", *names).alias(f"limits_{level}"))
        if keys:
            on = F.lit(True)
            for k in keys:
                on = on & F.col(k).eqNullSafe(F.col(f"{k}_{level}"))
            out = out.join(side, on, "left").drop(*[f"{k}_{level}" for k in keys])
        else:
            # One row at most.
            out = out.join(F.broadcast(side), F.lit(True), "left")
    limit = {name: F.col(f"limits_0.{name}") for name in names}
    for level in (1, 2):
        n = F.coalesce(F.col(f"limits_{level}.docs"), F.lit(0)).cast("double")
        own = {name: F.coalesce(F.col(f"limits_{level}.{name}"), F.lit(0.0)) for name in names}
        limit = {name: (n * own[name] + F.lit(float(parent_weight)) * limit[name]) / (n + F.lit(float(parent_weight))) for name in names}
    fine = ~F.col("base_failed")
    for r in RULES:
        value, q1, q3 = F.col(f"metrics.{r.metric}"), limit[f"{r.metric}_q1"], limit[f"{r.metric}_q3"]
        width = REACH * F.greatest(q3 - q1, F.expr(r.step))
        fine = fine & F.coalesce(value <= q3 + width, F.lit(True))
        if r.below:
            fine = fine & F.coalesce(value >= q1 - width, F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", fine.alias("kept"))
