"""A training-corpus pipeline of five stages, each on all that the one before has kept.

Every stage takes the columns of documents with any others, whatever their names,
and all but the last return just these.  Rows may lack an id or repeat one: a row is
judged by its own text.  Null, empty and blank texts are clean: they pass all stages
unless the mix takes no copy of their source's documents.  Texts are read whole,
however long.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm import decontaminate, minhash_dedup, mixing, pii, toxicity
from memlake.llm.session import checkpointed, fresh, row_key

#: A document with this toxicity score or more is rejected.
MOST_TOXIC = 0.7
#: No stage has SQL for its rows: a model is fitted, signatures and draws are hashed.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; all labels of these documents may be learnt from.

    Rows that repeat a text are judged alike.  Without labels of both kinds all stay.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, sentences = fresh(docs, "score"), fresh(docs, "sentences")
    scored = toxicity.score_rows(docs, model, score=score, sentences=sentences)
    return scored.where(F.col(score) < MOST_TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more: one of the smallest id, rows without an id last.

    Of rows that repeat the kept one's id and text, one stays.  Texts without words
    are in no group, so all of them stay.
    """
    groups = checkpointed(minhash_dedup.near_duplicates(docs, num=4, den=5).select("row_key", "group_key", "kept"))
    gone = groups.where(~F.col("kept")).select("row_key")
    # Rows that count as kept may share a group still: repeated ids, or groups without any id.
    several = groups.where("kept and group_key is not null").groupBy("group_key").agg(F.count("*").alias("n"), F.min("row_key").alias("stays")).where("n > 1")
    several = checkpointed(several.select("group_key", "stays"))
    if several.isEmpty():
        return _without(docs, gone)
    others = groups.where("kept").join(several, "group_key").where("row_key <> stays").select("row_key")
    key, stays = fresh(docs, "row_key"), several.select(F.col("stays").alias("row_key"))
    rest = _without(docs, gone.union(others).union(stays))
    once = docs.withColumn(key, row_key("doc_id", "text")).join(stays.toDF(key), key, "left_semi").dropDuplicates([key])
    return rest.unionByName(once.drop(key))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    gone = fresh(docs, "gone")
    return docs.join(keys.distinct().toDF(gone), row_key("doc_id", "text") == F.col(gone), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item, exact or edited; rows that repeat a text are judged alike."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; ``n_chars`` follows the text, null texts stay null."""
    out = pii.redact_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies`` (1 to 3) and ``taken`` words, in place of columns of these names.

    Of rows that repeat id, source and text, which take which copies is open.
    """
    docs = docs.drop("copies", "taken")
    key = ["doc_id", "source", "text_hash"]
    mixed = mixing.mix(docs).groupBy(*key, "size").agg(F.count("*").alias("rows"), F.sum("copies").alias("copies"))
    mixed = checkpointed(mixed.where("copies > 0"))
    names = {c: fresh(docs, f"{c}_mixed") for c in (*key, "size", "rows", "copies")}
    mixed = mixed.toDF(*[names[c] for c in mixed.columns])
    own = (F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = F.lit(True)
    for c, value in zip(key, own, strict=True):
        same = same & value.eqNullSafe(F.col(names[c]))
    taken = docs.join(mixed, same)
    rows, copies = F.col(names["rows"]), F.col(names["copies"])
    share = (copies / rows).cast("long")
    if not mixed.where(copies % rows != 0).isEmpty():
        # Equal rows share their copies evenly; where these don't come out even the rows are numbered.
        turn = F.row_number().over(Window.partitionBy(*[names[c] for c in key]).orderBy(F.lit(0)))
        share = F.floor(copies / rows) + F.when(turn <= copies % rows, 1).otherwise(0)
    out = taken.withColumn(names["copies"], share).where(copies > 0)
    return out.select(*docs.columns, copies.cast("long").alias("copies"), (copies * F.col(names["size"])).cast("long").alias("taken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", redact),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; a stage's rows are written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
