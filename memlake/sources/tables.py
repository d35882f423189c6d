"""The driver tables as the library's concepts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the cluster's checkpoints; a session on one machine that names none gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/memlake-{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=f"memlake-{name}-") + "/data"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, content, namespace, created_at`` of the documents; a text's length stands for its time."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("namespace"), F.col("n_chars").cast("double").alias("created_at"))


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, importance`` from the quality labels: 8 for good texts, 2 for others."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 8).otherwise(2).alias("importance"))


def with_importance(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with their importance, 5 where there is none."""
    return rows.join(labels, "id", "left").withColumn("importance", F.coalesce("importance", F.lit(5)))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id, turn, role, content`` of the conversations."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
