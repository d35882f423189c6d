"""Stores and documents that are checked before they are read: paths, layouts and versions, JSON without double keys."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.operators import sweep
from memlake.sources.files import MEMORY_SCHEMA

MOST_BYTES = 100_000
SCHEMES = ("", "file", "hdfs", "s3a", "abfs", "abfss", "gs", "viewfs")
VERSION = 3


def resolve(explicit: str | None, configured: str | None, default: str) -> str:
    """The store's folder: the explicit one, else the configured one, else the default; what is no folder is refused."""
    path = (explicit or configured or default).strip()
    if not path or path == ":memory:" or "\0" in path:
        raise ValueError("a store is a folder")
    if urlsplit(path).scheme not in SCHEMES:
        raise ValueError(f"unknown kind of store: {urlsplit(path).scheme}")
    return path.rstrip("/") or "/"


def _v1(df: DataFrame) -> DataFrame:
    return df.withColumn("importance", F.lit(5))


def _v2(df: DataFrame) -> DataFrame:
    return df.withColumns({"context": F.lit(None).cast("string"), "summary": F.lit(None).cast("string"), "keywords": F.lit(None).cast("string")})


def _v3(df: DataFrame) -> DataFrame:
    return df.withColumns({"access_count": F.lit(0), "last_accessed": F.lit(None).cast("double")})


#: What takes a store from each version to the next.
MIGRATIONS: tuple[Callable[[DataFrame], DataFrame], ...] = (_v1, _v2, _v3)


def migrate(df: DataFrame, version: int) -> DataFrame:
    """A store of an older version as one of the present; a newer version is refused."""
    if not 0 <= version <= VERSION:
        raise ValueError(f"unknown version {version}")
    for step in MIGRATIONS[version:]:
        df = step(df)
    missing = [f.name for f in MEMORY_SCHEMA if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in MEMORY_SCHEMA])


def _unique(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("double key")
    return dict(pairs)


def _fault(text: str | None) -> str | None:
    if text is None or len(text.encode()) > MOST_BYTES:
        return "too long" if text else "missing"
    try:
        found = json.loads(text, object_pairs_hook=_unique)
    except RecursionError:
        return "too deep"
    except ValueError as error:
        return "double key" if "double key" in str(error) else "not JSON"
    return None if isinstance(found, dict) else "no object"


def json_faults(df: DataFrame, column: str, name: str = "fault") -> DataFrame:
    """The rows with what is wrong with their JSON object, null for nothing; the parsers of SQL let double keys pass."""

    @F.pandas_udf("string")
    def fault(texts: pd.Series) -> pd.Series:
        return texts.map(_fault)

    return df.withColumn(name, fault(F.col(column)))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file, each checked; a fault fails the read."""
    raw = json_faults(spark.read.option("wholetext", True).text(path), "value")
    sure = F.when(F.col("fault").isNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad document: "), "fault")).cast("string"))
    return raw.select(F.from_json(sure, schema).alias("d")).select("d.*")


def evidence_markdown(rows: DataFrame, most_index: int = 8000) -> DataFrame:
    """``id, section, indexed`` of ``rows(id, title, content)``: a section each, and whether the index, bounded in characters, still names it."""
    entry = F.concat(F.lit("- "), "title", F.lit("\n"))
    # Only the head of the ids can be in the index, so a part's own sum is added to those of the parts before it.
    dealt = sweep.dealt(rows, ["id"], []).withColumnRenamed("_part", "part").withColumn("size", F.length(entry))
    before = F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy("part").agg(F.sum("size").alias("s")).select("part", before.alias("before"))
    running = F.sum("size").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("running", running).join(F.broadcast(sums), "part")
    section = F.concat(F.lit("## "), "title", F.lit("\n\n"), "content", F.lit("\n"))
    return placed.select("id", section.alias("section"), (F.col("running") + F.col("before") <= most_index).alias("indexed"))


def write_markdown(rows: DataFrame, path: str) -> None:
    """Sections as text files; a folder that is there is refused, as is one that looks like a database."""
    if path.rstrip("/").endswith((".db", ".sqlite", ".sqlite3")):
        raise ValueError("the destination is a database")
    evidence_markdown(rows).select("section").write.mode("errorifexists").text(path)
