"""File sources and sinks: strict JSON lines, snapshots with a pointer, exports, schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

MEMORY_SCHEMA = StructType(
    [
        StructField("id", StringType(), False),
        StructField("content", StringType(), False),
        StructField("namespace", StringType(), False),
        StructField("importance", IntegerType()),
        StructField("context", StringType()),
        StructField("summary", StringType()),
        StructField("keywords", StringType()),
        StructField("created_at", DoubleType()),
        StructField("access_count", IntegerType()),
        StructField("last_accessed", DoubleType()),
    ]
)
MOST_CHARACTERS = 100_000


def classify(df: DataFrame) -> str:
    """``fresh`` without columns, ``ours`` with just the memory columns, else ``refuse``; checked before any write."""
    if not df.columns:
        return "fresh"
    return "ours" if [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in MEMORY_SCHEMA] else "refuse"


def read_ledger(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines that must all be well formed: a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def remember(rows: DataFrame) -> DataFrame:
    """New memories from ``content, namespace, importance, created_at``, checked row by row.

    Blank or over-long texts and importances outside of 0 .. 10 fail the job.  An id is
    made from what the row says, so a retried write makes no second memory.
    """
    ok = (F.trim("content") != "") & (F.length("content") <= MOST_CHARACTERS) & F.coalesce(F.col("importance").between(0, 10), F.lit(True))
    checked = rows.withColumn("content", F.when(F.coalesce(ok, F.lit(False)), F.col("content")).otherwise(F.raise_error(F.lit("content must be 1 to 100000 characters and importance 0 to 10")).cast("string")))
    made = checked.withColumn("id", F.substring(F.sha2(F.concat_ws("|", "namespace", "content", F.col("created_at").cast("string")), 256), 1, 16))
    defaults = {"importance": F.coalesce("importance", F.lit(5)), "context": F.lit(None).cast("string"), "summary": F.lit(None).cast("string"), "keywords": F.lit(None).cast("string"), "access_count": F.lit(0), "last_accessed": F.lit(None).cast("double")}
    return made.withColumns(defaults).select(*[F.col(f.name).cast(f.dataType) for f in MEMORY_SCHEMA])


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def import_json(spark: SparkSession, path: str, existing: DataFrame, force: bool = False) -> DataFrame:
    """The rows of an export that the store lacks; with ``force`` they replace rows of the same id."""
    rows = spark.read.schema(MEMORY_SCHEMA).option("mode", "FAILFAST").json(path)
    if force:
        return existing.join(rows.select("id"), "id", "left_anti").select(*rows.columns).unionByName(rows)
    return existing.unionByName(rows.join(existing.select("id"), "id", "left_anti").select(*existing.columns))


def content_digest(df: DataFrame) -> DataFrame:
    """``rows, digest, sums``: the number of rows, and two sums over their hashes that no order changes and repeated rows don't cancel."""
    row = F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in df.columns])
    # Halves of the hashes, so that sums of any number of rows stay whole.
    return df.select(row.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("digest"), F.coalesce(F.sum((F.shiftrightunsigned("h", 32) + F.col("h").bitwiseAND(0x7FFFFFFF)).cast("decimal(20, 0)")), F.lit(0)).cast("decimal(38, 0)").cast("string").alias("sums"))


_POINTER = "version int, path string, rows long, digest long, sums string"


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write a full snapshot and then a pointer row with its digest; readers follow the newest pointer.

    The digest is of what was written, so a snapshot is only pointed at once it can be read.
    """
    path = f"{root}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    checksum = content_digest(df.sparkSession.read.parquet(path))
    checksum.select(F.lit(version).alias("version"), F.lit(path).alias("path"), "rows", "digest", "sums").coalesce(1).write.mode("append").json(f"{root}/pointers")
    return path


def read_snapshot(spark: SparkSession, root: str, version: int | None = None, check: bool = True) -> DataFrame:
    """The newest snapshot, or the one of a version; one whose rows aren't those that were written is refused."""
    pointers = spark.read.schema(_POINTER).json(f"{root}/pointers")
    chosen = (pointers.where(F.col("version") == version) if version is not None else pointers).orderBy(F.desc("version")).first()
    if chosen is None:
        raise ValueError("no such snapshot")
    rows = spark.read.parquet(chosen.path)
    if check and tuple(content_digest(rows).first()) != (chosen.rows, chosen.digest, chosen.sums):
        raise ValueError(f"snapshot {chosen.version} isn't what was written")
    return rows


def expired_backups(backups: DataFrame, keep: int) -> DataFrame:
    """Backups but the newest ``keep``; of equal times the paths that sort first stay."""
    newest = backups.orderBy(F.desc("made_at"), F.asc("path")).limit(keep)
    return backups.join(newest.select("path"), "path", "left_anti")
