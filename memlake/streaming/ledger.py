"""A ledger of predictions as a stream: predict, record, validate, with state by attempt.

An attempt foretells which cases it will fix, records which cases pass before and
after it, and is validated.  State holds an attempt's entries in order until it is
validated or its time is up; entries that come twice are dropped, and entries may
come in any order before the validation.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENTRY = "seq long, kind string, case_id string, passed boolean"
OUTCOME = "attempt string, status string, fixed long, missed long, already long, collateral long, too_late long, passed long, total long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of this kind needs Spark's RocksDB store; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def outcome(attempt: str, status: str, entries: list[tuple[int, str, str | None, bool | None]]) -> Row:
    """An attempt's outcome from its entries ``(seq, kind, case_id, passed)``.

    Of several entries on a case the last one counts.  A prediction that stands
    behind a result in the ledger is too late and counts for nothing.  A foretold case
    is fixed, missed or passed already; one that passed before and fails
    unforetold is collateral.
    """
    entries = sorted(entries)
    results = [e for e in entries if e[1] == "after"]
    first = results[0][0] if results else None
    before = {c: p for _, kind, c, p in entries if kind == "before"}
    after = {c: p for _, kind, c, p in entries if kind == "after"}
    foretold = {c for seq, kind, c, _ in entries if kind == "predict" and (first is None or seq < first)}
    late = sum(1 for seq, kind, _, _ in entries if kind == "predict" and first is not None and seq > first)
    both = before.keys() & after.keys()
    count = lambda test: sum(1 for c in both if test(c in foretold, before[c], after[c]))
    return Row(
        attempt=attempt,
        status=status,
        fixed=count(lambda f, was, now: f and not was and now),
        missed=count(lambda f, was, now: f and not now),
        already=count(lambda f, was, now: f and was and now),
        collateral=count(lambda f, was, now: not f and was and not now),
        too_late=late,
        passed=sum(after.values()),
        total=len(after),
    )


class _Attempts(StatefulProcessor):
    """One attempt's entries by their number; a closed attempt keeps only that it is closed, until its time is up."""

    def __init__(self, hours: int) -> None:
        self.milliseconds = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "seq long, kind string, case_id string, passed boolean")
        self.closed = handle.getValueState("closed", "at long")

    def _held(self) -> dict[int, tuple]:
        return {row[0]: tuple(row[1:]) for row in self.entries.get()}

    def _finish(self, attempt: str, status: str, fresh: dict[int, tuple]) -> Row:
        held = self._held() | fresh
        self.entries.clear()
        return outcome(attempt, status, [(seq, *value) for seq, value in held.items()])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.closed.exists():
            return
        # A batch's new entries are written at once, and not at all for an attempt that is validated in it.
        latest, validated, fresh = 0, False, {}
        for row in rows:
            # Milliseconds, as Python's times depend on the worker's zone.
            latest = max(latest, row["milliseconds"])
            if row["kind"] == "validate":
                validated = True
            else:
                fresh[row["seq"]] = (row["kind"], row["case_id"], row["passed"])
        for timer in list(self.handle.listTimers()):
            latest = max(latest, timer - self.milliseconds)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.milliseconds)
        if validated:
            yield self._finish(key[0], "validated", fresh)
            self.closed.update((latest,))
        else:
            held = self._held()
            new = [(seq, *value) for seq, value in fresh.items() if held.get(seq) != value]
            if new:
                self.entries.appendList(new)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.closed.exists():
            self.closed.clear()
        else:
            yield self._finish(key[0], "expired", {})

    def close(self) -> None:
        pass


def ledger(entries: DataFrame, hours: int = 24, lateness: str = "1 hour") -> DataFrame:
    """``attempt, status, fixed, missed, already, collateral, too_late, passed, total`` of a stream of entries.

    ``entries(attempt, at, seq, kind, case_id, passed)``; kinds are ``predict``,
    ``before``, ``after`` and ``validate``, ``seq`` numbers an attempt's entries.  An
    attempt without a new entry for ``hours`` is given up as ``expired`` once the
    watermark has passed.  It needs the session within ``with_rocksdb``.  What comes for a validated attempt changes nothing.  A batch
    with an attempt's validation counts all of its entries in that batch.
    """
    stream = entries.withColumn("milliseconds", F.unix_millis("at")).withWatermark("at", lateness).groupBy("attempt")
    return stream.transformWithState(statefulProcessor=_Attempts(hours), outputStructType=OUTCOME, outputMode="append", timeMode="EventTime")


def run_ledger(entries: DataFrame, sink: str, checkpoint: str, hours: int = 24, lateness: str = "1 hour") -> None:
    """Outcomes of all that is there, into a Parquet folder; a later run goes on with the state of this one."""
    with with_rocksdb(entries.sparkSession):
        out = ledger(entries, hours, lateness)
        out.writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", checkpoint).option("path", sink).format("parquet").start().awaitTermination()


def outcomes_of(entries: DataFrame) -> DataFrame:
    """The outcomes of a table of entries, validated attempts only: the batch form of ``ledger``."""
    own = entries.dropDuplicates(["attempt", "seq"])
    results = own.where("kind = 'after'").groupBy("attempt").agg(F.min("seq").alias("first"))
    last = lambda kind: F.max_by("passed", F.when(F.col("kind") == kind, F.col("seq")))
    marked = own.join(results, "attempt", "left").withColumn("on_time", (F.col("kind") == "predict") & (F.col("first").isNull() | (F.col("seq") < F.col("first"))))
    cases = marked.where("kind in ('predict', 'before', 'after')").groupBy("attempt", "case_id").agg(
        F.bool_or("on_time").alias("foretold"), last("before").alias("was"), last("after").alias("now"), F.count_if((F.col("kind") == "predict") & ~F.col("on_time")).alias("late")
    )
    both = F.col("was").isNotNull() & F.col("now").isNotNull()
    sums = cases.groupBy("attempt").agg(
        F.count_if(both & F.col("foretold") & ~F.col("was") & F.col("now")).alias("fixed"),
        F.count_if(both & F.col("foretold") & ~F.col("now")).alias("missed"),
        F.count_if(both & F.col("foretold") & F.col("was") & F.col("now")).alias("already"),
        F.count_if(both & ~F.col("foretold") & F.col("was") & ~F.col("now")).alias("collateral"),
        F.sum("late").alias("too_late"),
        F.count_if("now").alias("passed"),
        F.count_if(F.col("now").isNotNull()).alias("total"),
    )
    done = own.where("kind = 'validate'").select("attempt").distinct()
    return done.join(sums, "attempt", "left").select("attempt", F.lit("validated").alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fixed", "missed", "already", "collateral", "too_late", "passed", "total")])
