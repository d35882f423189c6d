"""Working memory as a stream: repeated turns are dropped, memories expire by the stream's own time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memlake.streaming.ledger import with_rocksdb

EXPIRED = "id string, touched long, touches long"


def new_turns(turns: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """``turns(session_id, turn, role, at, ...)`` of a stream, each once: one that comes again within the lateness is dropped.

    State is kept for as long as a repeat may come, not for every turn there ever was.
    """
    return turns.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["session_id", "turn", "role"])


class _Memories(StatefulProcessor):
    """When a memory was last touched, and a timer for when it is forgotten."""

    def __init__(self, hours: int) -> None:
        self.milliseconds = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "touched long, touches long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Microseconds, as Python's times depend on the worker's zone.
        times = [row["microseconds"] for row in rows]
        held = self.last.get() if self.last.exists() else None
        touched = max([*times, held[0]] if held else times)
        self.last.update((touched, len(times) + (held[1] if held else 0)))
        # A touch puts the end off: only the newest timer stays.
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(touched // 1000 + self.milliseconds)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        touched, touches = self.last.get()
        self.last.clear()
        yield Row(id=key[0], touched=touched, touches=touches)

    def close(self) -> None:
        pass


def expirations(touches: DataFrame, hours: int = 24, lateness: str = "1 hour") -> DataFrame:
    """``id, touched, touches`` of the memories of a stream of ``touches(id, at)`` that nothing has touched for ``hours``.

    One that is touched again in time goes on, and one that comes back after its end
    is a new memory.  Time is that of the watermark: the newest touch less the lateness.
    """
    own = touches.withColumn("microseconds", F.unix_micros("at")).withWatermark("at", lateness).groupBy("id")
    out = own.transformWithState(statefulProcessor=_Memories(hours), outputStructType=EXPIRED, outputMode="append", timeMode="EventTime")
    return out.withColumn("touched", F.timestamp_micros("touched"))


def run_expirations(touches: DataFrame, sink: str, checkpoint: str, hours: int = 24, lateness: str = "1 hour") -> None:
    """Append the memories that have expired by now to a Parquet folder."""
    with with_rocksdb(touches.sparkSession):
        out = expirations(touches, hours, lateness)
        out.writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", checkpoint).option("path", sink).format("parquet").start().awaitTermination()
