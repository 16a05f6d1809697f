"""Progress of tasks as a stream: one state for each task, kept by the state store, with timers that let finished ones expire.

Needs the RocksDB state store, which ``prepared`` sets in a session that names no other.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from granary import runtime
from granary.sources.stored import StoredLedger

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What events have, and what is emitted for a task at each change.
EVENT = "task_id string, ts timestamp, progress int, msg string, status string"
STATE = "task_id string, ts timestamp, progress int, msg string, status string, updates long, expired boolean"
FINISHED = ("done", "failed")


class Progress(StatefulProcessor):
    """The latest event of a task by its time; a finished task expires ``keep`` seconds after it, any other after ``idle`` seconds of silence (0: never).

    Of events with the same time the one that comes later wins, within a batch that with the greater progress. Events older than the watermark do not get here. A timer that is
    overtaken by a newer event does nothing, so a task has one row, however long it was silent.
    """

    def __init__(self, keep: int = 30, idle: int = 0):
        self.keep, self.idle = keep, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", "at long, progress int, msg string, status string, updates long")

    def _due(self, at: int, status: str) -> int | None:
        """When a task leaves, in milliseconds; ``at`` is in microseconds."""
        wait = self.keep if status in FINISHED else self.idle
        return at // 1000 + wait * 1000 if wait or status in FINISHED else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = tuple(self.state.get()) if self.state.exists() else None
        best, n = held, held[4] if held else 0
        for r in sorted(rows, key=lambda r: (r["at"], r["progress"] or 0)):
            n += 1
            if best is None or r["at"] >= best[0]:
                best = (r["at"], r["progress"], r["msg"], r["status"])
        best = (*best[:4], n)
        if held is None or best[:4] != held[:4]:
            old, new = self._due(held[0], held[3]) if held else None, self._due(best[0], best[3])
            if old is not None and old != new:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        self.state.update(best)
        yield Row(task_id=key[0], at=best[0], progress=best[1], msg=best[2], status=best[3], updates=n, expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = tuple(self.state.get()) if self.state.exists() else None
        if held and self._due(held[0], held[3]) == expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield Row(task_id=key[0], at=held[0], progress=held[1], msg=held[2], status=held[3], updates=held[4], expired=True)

    def close(self) -> None:
        pass


def prepared(spark: SparkSession) -> SparkSession:
    """The session with a state store that holds timers and several states of a key."""
    if not spark.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)
    return runtime.ship(spark)


def tracked(events: DataFrame, keep: int = 30, idle: int = 0, late: str = "30 seconds") -> DataFrame:
    """Changes of tasks, from a stream of events: the state after each batch that names the task, and once more, ``expired``, when it leaves."""
    prepared(events.sparkSession)
    rows = events.selectExpr("cast(task_id as string) as task_id", "ts", "unix_micros(ts) as at", "progress", "msg", "status").withWatermark("ts", late)
    changes = rows.groupBy("task_id").transformWithState(Progress(keep, idle), STATE.replace("ts timestamp", "at long"), "Update", "EventTime")
    return changes.selectExpr("task_id", "timestamp_micros(at) as ts", "progress", "msg", "status", "updates", "expired")


def table(spark: SparkSession, path: str, buckets: int = 64) -> StoredLedger:
    """Where a reader sees the tasks: one row each."""
    return StoredLedger(spark, path, spark.createDataFrame([], STATE.removesuffix(", expired boolean")).schema, ["task_id"], buckets)


def follow(events: DataFrame, progress: StoredLedger, checkpoint: str, keep: int = 30, idle: int = 0, late: str = "30 seconds", **trigger) -> StreamingQuery:
    """Keep a stored table of tasks up to date: changes are upserted, expired tasks go. A batch that is run again after a failure gives the same table."""

    def write(batch: DataFrame, number: int) -> None:
        batch = runtime.materialize(batch, "progress")
        # A task may expire and come back in one batch: what was emitted for its latest time counts, and of that the state before the end.
        latest = batch.groupBy("task_id").agg(_last(batch.columns).alias("r")).select("r.*")
        progress.upsert(latest.where("not expired").drop("expired"))
        progress.delete(latest.where("expired").select("task_id"))
        runtime.forget(batch)

    return tracked(events, keep, idle, late).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _last(columns: list[str]):
    from pyspark.sql import functions as F

    return F.max_by(F.struct(*columns), F.struct("ts", "expired"))
