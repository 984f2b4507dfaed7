"""Task states kept live: a state machine for every task in a stream of its events.

Each task's state lives in the stream's state store (RocksDB, restored from the checkpoint after a restart). A step that its state allows is
accepted and moves it; any other is refused and leaves it. A task that stays in an open state for longer than ``stuck_after`` is marked once,
by the next event if that comes first, else by a timer when the watermark has passed; ended tasks are forgotten ``forget_after`` later.

Defined cases: a task's first step must be QUEUED; events of one task are taken in the order of (ts, event_id) within a micro-batch; an event
older than the task's last accepted one is late and refused; events behind the watermark are dropped by the stream; events without a
task, a time or a state are refused in no task's name: they are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quernstone.operators.tasks import ACTIVE, NEXT
from quernstone.runtime import new_folder, ship_package
from quernstone.streaming.ingest import rocksdb, stream_of

OUT = "task_id long, event_id long, us long, state string, before string, verdict string"


class TaskMachine(StatefulProcessor):
    """One task: its state, since when (microseconds), and whether it was marked as stuck there."""

    def __init__(self, stuck_after: int, forget_after: int | None):
        self.stuck_after, self.forget_after = stuck_after, forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, since long, marked boolean")

    def _stuck(self, task: int, state: str, since: int) -> tuple:
        return task, None, since + self.stuck_after, state, state, "stuck"

    def _due(self, state: str, since: int, marked: bool) -> int | None:
        """When a timer is wanted, in milliseconds."""
        wait = None if state in ACTIVE and marked else self.stuck_after if state in ACTIVE else self.forget_after
        return None if wait is None else -(-(since + wait) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        task, out = int(key[0]), []
        state, since, marked = self.now.get() if self.now.exists() else (None, None, False)
        events = pd.concat(list(rows)).sort_values(["us", "event_id"])
        for event, us, step in zip(events["event_id"], events["us"], events["state"]):
            us = int(us)
            if state in ACTIVE and not marked and us - since > self.stuck_after:
                out.append(self._stuck(task, state, since))
                marked = True
            late = since is not None and us < since
            accepted = not late and step in NEXT[state]
            out.append((task, int(event), us, step, state, "accepted" if accepted else "late" if late else "refused"))
            if accepted:
                state, since, marked = step, us, False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is not None:
            self.now.update((state, since, marked))
            due = self._due(state, since, marked)
            if due is not None:
                self.handle.registerTimer(due)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.now.exists():
            state, since, marked = self.now.get()
            if state in ACTIVE and not marked:
                out.append(self._stuck(int(key[0]), state, since))
                self.now.update((state, since, True))
            elif state not in ACTIVE:
                self.now.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["task_id", "event_id", "us", "state", "before", "verdict"])
        return out.astype({"task_id": "int64", "event_id": "Int64", "us": "int64", "state": object, "before": object, "verdict": object})


def machine(events: DataFrame, *, stuck_after: int, forget_after: int | None = None, late: str = "1 hour") -> DataFrame:
    """task_id, event_id, ts, state, before, verdict ("accepted", "refused", "late"; "stuck" with no event) of a stream of events (task_id, event_id, ts, state).

    ``stuck_after`` and ``forget_after`` are seconds of event time; ``late`` is how long the watermark waits.
    """
    known = events.filter("task_id is not null and ts is not null and state is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    timed = known.withWatermark("ts", late).select(F.col("task_id").cast("long").alias("task_id"), F.col("event_id").cast("long").alias("event_id"), "ts", F.unix_micros("ts").alias("us"), "state")
    processor = TaskMachine(stuck_after * 1_000_000, None if forget_after is None else forget_after * 1_000_000)
    out = timed.groupBy("task_id").transformWithStateInPandas(processor, outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    return out.select("task_id", "event_id", F.timestamp_micros("us").alias("ts"), "state", "before", "verdict")


def start(events: DataFrame, sink: str, checkpoint: str, **options) -> StreamingQuery:
    """Run the machine over what a stream holds now; each micro-batch writes a folder of its own and overwrites it when it is run again."""
    ship_package(events.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    with rocksdb(events.sparkSession):
        return machine(events, **options).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def machine_once(spark: SparkSession, source: str, schema, prepare: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """What the machine says about all events that ``source`` holds."""
    sink = new_folder(spark, "machine")
    start(prepare(stream_of(spark, source, schema)), sink, new_folder(spark, "machine-state"), **options).awaitTermination()
    return spark.read.parquet(f"{sink}/batch=*")
