"""Task states from an append-only event log: task_events(task_id, ts, state, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The states of a task that hasn't ended, in order.
ACTIVE = ("QUEUED", "SERIALIZING", "CHUNKING", "INSERTING")
DONE, FAILED = "COMPLETED", "FAILED"


def latest(events: DataFrame, *, tie: str = "event_id") -> DataFrame:
    """The newest event of each task: task_id, state, ts."""
    return events.groupBy("task_id").agg(F.max_by(F.struct("state", "ts"), F.struct("ts", tie)).alias("x")).select("task_id", "x.state", "x.ts")


#: The states that may follow each state; a task can fail from any open one.
NEXT = {None: ("QUEUED",), "QUEUED": ("SERIALIZING", FAILED), "SERIALIZING": ("CHUNKING", FAILED), "CHUNKING": ("INSERTING", DONE, FAILED), "INSERTING": (DONE, FAILED), DONE: (), FAILED: ()}


def transitions(events: DataFrame, *, tie: str = "event_id") -> DataFrame:
    """Events with the state before (null for a task's first) and whether the step is allowed."""
    order = Window.partitionBy("task_id").orderBy("ts", tie)
    rows = events.withColumn("before", F.lag("state").over(order))
    allowed = F.lit(False)
    for state, follow in NEXT.items():
        here = F.col("before").isNull() if state is None else F.col("before").eqNullSafe(F.lit(state))
        allowed = F.when(here, F.col("state").isin(*follow) if follow else F.lit(False)).otherwise(allowed)
    return rows.withColumn("allowed", allowed)


def last_entries(log: DataFrame, n: int, *, by: str = "task_id", order: tuple[str, ...] = ("timestamp", "message")) -> DataFrame:
    """The newest ``n`` log entries of each task."""
    newest = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= n).drop("age")


def errors(states: DataFrame, log: DataFrame) -> DataFrame:
    """Failed tasks with their newest error message: task_id, error."""
    said = log.filter(F.col("level") == "ERROR").groupBy("task_id").agg(F.max_by("message", F.struct("timestamp", "message")).alias("error"))
    return states.filter(F.col("state") == FAILED).select("task_id").join(said, "task_id", "left")


def by_status(states: DataFrame, status: str | None) -> DataFrame:
    """``active`` is the four open states, other names match without case, None is all."""
    if status is None:
        return states
    if status.lower() == "active":
        return states.filter(F.col("state").isin(*ACTIVE))
    return states.filter(F.lower("state") == status.lower())


def queue_info(states: DataFrame) -> DataFrame:
    """One row: active, completed, failed, total."""
    return states.agg(
        F.count_if(F.col("state").isin(*ACTIVE)).alias("active"), F.count_if(F.col("state") == DONE).alias("completed"),
        F.count_if(F.col("state") == FAILED).alias("failed"), F.count(F.lit(1)).alias("total"),
    )


def counts(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def pool_usage(pools: DataFrame) -> DataFrame:
    """Worker slots: pools (pool_size, slots_each, busy) -> total, busy, free."""
    total = F.col("pool_size") * F.col("slots_each")
    return pools.select(total.alias("total"), F.col("busy"), (total - F.col("busy")).alias("free"))
