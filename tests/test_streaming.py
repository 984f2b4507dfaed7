"""Stateful streams: the task machine and ingest, with restarts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quernstone.runtime import new_folder
from quernstone.streaming import ingest, machine

DAY = 86_400
BEGIN = datetime(2024, 1, 1)
SCHEMA = "task_id long, event_id long, ts timestamp, state string"


def events(spark, rows):
    return spark.createDataFrame([(t, n, BEGIN + timedelta(hours=h), s) for n, (t, h, s) in enumerate(rows)], SCHEMA)


def run(spark, source, sink, checkpoint, **options):
    machine.start(ingest.stream_of(spark, source, SCHEMA), sink, checkpoint, **options).awaitTermination()


def said(spark, sink):
    rows = spark.read.parquet(f"{sink}/batch=*").collect()
    return sorted(((r.task_id, r.ts, r.state, r.before, r.verdict) for r in rows), key=repr)


PARTS = [
    [(1, 0, "QUEUED"), (1, 1, "CHUNKING"), (1, 2, "SERIALIZING"), (2, 0, "QUEUED"), (3, 0, "FAILED"), (3, 1, "QUEUED"), (4, 1, "QUEUED"), (4, 2, "FAILED"), (4, 3, "QUEUED")],
    [(1, 60, "CHUNKING"), (1, 61, "COMPLETED"), (1, 62, "FAILED"), (3, 2.5, "SERIALIZING"), (3, 100, "SERIALIZING")],
    [(5, 300, "QUEUED")],
]


def test_steps_stuck_tasks_and_restart(spark):
    want = None
    for whole in (True, False):  # in one run, and stopped and started again between the parts
        source, sink, checkpoint = (new_folder(spark, x) for x in ("events", "machine", "state"))
        parts = [sum(PARTS, [])] if whole else PARTS
        n = 0
        for part in parts:
            events(spark, part).withColumn("event_id", F.col("event_id") + n).coalesce(1).write.mode("append").parquet(source)
            n += len(part)
            run(spark, source, sink, checkpoint, stuck_after=2 * DAY)
        got = said(spark, sink)
        if whole:
            want = got
            verdicts = [(t, s, b, v) for t, _, s, b, v in got]
            assert (1, "CHUNKING", "QUEUED", "refused") in verdicts and (1, "SERIALIZING", "QUEUED", "accepted") in verdicts
            assert (1, "SERIALIZING", "SERIALIZING", "stuck") in verdicts and (1, "COMPLETED", "CHUNKING", "accepted") in verdicts and (1, "FAILED", "COMPLETED", "refused") in verdicts
            assert (2, "QUEUED", "QUEUED", "stuck") in verdicts and (3, "FAILED", None, "refused") in verdicts
            assert (4, "QUEUED", "FAILED", "refused") in verdicts and (5, "QUEUED", None, "accepted") in verdicts
            assert sum(v[3] == "stuck" for v in verdicts) == 3  # tasks 1 and 2, and 3 by the timer after its last step
        else:
            assert got == want
    run(spark, source, sink, checkpoint, stuck_after=2 * DAY)  # nothing new, nothing repeated
    assert said(spark, sink) == want


def test_late_events_and_forgetting(spark):
    source, sink, checkpoint = (new_folder(spark, x) for x in ("events", "machine", "state"))
    for part in ([(1, 10, "QUEUED"), (1, 11, "FAILED")], [(1, 10.5, "QUEUED"), (2, 200, "QUEUED")], [(1, 210, "QUEUED"), (None, 211, "QUEUED"), (6, 212, None)]):
        events(spark, part).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, sink, checkpoint, stuck_after=30 * DAY, forget_after=DAY, late="2 hours")
    verdicts = [(t, s, b, v) for t, _, s, b, v in said(spark, sink)]
    assert (1, "QUEUED", "FAILED", "late") in verdicts
    assert verdicts.count((1, "QUEUED", None, "accepted")) == 2  # forgotten, it begins anew
    assert {v[0] for v in verdicts} == {1, 2}


def test_batches_read_no_more_catalog_as_they_go_on(spark, monkeypatch):
    source, sink = new_folder(spark, "docs"), new_folder(spark, "ingest")
    schema = "partition string, file_id string, text string"
    for i in range(6):  # files come again in later batches
        spark.createDataFrame([("p", f"f{j}", f"text {j}") for j in range(3 * i, 3 * i + 6)], schema).coalesce(1).write.mode("append").parquet(source)
    read, known = [], ingest.known_elsewhere

    def counted(*a):
        out = known(*a)
        read.append(0 if out is None else len(out.inputFiles()))
        return out

    monkeypatch.setattr(ingest, "known_elsewhere", counted)
    chunk = lambda df: df.select("partition", "file_id", F.col("text").alias("chunk"))
    for name in ("0", "1"):
        docs = ingest.stream_of(spark, source, schema, maxFilesPerTrigger=1)
        ingest.ingest_stream(docs, chunk, sink, new_folder(spark, "state"), run=name).awaitTermination()
        spark.createDataFrame([("p", "later", "x"), ("p", "f2", "again")], schema).coalesce(1).write.mode("append").parquet(source)
    assert read[:6] == [0] * 6 and len(set(read[6:])) == 1 and len(read) >= 13
    rows = spark.read.parquet(*ingest._batches(spark, f"{sink}/chunks"))
    assert sorted(r.file_id for r in rows.collect()) == sorted([f"f{j}" for j in range(21)] + ["later"])
