"""Structured Streaming: files arrive, are chunked and appended once; task counts stay live."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.runtime import new_folder, staged

FILES = "partition string, file_id string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, on disk; the session's setting is put back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _batches(spark: SparkSession, folder: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/run=*/batch=*")
    return [s.getPath().toString() for s in (path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or [])]


def known_elsewhere(spark: SparkSession, sink: str, run: str) -> DataFrame | None:
    """The files that other runs accepted."""
    others = [b for b in _batches(spark, f"{sink}/files") if f"/run={run}/" not in b]
    return spark.read.schema(FILES).parquet(*others) if others else None


def ingest_stream(docs: DataFrame, chunk: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, *, run: str = "0") -> StreamingQuery:
    """Chunk new files into ``sink``/chunks; a (partition, file_id) that came before, in any batch or run, is refused.

    What came earlier in this run is known to the stream's state store, one key a file, looked up for the batch's own keys: no batch reads what
    the batches before it wrote. The files of other runs (streams with checkpoints of their own) are a narrow catalog, ``sink``/files,
    whose size doesn't grow with this run; a batch is compared with names and never with chunks. Each batch writes below its own number and
    overwrites it when it is run again, so a restart repeats nothing; the catalog, with files that gave no chunks too, is written last.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"run={run}/batch={number}"
        earlier = known_elsewhere(spark, sink, run)
        fresh = staged(batch if earlier is None else batch.join(earlier, ["partition", "file_id"], "left_anti"), "fresh")
        chunk(fresh).write.mode("overwrite").parquet(f"{sink}/chunks/{own}")
        fresh.select("partition", F.col("file_id").cast("string").alias("file_id")).write.mode("overwrite").parquet(f"{sink}/files/{own}")

    with rocksdb(docs.sparkSession):
        return docs.dropDuplicates(["partition", "file_id"]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_of(spark: SparkSession, source: str, schema, **options) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file (streams watch folders)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.schema(schema).options(**options)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(source)
    return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())


def ingest_once(spark: SparkSession, source: str, schema, chunk: Callable[[DataFrame], DataFrame], prepare: Callable[[DataFrame], DataFrame], *, runs: int = 1) -> tuple[DataFrame, DataFrame]:
    """Run the stream over what ``source`` holds now, ``runs`` times from the start; the sink's chunks and its catalog of files."""
    sink = new_folder(spark, "ingest")
    for run in range(runs):
        stream = prepare(stream_of(spark, source, schema, maxFilesPerTrigger=4))
        ingest_stream(stream, chunk, sink, new_folder(spark, "ingest-state"), run=str(run)).awaitTermination()
    return spark.read.parquet(*_batches(spark, f"{sink}/chunks")), spark.read.schema(FILES).parquet(*_batches(spark, f"{sink}/files"))


def live_counts(events: DataFrame, *, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per state and window of event time, with late rows accepted for a while."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "state").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "state", "n")


def counts_once(spark: SparkSession, source: str, schema, prepare: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """The windowed counts of what ``source`` holds now, by a streaming query: each batch's changed windows, newest last."""
    sink, checkpoint = new_folder(spark, "counts"), new_folder(spark, "counts-state")
    counted = live_counts(prepare(stream_of(spark, source, schema)), **options)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/b{number}")

    counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{sink}/b*")
    return rows.groupBy("start", "state").agg(F.max_by("n", "batch").alias("n"))
