"""Session helpers: the shared folder, staged tables, bounded broadcasts and fixture paths."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()

#: Rows that Arrow puts in one batch for a Python worker; keeps a batch of long texts small.
ARROW_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture table ``name``; ``sf_dir`` may be any path or URI that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset on one machine (tests) a temporary folder takes its place.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    return _LOCAL_ROOTS[app]


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{spark.sparkContext.applicationId}-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else unchanged (a shuffle join follows)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Make the session ready for Python workers: this package on their path, and at most ``rows`` rows in an Arrow
    batch, so that long texts fit a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the workers, once per application; Spark serves it from the driver."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="quernstone-src-"))
    with zipfile.ZipFile(folder / "quernstone_src.zip", "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(folder / "quernstone_src.zip"))
    _SHIPPED.add(app)
