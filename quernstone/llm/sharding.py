"""Size-tiered compaction of immutable shards under a versioned manifest; DataFrame functions only.

Arrivals are written once as small shards and never changed. Shards of similar size (the same power of ``fanout``)
form a tier; a tier with at least ``fanout`` of them that fill at most half of ``target_bytes`` is merged into files of about that size.
Merging needs no shuffle: the shards are scanned with splits of the target size, splits are put together until there are as few as
the bytes fill, and each task writes one file. Any two shards fit one file, so every merge leaves fewer and compaction ends. A version lists the live shards; it becomes visible by one rename that fails if the version
exists, so of two writers one wins and readers always see a whole version. Old files stay until ``vacuum``.

Every version carries the schema of all its columns, by which it is read, so no footer is opened to find it. An arrival's new columns join it; a
column whose number type differs takes the wider one; any other change of a type is refused before anything is written.

Defined cases: an empty table appends no shard but commits a version with its schema; null values, repeated rows and extra columns
are kept as they are, also columns that only some arrivals have (null in the others) and a column named like the shard's; a name that differs from
a known column's in case alone is that column; texts of any length are rows like others; nothing is dropped, and no text is looked at.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.columns import free_name
from quernstone.runtime import staged

ENTRY = "shard string, bytes long, rows long, generation int, run_files int"
WIDER = {("int", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("float", "double")}


class SchemaConflict(ValueError):
    pass


def widened(known: T.StructType, new: T.StructType) -> T.StructType:
    """The schema that holds both: ``known``'s columns first, with the wider type of each; raises where two types have no common one."""
    fields = {f.name.lower(): f for f in known.fields}
    for f in new.fields:
        had = fields.get(f.name.lower())
        if had is None:
            fields[f.name.lower()] = T.StructField(f.name, f.dataType, True)
        elif had.dataType != f.dataType:
            a, b = had.dataType.simpleString(), f.dataType.simpleString()
            if (a, b) in WIDER:
                fields[f.name.lower()] = T.StructField(had.name, f.dataType, True)
            elif (b, a) not in WIDER:
                raise SchemaConflict(f"column {had.name!r} is {a} in the store and {b} in the arrival")
    return T.StructType(list(fields.values()))


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 64 << 20, fanout: int = 4, base_bytes: int = 1 << 20):
        if fanout < 2:
            raise ValueError("fanout is 2 or more")
        self.spark, self.root, self.target_bytes, self.fanout, self.base_bytes = spark, root.rstrip("/"), target_bytes, fanout, base_bytes
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def version(self) -> int:
        """The newest committed version, 0 if none."""
        at = self._path("versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()), default=0)

    def _no_entries(self) -> DataFrame:
        return self.spark.range(0).selectExpr("cast(null as string) as shard", "id as bytes", "id as rows", "cast(id as int) as generation", "cast(id as int) as run_files")

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version: shard, bytes, rows, generation, and how many files their run wrote."""
        version = self.version() if version is None else version
        if not version:
            return self._no_entries()
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/versions/v{version:012d}").coalesce(1)  # one file, so nothing that follows needs a shuffle

    def schema(self, version: int | None = None) -> T.StructType:
        """The columns of a version; none before the first."""
        version = self.version() if version is None else version
        if not version:
            return T.StructType()
        stream = self._fs.open(self._path(f"versions/v{version:012d}/_schema.json"))
        try:
            return T.StructType.fromJson(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, entries: DataFrame, after: int, schema: T.StructType) -> int:
        """Write the whole manifest and the schema aside and rename them to version ``after`` + 1; raises if another writer was first."""
        aside = f"versions/.new-{uuid.uuid4().hex}"
        entries.coalesce(1).write.parquet(f"{self.root}/{aside}")
        out = self._fs.create(self._path(f"{aside}/_schema.json"), False)
        out.write(bytearray(schema.json().encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(self._path(aside), self._path(f"versions/v{after + 1:012d}"), options)
        except Exception as e:
            self._fs.delete(self._path(aside), True)
            raise RuntimeError(f"version {after + 1} is there already; read it and try again") from e
        return after + 1

    def _packing(self) -> SparkSession:
        """A session of its own, whose scans pack files up to the target size into one split."""
        session = self.spark.newSession()
        for k, v in {"spark.sql.files.maxPartitionBytes": str(self.target_bytes), "spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "0"}.items():
            session.conf.set(k, v)
        return session

    def _written(self, run: str, generation: int) -> DataFrame:
        """Manifest rows for the files of one run, from their footers."""
        made = sum(s.getPath().getName().endswith(".parquet") for s in self._fs.listStatus(self._path(run)))
        if not made:
            return self._no_entries()
        meta = self.spark.read.parquet(f"{self.root}/{run}").select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes"))
        rows = meta.groupBy("name", "bytes").agg(F.count(F.lit(1)).alias("rows"))
        return staged(rows.select(F.concat(F.lit(run + "/"), "name").alias("shard"), "bytes", "rows", F.lit(generation).alias("generation"), F.lit(made).alias("run_files")).coalesce(1), "shard-entries")

    def _rows_of(self, entries: DataFrame, spark: SparkSession, schema: T.StructType) -> DataFrame | None:
        """The rows of shards under the version's schema; None if there are none.

        A run that is live as a whole is read by its folder, so the driver holds a name for each run and for the shards of
        runs that were merged in part only, less than Spark's own list of the files that it scans.
        """
        runs = entries.withColumn("run", F.regexp_extract("shard", "^(.*)/", 1))
        whole = F.col("live") == F.col("run_files")
        counted = runs.groupBy("run").agg(F.count(F.lit(1)).alias("live"), F.max("run_files").alias("run_files"))
        found = sorted(counted.select("run", whole.alias("whole")).collect())  # a row for each run
        paths, partly = [r.run for r in found if r.whole], [r.run for r in found if not r.whole]
        if partly:
            paths += sorted(r.shard for r in runs.filter(F.col("run").isin(partly)).select("shard").toLocalIterator())
        return spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else None

    def append(self, df: DataFrame, *, rows_per_shard: int = 50_000) -> int:
        """Write arrivals as small immutable shards and commit a version that lists them too; a column of another type is refused."""
        after, run = self.version(), f"runs/{uuid.uuid4().hex}"
        schema = widened(self.schema(after), df.schema)
        names = {f.name.lower(): f.name for f in schema.fields}
        df = df.toDF(*[names[c.lower()] for c in df.columns])
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_shard).parquet(f"{self.root}/{run}")
        return self._commit(self.manifest(after).unionByName(self._written(run, 0)), after, schema)

    def tiers(self, version: int | None = None) -> DataFrame:
        """The live shards with their tier: 0 below base_bytes, one more for each further power of fanout."""
        size = F.greatest(F.col("bytes") / F.lit(float(self.base_bytes)), F.lit(1.0))
        return self.manifest(version).withColumn("tier", F.floor(F.log(float(self.fanout), size)).cast("int"))

    def compact(self) -> int:
        """Merge each tier with enough shards of up to half the target size; commits one version, or none if nothing is due."""
        after = self.version()
        shards = self.tiers(after)
        small = shards.filter(2 * F.col("bytes") <= self.target_bytes)
        due = small.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.max("generation").alias("generation")).filter(F.col("n") >= self.fanout)
        due = sorted(due.collect())  # few tiers: a logarithm of the size
        if not due:
            return after
        kept = shards.filter((2 * F.col("bytes") > self.target_bytes) | ~F.col("tier").isin([r.tier for r in due])).drop("tier")
        session, schema = self._packing(), self.schema(after)
        for tier in due:
            run = f"runs/{uuid.uuid4().hex}"
            files = -(-tier.bytes // self.target_bytes)  # at most half as many as there were, rounded up
            self._rows_of(small.filter(F.col("tier") == tier.tier), session, schema).coalesce(files).write.option("compression", "zstd").parquet(f"{self.root}/{run}")
            made = self._written(run, tier.generation + 1)
            if made.agg(F.sum("rows")).head()[0] != tier.rows:
                raise RuntimeError(f"{run} doesn't hold the rows of the shards merged into it")
            kept = kept.unionByName(made)
        return self._commit(kept, after, schema)

    def compact_all(self) -> int:
        """Compact until no tier is due."""
        while True:
            before = self.version()
            if self.compact() == before:
                return before

    def read(self, version: int | None = None, *, with_shard: bool = False) -> DataFrame:
        """The rows of a version; ``with_shard`` adds the name of each row's shard as ``shard`` (with underscores after it where that is taken)."""
        version = self.version() if version is None else version
        schema = self.schema(version)
        df = self._rows_of(self.manifest(version), self.spark, schema)
        if df is None:  # only empty arrivals so far
            df = self.spark.createDataFrame([], schema)
            return df.withColumn(free_name(df, "shard"), F.lit(None).cast("string")) if with_shard else df
        return df.withColumn(free_name(df, "shard"), F.col("_metadata.file_name")) if with_shard else df

    def vacuum(self, keep: int) -> int:
        """Delete the shard files that no version from ``keep`` on lists, and older versions; the count of deleted files."""
        live = {r.shard for v in range(keep, self.version() + 1) for r in self.manifest(v).select("shard").toLocalIterator()}
        n = 0
        for run in self._fs.listStatus(self._path("runs")):
            for f in self._fs.listStatus(run.getPath()):
                name = f"runs/{run.getPath().getName()}/{f.getPath().getName()}"
                if name.endswith(".parquet") and name not in live:
                    n += bool(self._fs.delete(f.getPath(), False))
        for v in range(1, keep):
            self._fs.delete(self._path(f"versions/v{v:012d}"), True)
        return n
