"""The chunk store and its catalog: partitions of files of chunks, as immutable segments of Parquet with a log of commits.

A collection is a folder. An insert writes one folder with a directory for each partition and then commits it (``commits.Log``). Deleting,
replacing or patching files rewrites nothing: it commits an overlay, a small table of the files with what happened to
them, which reads lay over the segments that are older and share a bucket of files with it (merge-on-read). ``compact`` folds overlays and small
segments in. Writers need no lock: the second of two looks at what the first touched and goes on, or fails if its files clash;
a writer that fails deletes what it wrote. Partition and file_id are never null: an insert of such rows is refused whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import dense_index, postings, search
from quernstone.operators.commits import EVERY, Change, Log, Masks, Overlay, Segment, State, bucket, mask_of, mask_words, masks_of
from quernstone.runtime import broadcast_if_small, staged

SCHEMA = "chunk_id long, partition string, file_id string, chunk_no int, text string, page int, vector array<float>, metadata map<string,string>, created_at timestamp"
OVERLAY = "partition string, file_id string, deleted boolean, metadata map<string,string>"

COLUMNS = ("chunk_id", "partition", "file_id", "chunk_no", "text", "page", "vector", "metadata", "created_at")
BROADCAST_FILES = 1_000_000  # files of overlays, or ids of results, that are broadcast; more are joined by a shuffle
SMALL = 128 << 20  # bytes below which compaction puts segments of a partition together


class NotFound(ValueError):
    pass


class AlreadyThere(ValueError):
    pass


def partitions(chunks: DataFrame) -> DataFrame:
    """partition, created_at, file_count."""
    return chunks.groupBy("partition").agg(F.min("created_at").alias("created_at"), F.count_distinct("file_id").alias("file_count"))


def files(chunks: DataFrame, partition: str | None = None) -> DataFrame:
    rows = chunks if partition is None else chunks.filter(F.col("partition") == partition)
    return rows.select("partition", "file_id").distinct()


def without_known(new: DataFrame, known: DataFrame) -> DataFrame:
    """New rows of files that aren't there yet."""
    return new.join(known.select("partition", "file_id").distinct(), ["partition", "file_id"], "left_anti")


def _no_map() -> F.Column:
    return F.expr("cast(map() as map<string,string>)")


def with_keys(metadata: F.Column, change: F.Column) -> F.Column:
    """Metadata with ``change``'s keys set; the new value wins."""
    return F.map_concat(F.map_filter(F.coalesce(metadata, _no_map()), lambda k, v: ~F.map_contains_key(change, k)), change)


def merged_metadata(chunks: DataFrame, update: dict[str, str]) -> DataFrame:
    """Metadata with ``update``'s keys set; the new value wins."""
    change = F.create_map(*[F.lit(x) for kv in update.items() for x in kv]) if update else _no_map()
    return chunks.withColumn("metadata", with_keys(F.col("metadata"), change))


def user_metadata(metadata: str = "metadata") -> F.Column:
    """Metadata without the fields that the engine sets itself."""
    return F.map_filter(metadata, lambda k, v: ~k.isin("file_id", "source"))


def sample(chunks: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n chunks (or all) in seeded hash order."""
    return chunks.orderBy(T.hash_order("chunk_id", F.lit(seed)), "chunk_id").limit(n)


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), Log(spark, root)

    # --- reading ---------------------------------------------------------------------------------------------

    def _read(self, dirs: Sequence[str], schema: str) -> DataFrame:
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{d}" for d in dirs])

    def _versions(self, pairs: Iterable[tuple[str, int]]) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(sorted(set(pairs)), "_batch string, _version long"))  # folders that the state lists

    def _changes(self, overlays: Sequence[Overlay]) -> DataFrame:
        """One row per file that overlays name: when it was last deleted, and its metadata changes in order."""
        rows = self._read([o.dir for o in overlays], OVERLAY).withColumn("_batch", F.element_at(F.split("_metadata.file_path", "/"), -2))
        rows = rows.join(self._versions((o.dir.split("/")[1], o.version) for o in overlays), "_batch")
        patch = F.when(~F.col("deleted"), F.struct("_version", "metadata"))
        return rows.groupBy("partition", "file_id").agg(F.max(F.when(F.col("deleted"), F.col("_version"))).alias("_deleted"), F.array_sort(F.collect_list(patch), lambda a, b: F.when(a["_version"] < b["_version"], -1).otherwise(1)).alias("_patches"))

    def overlaid(self, rows: DataFrame, overlays: Sequence[Overlay], *, version: str = "_version") -> DataFrame:
        """``rows`` (partition, file_id, maybe metadata, and the version that wrote them) as the overlays leave them."""
        changes = broadcast_if_small(self._changes(overlays), BROADCAST_FILES)
        out = rows.join(changes, ["partition", "file_id"], "left").filter(F.col("_deleted").isNull() | (F.col("_deleted") <= F.col(version)))
        if "metadata" in rows.columns:
            later = F.filter(F.coalesce("_patches", F.array().cast("array<struct<_version:long,metadata:map<string,string>>>")), lambda p: p["_version"] > F.col(version))
            out = out.withColumn("metadata", F.when(F.size(later) > 0, F.aggregate(later, F.coalesce("metadata", _no_map()), lambda m, p: with_keys(m, p["metadata"]))).otherwise(F.col("metadata")))
        return out.drop("_deleted", "_patches")

    def deleted(self, rows: DataFrame, overlays: Sequence[Overlay], *, version: str = "_version") -> DataFrame:
        """Those of ``rows`` (partition, file_id and the version that wrote them) whose files the overlays delete."""
        gone = self._changes(overlays).filter("_deleted is not null").select("partition", "file_id", "_deleted")
        return rows.join(broadcast_if_small(gone, BROADCAST_FILES), ["partition", "file_id"]).filter(F.col("_deleted") > F.col(version)).drop("_deleted")

    def _rows(self, state: State, segments: Sequence[Segment]) -> DataFrame:
        """The visible rows of these segments; only those that an overlay covers are joined with it."""
        over = [o for o in state.overlays if any(o.covers(s) for s in segments)]
        covered = [s for s in segments if any(o.covers(s) for o in over)]
        plain = self._read([s.dir for s in segments if s not in covered], SCHEMA)
        if not covered:
            return plain
        rows = self._read([s.dir for s in covered], SCHEMA).withColumn("_batch", F.element_at(F.split("_metadata.file_path", "/"), -3))
        rows = self.overlaid(rows.join(self._versions((s.batch, s.version) for s in covered), "_batch"), over).select(*COLUMNS)
        return rows if len(covered) == len(segments) else plain.unionByName(rows)

    def chunks(self, partitions: Iterable[str] | None = None) -> DataFrame:
        """All visible rows (of some partitions)."""
        state = self.log.state()
        return self._rows(state, state.of(partitions))

    def _masks(self, partition: str, file_id: str) -> Masks:
        one = self.spark.range(1).select(bucket(F.lit(file_id)).alias("b")).head().b
        return {partition: 1 << one}

    def _file_rows(self, state: State, partition: str, file_id: str) -> DataFrame:
        return self._rows(state, state.of([partition], self._masks(partition, file_id))).filter((F.col("partition") == partition) & (F.col("file_id") == file_id))

    # --- writing ---------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> list[Segment]:
        """Write rows below one new folder, a directory for each partition (large ones are split), sorted by file; one job and one narrow aggregate."""
        name = f"data/{uuid.uuid4().hex}"
        try:
            part = F.md5(F.col("partition").cast("binary")).alias("part")
            rows.select(*COLUMNS, part).hint("rebalance", "part").sortWithinPartitions("part", "file_id", "chunk_no").write.partitionBy("part").parquet(f"{self.root}/{name}")
            if not any(s.isDirectory() for s in self.log.fs.listStatus(self.log.path(name))):
                self.log.delete(name)
                return []
            fresh = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{name}")
            stats = fresh.groupBy("partition").agg(F.count(F.lit(1)).alias("rows"), F.min("chunk_id").alias("least"), F.max("chunk_id").alias("most"), F.count_if(F.col("file_id").isNull()).alias("nameless"), *mask_words(F.col("file_id")))
            made = []
            for r in stats.toLocalIterator():
                if r.partition is None or r.nameless:
                    raise ValueError("rows need a partition and a file_id")
                at = f"{name}/part={hashlib.md5(r.partition.encode()).hexdigest()}"
                made.append(Segment(at, r.partition, mask_of(r), r.rows, self.log.size(at), r.least, r.most))
            return made
        except BaseException:
            self.log.delete(name)
            raise

    def _clean(self, segments: Sequence[Segment], overlays: Sequence[Overlay] = ()) -> None:
        for name in {f"data/{s.batch}" for s in segments} | {o.dir for o in overlays}:
            self.log.delete(name)

    def _clash(self, made: Sequence[Segment], state: State, segments: Sequence[Segment]) -> None:
        if not segments:
            return
        fresh = files(self._read([s.dir for s in made], SCHEMA))
        there = files(self._rows(state, segments).select("partition", "file_id", "metadata"))
        clash = there.join(broadcast_if_small(fresh, BROADCAST_FILES), ["partition", "file_id"], "left_semi").limit(1).collect()
        if clash:
            raise AlreadyThere(f"file {clash[0].file_id!r} is in partition {clash[0].partition!r} already")

    def insert(self, rows: DataFrame) -> None:
        """Append chunks; if any of their files is there already, nothing is inserted.

        They are checked against the segments that share a bucket with them, and again, against those alone, if another writer
        was first with such a segment.
        """
        state = self.log.state()
        made = self._write(rows)
        if not made:
            return
        touched = {s.partition: s.mask for s in made}
        try:
            self._clash(made, state, state.of(touched, touched))

            def recheck(before: State, now: State, others: Masks) -> None:
                known = {s.dir for s in before.segments}
                self._clash(made, now, [s for s in now.of(touched, touched) if s.dir not in known])

            self.log.commit(state, Change(add=made, touched=touched), recheck)
        except BaseException:
            self._clean(made)
            raise
        self._keep_indexed()

    def _overlay(self, changes: DataFrame, masks: Masks) -> Overlay:
        """Write an overlay of (partition, file_id, deleted, metadata), a table of the files that change."""
        name = f"overlays/{uuid.uuid4().hex}"
        changes.select("partition", "file_id", "deleted", "metadata").coalesce(1).write.parquet(f"{self.root}/{name}")
        return Overlay(name, masks)

    def _mutate(self, wanted: DataFrame, deleted: bool, added: Sequence[Segment] = (), missing: str = "ignore") -> int:
        """Commit an overlay over those of ``wanted`` (partition, file_id, maybe metadata) that are there; how many those are.

        When another writer touches a common bucket meanwhile, what is there is looked up again.
        """
        wanted = staged(wanted, "wanted") if missing == "ignore" else wanted
        written: list[Overlay] = []
        counts = [0]

        def prepare(state: State) -> Change:
            masks = masks_of(wanted)
            there = files(self._rows(state, state.of(masks, masks)))
            found = staged(wanted.join(there, ["partition", "file_id"], "left_semi"), "found")
            met = found.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), *mask_words(F.col("file_id"))).collect()  # a row for each partition
            counts[0] = sum(r.n for r in met)
            if not counts[0]:
                if missing != "ignore":
                    raise NotFound(missing)
                return Change()
            data = F.col("metadata") if "metadata" in found.columns else F.lit(None).cast("map<string,string>")
            one = self._overlay(found.select("partition", "file_id", F.lit(deleted).alias("deleted"), data.alias("metadata")), {r.partition: mask_of(r) for r in met})
            written.append(one)
            touched = dict(one.masks)
            for s in added:
                touched[s.partition] = touched.get(s.partition, 0) | s.mask
            return Change(add=list(added), overlays=[one], touched=touched)

        try:
            state = self.log.state()
            change = prepare(state)
            if counts[0]:
                self.log.commit(state, change, lambda before, now, others: prepare(now))
                self._clean([], written[:-1])
        except BaseException:
            self._clean(added, written)
            raise
        return counts[0]

    def _one(self, partition: str, file_id: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(partition).alias("partition"), F.lit(file_id).alias("file_id"))

    def delete_files(self, wanted: DataFrame) -> int:
        """Delete files (partition, file_id); the number of those that were there. A partition without files goes."""
        return self._mutate(wanted.select("partition", "file_id").distinct(), True)

    def delete_file(self, partition: str, file_id: str) -> bool:
        """False if the file isn't there."""
        return self.delete_files(self._one(partition, file_id)) > 0

    def delete_partition(self, partition: str) -> bool:
        if not self.partition_exists(partition):
            return False
        state = self.log.state()
        drop = lambda now: Change(drop=[s.dir for s in now.of([partition])], touched={partition: EVERY})
        self.log.commit(state, drop(state), lambda before, now, others: drop(now))
        return True

    def replace_file(self, partition: str, file_id: str, rows: DataFrame) -> None:
        """The file's chunks go and ``rows`` come, in one commit; all of them are of that file."""
        made = self._write(rows.withColumn("partition", F.lit(partition)).withColumn("file_id", F.lit(file_id)))
        self._mutate(self._one(partition, file_id), True, made, missing=f"no file {file_id!r} in partition {partition!r}")
        self._keep_indexed()

    def patch_metadata(self, partition: str, file_id: str, update: dict[str, str]) -> None:
        """Set metadata keys of a file's chunks; vectors and ids stay, and nothing but the change is written."""
        change = F.create_map(*[F.lit(x) for kv in update.items() for x in kv]) if update else _no_map()
        self._mutate(self._one(partition, file_id).withColumn("metadata", change), False, missing=f"no file {file_id!r} in partition {partition!r}")

    def patch_files(self, wanted: DataFrame) -> int:
        """Set metadata keys of many files: (partition, file_id, metadata), one row per file; the number of those that were there."""
        return self._mutate(wanted.select("partition", "file_id", "metadata"), False)

    def compact(self, partitions: Iterable[str] | None = None, *, small: int = SMALL) -> int:
        """Fold overlays into the segments that they cover, and put small segments of a partition together; how many segments were rewritten.

        Large segments that nothing covers stay. If another writer touches a rewritten bucket meanwhile, it starts again from the new state.
        """
        while True:
            state = self.log.state()
            some = state.of(partitions)
            covered = [s for s in some if any(o.covers(s) for o in state.overlays)]
            little: dict[str, list[Segment]] = {}
            for s in some:
                if s not in covered and s.bytes < small:
                    little.setdefault(s.partition, []).append(s)
            again = {s.partition for s in covered}
            picked = covered + [s for p, ss in little.items() if len(ss) > 1 or p in again for s in ss]
            if not picked:
                return 0
            made = self._write(self._rows(state, picked))
            touched: Masks = {}
            for s in picked:
                touched[s.partition] = touched.get(s.partition, 0) | s.mask

            def refuse(before: State, now: State, others: Masks) -> None:
                raise _Changed

            try:
                self.log.commit(state, Change(add=made, drop=[s.dir for s in picked], touched=touched), refuse)
            except _Changed:
                self._clean(made)
                continue
            except BaseException:
                self._clean(made)
                raise
            self._keep_indexed()
            return len(picked)

    def vacuum(self) -> int:
        """Delete the folders that compaction and deletion left; for when nobody reads older versions and nobody writes. Their number."""
        state = self.log.state()
        used = {f"data/{s.batch}" for s in state.segments} | {o.dir for o in state.overlays} | {x["dir"] for s in state.segments for x in s.indexes.values()}
        gone = 0
        for kind in ("data", "overlays", "dense", "sparse"):
            at = self.log.path(kind)
            for f in self.log.fs.listStatus(at) if self.log.fs.exists(at) else []:
                name = f"{kind}/{f.getPath().getName()}"
                if name not in used:
                    self.log.delete(name)
                    gone += 1
        return gone

    # --- catalog ---------------------------------------------------------------------------------------------

    def file_exists(self, partition: str, file_id: str) -> bool:
        return self.file_chunks(partition, file_id).limit(1).count() > 0

    def partition_exists(self, partition: str) -> bool:
        state = self.log.state()
        some = state.of([partition])
        if any(not any(o.covers(s) for o in state.overlays) for s in some):
            return True
        return bool(some) and self._rows(state, some).limit(1).count() > 0

    def partitions(self) -> DataFrame:
        return partitions(self.chunks())

    def files(self, partition: str) -> DataFrame:
        return files(self.chunks([partition]), partition)

    def file_chunks(self, partition: str, file_id: str) -> DataFrame:
        return self._file_rows(self.log.state(), partition, file_id)

    def chunk(self, chunk_id: int) -> DataFrame:
        """The chunk of this id; only segments whose ids reach around it are opened."""
        state = self.log.state()
        return self._rows(state, [s for s in state.segments if s.least <= chunk_id <= s.most]).filter(F.col("chunk_id") == chunk_id).limit(1)

    def all_chunks(self, partition: str, *, include_embedding: bool = True) -> DataFrame:
        rows = self.chunks([partition])
        return rows.withColumn("vector", F.to_json("vector")) if include_embedding else rows.drop("vector")

    def sample_chunks(self, partition: str, n: int = 200, seed: int = 0) -> DataFrame:
        return sample(self.chunks([partition]), n, seed)

    def models(self, prefix: str) -> DataFrame:
        """One model name per partition and one for all."""
        names = self.partitions().select(F.concat(F.lit(prefix + "-"), "partition").alias("model"))
        return names.unionAll(self.spark.createDataFrame([(f"{prefix}-all",)], "model string"))

    # --- search ----------------------------------------------------------------------------------------------

    def build_dense_index(self, **options) -> None:
        """Train centroids and codes on a bounded sample of the vectors and index every segment; later inserts are indexed as they come."""
        state = self.log.state()
        model = dense_index.train(self._rows(state, state.segments), **options)
        if model is None:
            return
        name = f"models/{uuid.uuid4().hex}"
        dense_index.save_model(self.spark, model, f"{self.root}/{name}")
        self.log.commit(state, Change(models={"dense": {"dir": name}}), lambda *_: None)
        self._index("dense", again=True)

    def build_sparse_index(self) -> None:
        """Write the postings of every segment; later inserts get theirs as they come."""
        self.log.commit(self.log.state(), Change(models={"sparse": {}}), lambda *_: None)
        self._index("sparse")

    def _keep_indexed(self) -> None:
        for kind in self.log.state().models:
            self._index(kind)

    def _index(self, kind: str, again: bool = False) -> None:
        """Index the inserts that have no such index yet, each in a folder of its own."""
        state = self.log.state()
        open_ = {s.batch for s in state.segments if again or kind not in s.indexes}
        for batch in sorted(open_):
            rows = self._read([s.dir for s in state.segments if s.batch == batch], SCHEMA)
            name = f"{kind}/{uuid.uuid4().hex}"
            if kind == "dense":
                what = dense_index.write(rows, dense_index.load_model(self.spark, f"{self.root}/{state.models['dense']['dir']}"), f"{self.root}/{name}")
            else:
                what = postings.write(rows, f"{self.root}/{name}")
            self.log.commit(self.log.state(), Change(indexes=[(batch, kind, what | {"dir": name})]), lambda *_: None)

    def _split(self, kind: str, state: State, segments: Sequence[Segment]) -> tuple[list[tuple[dict, list[Segment]]], list[Segment]]:
        """(indexes with the segments that they serve, segments without one)."""
        by: dict[str, tuple[dict, list[Segment]]] = {}
        for s in segments:
            if kind in s.indexes:
                by.setdefault(s.batch, (s.indexes[kind], []))[1].append(s)
        return list(by.values()), [s for s in segments if kind not in s.indexes]

    def ann_topk(self, queries: DataFrame, k: int = 5, *, partitions: Iterable[str] | None = None, threshold: float | None = None, probes: int | None = None, shortlist: int = 20) -> DataFrame:
        """Approximate cosine top-k by the stored index (query_id, chunk_id, score, rank); segments without one are scanned.

        ``probes`` cells are searched (default: as many as the recall that the index was built for needs), and ``shortlist`` times k rows re-ranked.
        """
        state = self.log.state()
        segments = state.of(partitions)
        indexed, rest = self._split("dense", state, segments)
        found = []
        if indexed:
            model = dense_index.load_model(self.spark, f"{self.root}/{state.models['dense']['dir']}")
            found.append(dense_index.search(queries, self._index_rows(state, indexed, dense_index.SCHEMA), model, k, probes=probes, shortlist=shortlist, threshold=threshold))
        if rest or not indexed:
            found.append(search.dense_topk(queries, self._rows(state, rest), k, threshold=threshold).drop("rank"))
        return search.top(found[0] if len(found) == 1 else found[0].unionByName(found[1]), k)

    def _index_rows(self, state: State, indexed: Sequence[tuple[dict, list[Segment]]], schema: str) -> DataFrame:
        """The visible rows of an index's folders, of the partitions that are wanted."""
        segments = [s for _, ss in indexed for s in ss]
        over = [o for o in state.overlays if any(o.covers(s) for s in segments)]
        rows = None
        for what, ss in indexed:  # a folder for each insert, so its rows are all of one version
            part = self.spark.read.schema(schema).parquet(f"{self.root}/{what['dir']}")
            if len(ss) < what["partitions"]:  # some aren't wanted, or were dropped since
                part = part.filter(F.col("partition").isin(sorted(s.partition for s in ss)))
            mine = [o for o in over if any(o.covers(s) for s in ss)]
            part = part.withColumn("_version", F.lit(ss[0].version).cast("long"))
            part = (self.overlaid(part, mine) if mine else part).drop("_version")
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def keyword_topk(self, queries: DataFrame, k: int = 5, *, partitions: Iterable[str] | None = None) -> DataFrame:
        """BM25 top-k by the stored postings (query_id, chunk_id, score, rank), the same rows as a scan gives; inserts without postings get them first."""
        state = self.log.state()
        if "sparse" not in state.models:
            return search.bm25_topk(queries, self._rows(state, state.of(partitions)), k)
        if any("sparse" not in s.indexes for s in state.of(partitions)):
            self._index("sparse")
            state = self.log.state()
        parts = []
        for what, ss in self._split("sparse", state, state.of(partitions))[0]:
            over = [o for o in state.overlays if any(o.covers(s) for s in ss)]
            parts.append(postings.Part(f"{self.root}/{what['dir']}", what, sorted({s.partition for s in ss}), ss[0].version, over))
        return postings.search(self, queries, parts, k)

    def search(self, queries: DataFrame, *, partitions: str | Sequence[str] | None = ("all",), filters: dict | None = None, top_k: int = 5, threshold: float | None = 0.8, hybrid: bool = True, **options) -> DataFrame:
        """``search.search`` of queries (query_id, text, vector) over the store; only the wanted partitions' segments are read.

        Where the store has indexes (and no column filters are asked for) they take the place of scans; ``options`` are ``ann_topk``'s
        probes and shortlist.
        """
        wanted = search.partitions_of(partitions)
        names = None if wanted == search.ALL else wanted
        state = self.log.state()
        if filters or not state.models:
            return search.search(queries, self._rows(state, state.of(names)), partitions=partitions, filters=filters, top_k=top_k, threshold=threshold, hybrid=hybrid)
        near = self.ann_topk(queries, top_k, partitions=names, threshold=threshold, **options) if "dense" in state.models else search.dense_topk(queries, self._rows(state, state.of(names)), top_k, threshold=threshold)
        found = search.rrf([near, self.keyword_topk(queries, top_k, partitions=names)], top_k) if hybrid else near
        return search.with_chunks(found, self._rows(state, state.of(names)))


class _Changed(Exception):
    pass
