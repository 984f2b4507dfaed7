"""The chunk store: merge-on-read, writers that meet, compaction, and its stored indexes against scans."""

import json
import threading
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import catalog, commits, dense_index, postings, retrieval, search
from quernstone.runtime import new_folder, staged

DATA = "/root/testdata/sf0.01"


def one(df):
    return [tuple(r) for r in df.collect()]


def rows_of(spark, files, start=0, vector=None):
    """Two chunks for each (partition, file_id, word)."""
    rows, n = [], start
    for partition, file_id, word in files:
        for no in range(2):
            rows.append((n, partition, file_id, no, f"{word} text {no}", 1, vector, {"file_id": file_id or "", "lang": "en"}))
            n += 1
    df = spark.createDataFrame(rows, "chunk_id long, partition string, file_id string, chunk_no int, text string, page int, vector array<float>, metadata map<string,string>")
    return df.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))


@pytest.fixture
def store(spark):
    s = catalog.ChunkStore(spark, new_folder(spark, "store-test"))
    s.insert(rows_of(spark, [("p", f"f{i}", "alpha") for i in range(20)] + [("q", "g", "beta")]))
    return s


def names(store):
    return sorted(one(store.chunks().select("partition", "file_id").distinct()))


def data_bytes(store, kind="data"):
    at = store.log.path(kind)
    return store.log.fs.getContentSummary(at).getLength() if store.log.fs.exists(at) else 0


def folders(store, kind):
    at = store.log.path(kind)
    return sorted(f.getPath().getName() for f in store.log.fs.listStatus(at)) if store.log.fs.exists(at) else []


def test_delete_patch_and_replace_write_no_data_of_others(spark, store):
    before = data_bytes(store)
    assert store.delete_file("p", "f3") and not store.delete_file("p", "f3") and not store.delete_file("p", "none")
    store.patch_metadata("p", "f4", {"lang": "fr", "title": "T"})
    store.patch_metadata("p", "f4", {"lang": "de"})
    assert data_bytes(store) == before  # nothing is rewritten
    assert [r.metadata for r in store.file_chunks("p", "f4").collect()] == [{"file_id": "f4", "lang": "de", "title": "T"}] * 2
    store.replace_file("p", "f5", rows_of(spark, [("p", "f5", "new")], start=1000))
    grown = data_bytes(store) - before
    assert 0 < grown < before
    assert sorted(r.text for r in store.file_chunks("p", "f5").collect()) == ["new text 0", "new text 1"]
    store.patch_metadata("p", "f5", {"lang": "it"})
    assert {r.metadata["lang"] for r in store.file_chunks("p", "f5").collect()} == {"it"}
    assert len(names(store)) == 20 and ("p", "f3") not in names(store)
    # a deleted file may come again, and a change from before isn't applied to it
    store.delete_file("p", "f4")
    store.insert(rows_of(spark, [("p", "f4", "again")], start=2000))
    assert [r.metadata for r in store.file_chunks("p", "f4").collect()] == [{"file_id": "f4", "lang": "en"}] * 2
    for call in (lambda: store.patch_metadata("p", "none", {}), lambda: store.replace_file("p", "none", rows_of(spark, [("p", "none", "x")]))):
        with pytest.raises(catalog.NotFound):
            call()
    with pytest.raises(catalog.AlreadyThere):
        store.insert(rows_of(spark, [("p", "f1", "x"), ("r", "new", "x")], start=3000))
    assert not store.partition_exists("r")


def test_bulk_changes(spark, store):
    some = store.files("p").filter(F.col("file_id").isin("f1", "f2", "f7")).unionByName(spark.createDataFrame([("p", "absent")], "partition string, file_id string"))
    assert store.patch_files(some.withColumn("metadata", F.create_map(F.lit("tag"), F.lit("x")))) == 3
    assert store.chunks().filter("metadata['tag'] = 'x'").count() == 6
    assert store.delete_files(some) == 3 and store.delete_files(some) == 0
    assert len(names(store)) == 18


def test_a_partition_without_files_goes(spark, store):
    assert store.partition_exists("q") and store.delete_file("q", "g") and not store.partition_exists("q")
    assert [r.partition for r in store.partitions().collect()] == ["p"]
    assert store.delete_partition("p") and not store.delete_partition("p")
    assert store.chunks().count() == 0


def test_compaction_folds_overlays_and_small_segments(spark, store):
    for i in range(3):
        store.insert(rows_of(spark, [("p", f"h{i}", "gamma")], start=500 + 10 * i))
    store.delete_file("p", "f3")
    store.patch_metadata("p", "f4", {"lang": "xx"})
    before = sorted(one(store.chunks().select("chunk_id", "partition", "file_id", "text", F.to_json("metadata"))))
    assert store.compact() == 4
    state = store.log.state()
    assert not state.overlays and sorted(s.partition for s in state.segments) == ["p", "q"]
    assert sorted(one(store.chunks().select("chunk_id", "partition", "file_id", "text", F.to_json("metadata")))) == before
    assert store.compact() == 0
    assert store.vacuum() > 0 and sorted(one(store.chunks().select("chunk_id", "partition", "file_id", "text", F.to_json("metadata")))) == before


def test_rows_without_partition_or_file_are_refused_and_leave_nothing(spark, store):
    before = folders(store, "data")
    for bad in ((None, "x", "w"), ("p", None, "w")):
        with pytest.raises(ValueError):
            store.insert(rows_of(spark, [("p", "fine", "w"), bad], start=900))
    assert folders(store, "data") == before and not store.file_exists("p", "fine")
    store.insert(rows_of(spark, []))
    assert folders(store, "data") == before


def test_checkpoints_give_the_same_state(spark, monkeypatch):
    monkeypatch.setattr(commits, "CHECKPOINT", 3)
    s = catalog.ChunkStore(spark, new_folder(spark, "store-test"))
    for i in range(7):
        s.insert(rows_of(spark, [("p", f"f{i}", "w")], start=10 * i))
    s.delete_file("p", "f2")
    assert [n for n in s.log._names() if n.startswith("s")] == [f"s{v:012d}" for v in (3, 6)]
    whole = commits.State()
    for v in range(1, 9):
        whole.apply(s.log._change(v), v)
    assert json.loads(commits._dump(whole)) == json.loads(commits._dump(s.log.state()))
    assert len(names(s)) == 6


def run_all(calls):
    """Run calls in threads that all start from the state before: what each raised."""
    out = [None] * len(calls)

    def go(i):
        try:
            calls[i]()
        except Exception as e:
            out[i] = e

    threads = [threading.Thread(target=go, args=(i,)) for i in range(len(calls))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def meet_at_commit(monkeypatch, n):
    """The first n commits wait for each other, so that all were prepared against the same state."""
    barrier, commit, count = threading.Barrier(n), commits.Log.commit, [0]
    lock = threading.Lock()

    def held(self, *a, **b):
        with lock:
            count[0] += 1
            wait = count[0] <= n
        if wait:
            barrier.wait(120)
        return commit(self, *a, **b)

    monkeypatch.setattr(commits.Log, "commit", held)


def test_writers_of_two_partitions_both_come_through(spark, store, monkeypatch):
    meet_at_commit(monkeypatch, 2)
    version = store.log.state().version
    assert run_all([lambda: store.insert(rows_of(spark, [("x", "one", "w")], start=700)), lambda: store.insert(rows_of(spark, [("y", "two", "w")], start=710))]) == [None, None]
    assert store.log.state().version == version + 2 and store.file_exists("x", "one") and store.file_exists("y", "two")


def test_writers_of_one_file_only_the_first_comes_through(spark, store, monkeypatch):
    meet_at_commit(monkeypatch, 2)
    before = folders(store, "data")
    raised = run_all([lambda: store.insert(rows_of(spark, [("x", "same", "first")], start=700)), lambda: store.insert(rows_of(spark, [("x", "same", "second")], start=710))])
    assert sorted(type(e).__name__ for e in raised) == ["AlreadyThere", "NoneType"]
    assert store.file_chunks("x", "same").count() == 2
    assert len(folders(store, "data")) == len(before) + 1  # the loser's files went


def test_a_delete_and_a_patch_of_one_file_that_meet(spark, store, monkeypatch):
    meet_at_commit(monkeypatch, 2)
    raised = run_all([lambda: store.delete_file("p", "f1"), lambda: store.patch_metadata("p", "f1", {"a": "b"})])
    assert raised[0] is None and type(raised[1]).__name__ in ("NoneType", "NotFound")
    assert not store.file_exists("p", "f1") and len(names(store)) == 20


def test_compaction_that_meets_a_delete_keeps_it(spark, store, monkeypatch):
    store.insert(rows_of(spark, [("p", "more", "w")], start=700))
    meet_at_commit(monkeypatch, 2)
    assert run_all([lambda: store.compact(["p"]), lambda: store.delete_file("p", "f1")]) == [None, None]
    assert not store.file_exists("p", "f1") and len(names(store)) == 21


def test_point_reads_open_few_segments(spark, store):
    for i in range(4):
        store.insert(rows_of(spark, [("p", f"n{i}", "w")], start=10_000 * (i + 1)))
    assert len(store.chunk(20_001).inputFiles()) == 1 and store.chunk(20_001).head().file_id == "n1"
    assert len(store.files("q").inputFiles()) == 1
    assert len(store.file_chunks("p", "n2").inputFiles()) < len(store.chunks(["p"]).inputFiles())


# --- indexes -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("vec_id"), "text")
    rows = rows.join(docs, "vec_id")
    return rows.select(
        F.col("vec_id").alias("chunk_id"), F.concat(F.lit("p"), F.col("label").cast("string")).alias("partition"), F.concat_ws("-", F.floor(F.col("vec_id") / 100), F.col("vec_id") % 50).alias("file_id"), F.lit(0).alias("chunk_no"),
        "text", F.lit(1).alias("page"), F.col("embedding").alias("vector"), F.expr("cast(map() as map<string,string>)").alias("metadata"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )


@pytest.fixture(scope="module")
def questions(spark, vectors):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return benchmark.join(vectors.select(F.col("chunk_id").alias("query_id"), "vector"), "query_id").limit(40).cache()


@pytest.fixture(scope="module")
def indexed(spark, vectors):
    s = catalog.ChunkStore(spark, new_folder(spark, "store-test"))
    s.insert(vectors.filter("chunk_id < 300"))
    s.build_dense_index(cells=16)
    s.build_sparse_index()
    s.insert(vectors.filter("chunk_id >= 300"))  # indexed as it comes
    return s


def recall(found, exact):
    a = {(r.query_id, r.chunk_id) for r in found.collect()}
    b = {(r.query_id, r.chunk_id) for r in exact.collect()}
    return len(a & b) / len(b)


def test_dense_index_recall_and_pruning(spark, indexed, questions):
    exact = search.dense_topk(questions, indexed.chunks(), 5)
    assert recall(indexed.ann_topk(questions, 5), exact) >= 0.95
    every = sorted(map(tuple, indexed.ann_topk(questions, 5, probes=16, shortlist=100).collect()))
    assert every == sorted(map(tuple, exact.collect()))
    some = indexed.ann_topk(questions, 5, partitions=["p1", "p3"], probes=16, shortlist=100)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, search.dense_topk(questions, indexed.chunks(["p1", "p3"]), 5).collect()))
    state = indexed.log.state()
    parts, _ = indexed._split("dense", state, state.segments)
    rows = indexed._index_rows(state, parts, dense_index.SCHEMA)
    model = dense_index.load_model(spark, f"{indexed.root}/{state.models['dense']['dir']}")
    asked = np.array([r.vector for r in questions.limit(1).collect()])
    cells = [np.unique(dense_index._probed(model, dense_index.unit(asked), n)).tolist() for n in (1, 4, 16)]
    read = [files_read(rows.filter(F.col("cell").isin(c))) for c in cells]
    assert read[0] < read[1] < read[2]  # fewer probes open fewer files


def test_every_cell_gives_the_rows_of_a_scan_whatever_codes_can_tell_apart(spark):
    v = np.random.default_rng(5).standard_normal((2000, 32))
    v[500:560] = v[100] + 1e-3 * v[500:560]  # one code, different scores
    rows = [(i, "a", str(i), 0, "", 1, x.tolist(), {}) for i, x in enumerate(v)]
    schema = "chunk_id long, partition string, file_id string, chunk_no int, text string, page int, vector array<float>, metadata map<string,string>"
    s = catalog.ChunkStore(spark, new_folder(spark, "store-test"))
    s.insert(spark.createDataFrame(rows, schema).withColumn("created_at", F.lit("2024-01-01").cast("timestamp")))
    s.build_dense_index(cells=4)
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in (3, 100, 777)], "query_id long, vector array<float>")
    assert sorted(map(tuple, s.ann_topk(asked, 5, probes=4, shortlist=1).collect())) == sorted(map(tuple, search.dense_topk(asked, s.chunks(), 5).collect()))


def scan_metric(df, name):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.executedPlan()
    total, leaves = 0, plan.collectLeaves()
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get(name)
        total += metric.get().value() if metric.isDefined() else 0
    return total


def files_read(df):
    return scan_metric(df.select("chunk_id"), "numFiles")


def test_sparse_index_equals_the_scan(indexed, questions):
    got = sorted(map(tuple, indexed.keyword_topk(questions, 5).collect()))
    assert got and got == sorted(map(tuple, search.bm25_topk(questions, indexed.chunks(), 5).collect()))
    some = sorted(map(tuple, indexed.keyword_topk(questions, 7, partitions=["p2", "p5"]).collect()))
    assert some == sorted(map(tuple, search.bm25_topk(questions, indexed.chunks(["p2", "p5"]), 7).collect()))


def test_sparse_index_reads_the_terms_of_the_query(spark, vectors):
    # half a million postings of words that nobody asks for
    s = catalog.ChunkStore(spark, new_folder(spark, "store-test"))
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(5000)).cast("string"))), " ")
    rows = spark.range(8000).select(F.col("id").alias("chunk_id"), F.lit("p").alias("partition"), F.col("id").cast("string").alias("file_id"), F.lit(0).alias("chunk_no"), words.alias("text"), F.lit(1).alias("page"), F.lit(None).cast("array<float>").alias("vector"), F.expr("cast(map() as map<string,string>)").alias("metadata"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    s.insert(rows)
    s.build_sparse_index()
    q = spark.createDataFrame([(1, "w17 w4000 absent")], "query_id long, text string")
    assert sorted(map(tuple, s.keyword_topk(q, 5).collect())) == sorted(map(tuple, search.bm25_topk(q, rows, 5).collect()))
    what = s.log.state().segments[0].indexes["sparse"]
    part = postings.Part(f"{s.root}/{what['dir']}", what, ["p"], 1)
    whole = spark.read.schema(postings.BLOCKS).parquet(f"{part.path}/blocks")
    # rows that the scan itself hands on, before any filter of Spark's
    assert scan_metric(postings.blocks_of(spark, part, ["w17", "w4000"]).select("ids"), "numOutputRows") < scan_metric(whole.select("ids"), "numOutputRows") / 4


def test_indexes_follow_deletes_patches_and_compaction(spark, vectors, questions):
    s = catalog.ChunkStore(spark, new_folder(spark, "store-test"))
    s.insert(vectors.filter("chunk_id < 400"))
    s.build_dense_index(cells=8)
    s.build_sparse_index()

    def same():
        live = s.chunks()
        assert sorted(map(tuple, s.keyword_topk(questions, 5).collect())) == sorted(map(tuple, search.bm25_topk(questions, live, 5).collect()))
        assert sorted(map(tuple, s.ann_topk(questions, 5, probes=8, shortlist=100).collect())) == sorted(map(tuple, search.dense_topk(questions, live, 5).collect()))

    s.delete_files(s.files("p1").limit(9).unionByName(s.files("p2").limit(4)))
    s.patch_metadata("p3", s.files("p3").head().file_id, {"k": "v"})
    same()
    s.replace_file("p4", s.files("p4").head().file_id, vectors.filter("chunk_id = 450"))  # with a number that no chunk has
    same()
    assert s.compact() > 0
    same()
    s.delete_partition("p5")
    same()
    both = s.search(questions, top_k=5, threshold=0.1, probes=8, shortlist=100)
    want = search.search(questions, s.chunks(), top_k=5, threshold=0.1)
    assert sorted(one(both.select("query_id", "chunk_id", "score", "rank"))) == sorted(one(want.select("query_id", "chunk_id", "score", "rank")))
    assert both.columns == want.columns


def test_block_bounds_skip_most_postings():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    ids = np.arange(12_800)
    tf = np.ones(12_800, dtype=np.int32)
    tf[640:660] = 9  # one stretch stands out
    dl = np.full(12_800, 50, dtype=np.int32)
    ends = list(range(0, 12_801, 128))
    block = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))
    table = pa.table({"term": ["common"] * 100, "max_tf": [int(tf[i : i + 128].max()) for i in ends[:-1]], "min_dl": [50] * 100, "ids": block(ids), "tf": block(tf), "dl": block(dl)})
    visited = [0, 0]
    q, found, scores = postings.shard_best(table, np.empty(0, dtype=np.int64), {"common": 0}, [[0]], np.array([1.0]), 50.0, 5, 1.2, 0.75, 6, visited)
    assert found.tolist() == [640, 641, 642, 643, 644] and visited[0] < visited[1] / 4
    q, found, scores = postings.shard_best(table, np.arange(640, 650), {"common": 0}, [[0]], np.array([1.0]), 50.0, 5, 1.2, 0.75, 6)
    assert found.tolist() == [650, 651, 652, 653, 654]
    assert rng is not None


def test_search_results_meet_chunks_without_shuffling_them(spark, vectors, questions):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = staged(vectors, "chunks")
        size = len(chunks.first().vector)
        embed = lambda text: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (F.hash(text, i) % 7).cast("float"))
        asked = questions.select("query_id", "text")
        for found in (search.search(questions, chunks, threshold=0.1, hybrid=False), retrieval.retrieve(asked, chunks, embed=embed, threshold=-1.0, hybrid=False)):
            assert found.count()
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
