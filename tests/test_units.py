"""Edge cases on tiny frames."""

import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import models
from quernstone.functions import text as T
from quernstone.functions import vectors as V
from quernstone.operators import catalog, chunking, evaluation, numbering, prompts, retrieval, search, tasks
from quernstone.plans import queries
from quernstone.runtime import new_folder
from quernstone.sources import loaders


def one(df):
    return [tuple(r) for r in df.collect()]


def test_strip_removes_wide_space(spark):
    df = spark.createDataFrame([("  a b\t\n",), ("",), (None,)], "t string")
    assert one(df.select(T.strip(F.col("t")))) == [("a b",), ("",), (None,)]


def test_html_script_first(spark):
    df = spark.createDataFrame([("<p>a&amp;b</p><script>x='</p>'</script><style>p{}</style><!-- c --><b>d</b>",)], "t string")
    assert one(df.select(T.html_to_text(F.col("t")))) == [("a&b d",)]


def test_marker_normalise(spark):
    df = spark.createDataFrame([("x[PAGE_SEP]a<br>b{3}[PAGE_SEP] c ",), ("none",)], "t string")
    assert one(df.select(T.marker_normalise(F.col("t")))) == [("a <br> b[PAGE_3] c",), (None,)]


def test_sizes_and_ids(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (2516582,), (2**60,)], "n long")
    assert [r[0] for r in one(df.select(T.human_size(F.col("n"))))] == ["0.00 B", "1023.00 B", "1.00 KB", "2.40 MB", "1024.00 PB"]
    ids = spark.createDataFrame([("a",), ("a/b",), ("  ",), (None,)], "f string")
    assert [r[0] for r in one(ids.select(T.valid_file_id(F.col("f"))))] == [True, False, False, False]


@pytest.mark.parametrize("length", ["characters", "words"])
def test_recursive_split(length):
    measure = chunking.LENGTHS[length]
    text = "\n\n".join("word " * 30 + str(i) for i in range(12))
    out = chunking.split_recursive(text, 40, 8, measure)
    assert all(measure(c) <= 40 for c in out)
    assert "".join("".join(out).split()).count("word") >= 12 * 30
    whole = chunking.split_recursive(text, 40, 0, measure)
    assert "".join("".join(whole).split()) == "".join(text.split())
    assert chunking.split_recursive(None, 10, 2) == [] and chunking.split_recursive("  ", 10, 2) == []


def test_markdown_split():
    text = "intro\n# A\none two\n## B\nthree\n##### not a cut\nfour"
    assert chunking.split_markdown(text, 15, 0) == ["intro", "# A\none two", "## B\nthree", "##### not a cut", "four"] or chunking.split_markdown(text, 1000, 0) == ["intro\n# A\none two\n## B\nthree\n##### not a cut\nfour"]
    assert chunking.split_markdown(text, 1000, 4)[0].count("two") == 2
    assert chunking.split_markdown(text, 1000, 1)[0].count("intro") == 1


def test_page_carry(spark):
    rows = [(1, 0, "a"), (1, 1, "b[PAGE_3]"), (1, 2, "c"), (1, 3, "[PAGE_4]d"), (1, 4, "e [PAGE_6] f")]
    out = chunking.pages(spark.createDataFrame(rows, "doc_id long, chunk_no int, chunk string")).orderBy("chunk_no")
    assert one(out.select("page", "page_end")) == [(1, 1), (1, 3), (3, 3), (5, 5), (5, 7)]


def test_context_of_single_chunk(spark):
    rows = spark.createDataFrame([(1, "s", 0, "only"), (2, "s", 0, "x"), (2, "s", 1, "y")], "doc_id long, source string, chunk_no int, chunk string")
    out = chunking.contextualise(rows, lambda s, f, p, c: F.when(c == "x", F.lit(None).cast("string")).otherwise("ctx"))
    assert sorted(one(out.select("chunk"))) == [("Context: \n\nChunk: x",), ("Context: ctx\n\nChunk: y",), ("only",)]


def test_regroup(spark):
    rows = spark.createDataFrame([(1, 0, "aa"), (1, 1, "bb"), (1, 2, "c" * 9), (1, 3, "d")], "doc_id long, chunk_no int, chunk string")
    assert sorted(one(chunking.regroup_chunks(rows, 5))) == [(1, 0, "aa\nbb"), (1, 1, "c" * 9), (1, 2, "d")]


def test_semantic_keeps_all_sentences(spark):
    docs = spark.createDataFrame([(1, "One two. Three four! Five six? Seven eight. Nine ten."), (2, "")], "doc_id long, text string")
    out = chunking.semantic_chunks(docs, lambda t: models.apply_model("hash-embedder", "array<float>", t), min_size=5, percentile=0.5)
    assert " ".join(r.chunk for r in out.orderBy("chunk_no").collect()) == "One two. Three four! Five six? Seven eight. Nine ten."


def test_semantic_takes_sentences_whose_vector_is_zero(spark):
    """Words of opposite signs cancel out in the hashed vector: the cosine is 0, not an error."""
    word, n, seen = "w", 0, {}
    while True:  # two words of one place and opposite signs
        h = zlib.crc32(f"{word}{n}.".encode())
        other = seen.get((h % 64, not h & 0x80000000))
        if other is not None:
            break
        seen[h % 64, bool(h & 0x80000000)] = n
        n += 1
    docs = spark.createDataFrame([(1, f"{word}{n}. {word}{other}.")], "doc_id long, text string")
    out = chunking.semantic_chunks(docs, lambda t: models.apply_model("hash-embedder", "array<float>", t), min_size=5)
    assert [r.chunk for r in out.collect()] == [f"{word}{n}. {word}{other}."]
    rows = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r.c for r in rows.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 1.0]


def test_dense_ties_threshold_empty(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    c = spark.createDataFrame([(3, [2.0, 0.0]), (2, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None)], "chunk_id long, vector array<float>")
    assert one(search.dense_topk(q, c, 3).orderBy("rank")) == [(1, 2, 1.0, 1), (1, 3, 1.0, 2), (1, 4, 0.0, 3)]
    assert one(search.dense_topk(q, c, 3, threshold=1.0)) == []
    assert one(search.dense_topk(q.limit(0), c, 3)) == []


def test_dense_searches_equal_query_vectors_once(spark, monkeypatch):
    scanned, blocks = [], search._blocks
    monkeypatch.setattr(search, "_blocks", lambda *a: (scanned.append(len(held)) or held for held in blocks(*a)))
    q = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(30)] + [(99, None)], "query_id long, vector array<double>")
    c = spark.createDataFrame([(i, [1.0, float(i % 7)]) for i in range(50)], "chunk_id long, vector array<float>")
    got = one(search.dense_topk(q, c, 4).orderBy("query_id", "rank"))
    assert scanned == [3]
    alike = lambda i, j: round(min((1 + (i % 3) * (j % 7)) / ((1 + (i % 3) ** 2) ** 0.5 * (1 + (j % 7) ** 2) ** 0.5), 1.0), 6)
    want = []
    for i in range(30):
        best = sorted((-alike(i, j), j) for j in range(50))[:4]
        want += [(i, j, -s, n + 1) for n, (s, j) in enumerate(best)]
    assert got == want


def test_best_keeps_the_same_rows_in_any_batches():
    rng = np.random.default_rng(0)
    scores, ids = np.round(rng.random((40, 900)), 2), rng.permutation(900)
    scores[3], scores[4, ::2] = 0.5, 0.0
    for size in (7, 64, 900):
        best = search._Best(40, 5)
        for lo in range(0, 900, size):
            some = np.argsort(ids[lo : lo + size])
            best.add(scores[:, lo : lo + size][:, some], ids[lo : lo + size][some], 0.1)
        for row in range(40):
            assert best.ids[row].tolist() == sorted((i for i, s in zip(ids.tolist(), scores[row]) if s > 0.1), key=lambda i: (-scores[row, np.flatnonzero(ids == i)[0]], i))[:5]


def test_lsh_gives_the_rows_of_spark_s_join_and_shuffles_no_candidate(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(1)
    rows = rng.standard_normal((300, 8))
    rows[200:250] = rows[100:150]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    c = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(999, None)], "chunk_id long, vector array<float>")
    q = c.filter("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    v = lambda df, i: df.filter("vector is not null").select(i, array_to_vector("vector").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=8, seed=1).fit(v(c, "chunk_id"))
    pairs = model.approxSimilarityJoin(v(q, "query_id"), v(c, "chunk_id"), 1.2, "d")
    want = search.top(pairs.select("datasetA.query_id", "datasetB.chunk_id", F.round(1 - F.col("d") * F.col("d") / 2, 6).alias("score")), 5)
    got = search.lsh_topk(q, c, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    near = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 5)) for r in df.collect())
    assert near(got) == near(want.select("query_id", "chunk_id", "score", "rank"))
    assert search.lsh_topk(q, c.limit(0)).collect() == []


def test_judging_by_label_equals_listed_judgements(spark):
    corpus = spark.createDataFrame([(i, None if i == 7 else i % 3) for i in range(20)] + [(50, 9)], "corpus_id long, label int")
    asked = corpus.filter("corpus_id % 5 = 0 or corpus_id = 7").select(F.col("corpus_id").alias("query_id"), F.col("label").alias("q_label"))
    found = spark.createDataFrame([(q, (q * 3 + r) % 20 if r else q, r + 1) for q in (0, 5, 7, 10, 50) for r in range(6)], "query_id long, corpus_id long, rank int")
    qrels = asked.join(corpus, F.col("q_label") == F.col("label")).filter("query_id <> corpus_id").select("query_id", "corpus_id")
    marked, refs = evaluation.judged_by_label(found, asked, corpus), evaluation.relevant_by_label(asked, corpus)
    assert sorted(one(evaluation.ndcg_of(marked, refs))) == sorted(one(evaluation.ndcg(found, qrels)))
    assert sorted(one(evaluation.hits_of(marked, refs))) == sorted(one(evaluation.hits_at(found, qrels)))


@pytest.mark.parametrize("name", ["ndcg_eps", "ndcg_mean_std", "ndcg_plain", "hit_rate_at_5", "mrr_at_5", "ndcg_by_nchunks"])
def test_evaluation_lists_no_query_with_every_row_of_its_label(spark, tmp_path, name):
    rows = [(i, [float(np.cos(i)), float(np.sin(i))], 1) for i in range(4000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    df = queries.QUERIES[name](spark, str(tmp_path))
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    most, left = 0, [plan]
    while left:  # the rows that any operator made: 40 queries with 3,999 rows each would be 159,960
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            left.append(node.plan())
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        left += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < most <= 8000


def test_token_lengths_are_the_library_s_and_words_are_encoded_once(monkeypatch):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, calls = tokenizers.Tokenizer.from_file(path), []

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode(self, text, **options):
            calls.append(text)
            return self.tokenizer.encode(text, **options)

        def to_str(self):
            return self.tokenizer.to_str()

    monkeypatch.setitem(chunking._TOKENIZERS, path, (Counting(plain), {}, chunking._word_by_word(plain)))
    length = chunking.token_length(path)
    texts = ["", " ", "a", "a  b", "a \n b", "it's\tone\u00a0word", "caf\u00e9 \u4e2d\u6587 \U0001f600!", "x<|endoftext|> y", "one two\nthree " * 50, "a\u180e b", "tail ", "\nhead"]
    assert [length(t) for t in texts] == [len(plain.encode(t, add_special_tokens=False)) for t in texts]
    calls.clear()
    pieces = chunking.split_recursive("alpha beta gamma delta\nepsilon zeta " * 400, 128, 16, length)
    assert len(pieces) > 10 and [length(p) for p in pieces] and len(calls) < 20


def test_rrf_bound(spark):
    leg = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, chunk_id long, rank int")
    out = one(search.rrf([leg, leg], 5).orderBy("rank"))
    assert out[0][:2] == (1, 7) and abs(out[0][2] - 2 / 101) < 1e-8


def test_last_query_wins(spark):
    found = spark.createDataFrame([(0, 1, 9, 0.5), (0, 2, 8, 0.4), (1, 1, 9, 0.3), (1, 2, 7, 0.4)], "query_idx int, rank int, chunk_id long, score double")
    assert one(search.merge_queries(found).orderBy("position").select("chunk_id", "score")) == [(8, 0.4), (7, 0.4), (9, 0.3)]


def test_scope():
    assert search.partitions_of(None) == ["_default"] and search.partitions_of("a") == ["a"]
    with pytest.raises(ValueError):
        search.partitions_of([1])
    with pytest.raises(ValueError):
        retrieval.expand("other", None)


def test_grader_fails_open(spark):
    rows = spark.createDataFrame([(1, None), (2, "irrelevant"), (3, "highly_relevant")], "chunk_id long, grade string")
    assert [r.chunk_id for r in retrieval.keep_relevant(rows, F.col("grade")).orderBy("chunk_id").collect()] == [1, 3]


def test_failing_model_gives_null(spark):
    def broken():
        raise RuntimeError

    models.register("broken", lambda: lambda texts: broken())
    df = spark.createDataFrame([("a",)], "t string")
    assert one(df.select(models.apply_model("broken", "string", F.col("t")))) == [(None,)]


def test_empty_context(spark):
    q = spark.createDataFrame([(1,)], "query_id long")
    found = spark.createDataFrame([], "query_id long, rank int, content string")
    assert one(prompts.format_context(q, found)) == [(1, prompts.NO_DOCUMENT)]
    assert prompts.last_messages(spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn int, role string, text string"), 0).count() == 0


def test_template_names(spark):
    df = spark.createDataFrame([("q",)], "t string")
    assert one(df.select(prompts.fill("{question}/{query}", query=F.col("t")))) == [("q/q",)]


def test_metrics(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id long, corpus_id long, rank int")
    qrels = spark.createDataFrame([(1, 11), (2, 99), (3, 5)], "query_id long, corpus_id long")
    assert one(evaluation.ndcg(found, qrels).orderBy("query_id")) == [(1, 0.63093), (2, 0.0), (3, 0.0)]
    assert one(evaluation.hits_at(found, qrels).orderBy("query_id")) == [(1, 1, 0.5), (2, 0, 0.0), (3, 0, 0.0)]


def test_positional_zip(spark):
    a = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "i int, x string")
    b = spark.createDataFrame([(20, "q"), (10, "p")], "j int, y string")
    assert sorted(one(numbering.zip_rows(a, b, "i", "j").select("x", "y"))) == [("a", "p"), ("b", "q")]


def test_task_states(spark):
    ev = spark.createDataFrame([(1, 1, 1, "QUEUED"), (1, 2, 2, "FAILED"), (2, 3, 5, "chunking")], "task_id long, event_id long, ts int, state string")
    last = tasks.latest(ev)
    assert one(tasks.by_status(last, "Failed").select("task_id")) == [(1,)]
    assert tasks.by_status(last, None).count() == 2
    assert one(tasks.pool_usage(spark.createDataFrame([(4, 5, 3)], "pool_size int, slots_each int, busy int"))) == [(20, 3, 17)]


def test_store(spark):
    store = catalog.ChunkStore(spark, new_folder(spark, "t"))
    schema = catalog.SCHEMA
    mk = lambda p, f, n, meta=None: (hash((p, f, n)) % 10**9, p, f, n, f"text {n}", 1, [0.5], meta or {}, None)
    assert store.chunks().count() == 0
    store.insert(spark.createDataFrame([mk("a", "f", 0), mk("a", "f", 1), mk("b", "f", 0)], schema))
    with pytest.raises(catalog.AlreadyThere):
        store.insert(spark.createDataFrame([mk("a", "g", 0), mk("b", "f", 0)], schema))
    assert store.chunks().count() == 3 and not store.file_exists("a", "g")
    store.patch_metadata("a", "f", {"title": "T"})
    assert {r.metadata["title"] for r in store.file_chunks("a", "f").collect()} == {"T"}
    assert store.delete_file("a", "nope") is False and store.delete_file("b", "f") is True
    assert not store.partition_exists("b") and store.delete_partition("b") is False
    with pytest.raises(catalog.NotFound):
        store.replace_file("a", "zz", store.chunks())
    assert {r.model for r in store.models("m").collect()} == {"m-a", "m-all"}
    assert store.sample_chunks("a", 1, 3).count() == 1
    assert store.all_chunks("a").head().vector == "[0.5]"


def test_loaders(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.txt").write_bytes(b"  caf\xe9 \n")
    (tmp_path / "d" / "b.HTML").write_text("<p>x</p><script>no</script>&eacute;")
    (tmp_path / "c.eml").write_bytes(b"Subject: s\r\nContent-Type: text/plain\r\n\r\nbody\r\n")
    (tmp_path / "e.xyz").write_bytes(b"?")
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>x</w:t><w:br w:type="page"/></w:r></w:p><w:p><w:r><w:t>y</w:t></w:r></w:p></w:document>')
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvSpPr><p:ph type="title"/></p:nvSpPr><a:p><a:t>Head</a:t></a:p></p:sp><p:pic/><p:graphicFrame><a:tr><a:tc><a:t>h</a:t></a:tc></a:tr><a:tr><a:tc><a:t>v</a:t></a:tc></a:tr></p:graphicFrame></p:sld>')
        z.writestr("ppt/notesSlides/notesSlide1.xml", '<p:n xmlns:p="p" xmlns:a="a"><a:t>note</a:t></p:n>')
    (tmp_path / "g.pptx").write_bytes(buffer.getvalue())
    (tmp_path / "h.docx").write_bytes(b"not a zip")
    files = loaders.scan_files(spark, str(tmp_path))
    got = {r.file_id: (r.text, r.error) for r in loaders.load_files(files).collect()}
    assert got["a.txt"] == ("café", None)
    assert got["d.b.HTML"] == ("x é\n[PAGE_1]\n", None)
    assert got["c.eml"][0].strip() == "body"
    assert got["e.xyz"][0] is None and "no parser" in got["e.xyz"][1]
    assert got["f.docx"][0] == "## T\nx\n[PAGE_1]\ny\n[PAGE_2]\n"
    assert got["g.pptx"][0] == "# Head\n<image>\n| h |\n| --- |\n| v |\n### Notes:\nnote\n\n[PAGE_1]\n"
    assert got["h.docx"][0] is None and got["h.docx"][1]
    known = spark.createDataFrame([("_default", "a.txt")], "partition string, file_id string")
    assert loaders.scan_files(spark, str(tmp_path), known=known).count() == len(got) - 1


def test_templates_fill_all_names_at_once(spark):
    df = spark.createDataFrame([("has {chunk} in it", "the chunk {source}")], "a string, b string")
    out = df.select(prompts.fill("<{source}|{chunk}|{unknown}|{query}>", source=F.col("a"), chunk=F.col("b"), question=F.lit("q"))).head()[0]
    assert out == "<has {chunk} in it|the chunk {source}|{unknown}|q>"
    assert df.select(prompts.fill("plain")).head()[0] == "plain"


def test_chunks_by_tokens_equal_the_library(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "One sentence here. " * 60 + "\n\n" + "añother wörd " * 90), (2, "short text"), (3, None)], "doc_id long, text string")
    rows = chunking.with_length(chunking.chunk_with(docs, "recursive", size=40, overlap=8, length=path), length=path).collect()
    library = Tokenizer.from_file(path)
    assert [r.n for r in rows] == [len(library.encode(r.chunk, add_special_tokens=False).ids) for r in rows]
    assert max(r.n for r in rows) <= 40 and {r.doc_id for r in rows} == {1, 2} and len(rows) > 10


@pytest.mark.parametrize("gone, fails", [("quernstone.llm", False), ("ahocorasick", True)])
def test_only_the_subpackage_itself_may_be_absent(gone, fails):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"import sys; sys.path.insert(0, {str(root)!r}); sys.modules[{gone!r}] = None; import __spark_entry__ as e; assert 'op8_decontaminate' not in e.queries() and 'bm25_topk' in e.queries()"
    if fails and not (root / "quernstone/llm").exists():
        pytest.skip("the subpackage is absent")
    assert (subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode != 0) == fails


def test_a_shard_s_blocks_are_cut_from_its_term_lists():
    import pyarrow as pa

    from quernstone.operators import postings

    docs = [(900 - i, ["z", "é"] + (["a"] if i % 2 else []), i % 5 + 1) for i in range(300)] + [(5000, [], 0)]
    lists = pa.table({"partition": pa.array(["p"] * 301), "shard": pa.array([3] * 301, pa.int32()), "chunk_id": pa.array([d[0] for d in docs]), "dl": pa.array([d[2] for d in docs], pa.int32()),
                      "terms": pa.array([d[1] for d in docs], pa.list_(pa.string())), "tf": pa.array([[d[0] % 3 + 1] * len(d[1]) for d in docs], pa.list_(pa.int32()))})
    got = postings._cut(lists).to_pylist()
    assert [(b["term"], b["n"]) for b in got] == [("a", 128), ("a", 22), ("z", 128), ("z", 128), ("z", 44), ("é", 128), ("é", 128), ("é", 44)]
    for b in got:
        assert (b["partition"], b["shard"], b["max_tf"], b["min_dl"]) == ("p", 3, max(b["tf"]), min(b["dl"])) and b["ids"] == sorted(b["ids"]) and b["tf"] == [i % 3 + 1 for i in b["ids"]]
    assert postings._cut(lists.slice(300)).num_rows == 0
