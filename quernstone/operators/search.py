"""Dense, keyword and hybrid search of a set of queries against all chunks, in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators.numbering import numbered
from quernstone.runtime import broadcast_if_small, small_batches, staged

RRF_K = 100
ALL = ["all"]
QUERY_SCAN = 65_536  # queries of one scan of the chunks, which bounds what is broadcast
BROADCAST_FOUND = 1_000_000  # results (32 bytes each) that are broadcast; more are joined by a shuffle
QUERY_BLOCK = 2048  # queries that are compared with a batch of chunks at a time


def partitions_of(value: str | Sequence[str] | None) -> list[str]:
    """None is the default partition, a string is one partition; anything but strings is refused."""
    if value is None:
        return ["_default"]
    if isinstance(value, str):
        return [value]
    if not all(isinstance(p, str) for p in value):
        raise ValueError("partitions must be strings")
    return list(value)


def scope(chunks: DataFrame, partitions: str | Sequence[str] | None = ("all",), filters: Mapping[str, object] | None = None) -> DataFrame:
    """Chunks of the partitions (exactly ["all"]: no restriction) whose columns equal the filters' values."""
    wanted = partitions_of(partitions)
    if wanted != ALL:
        chunks = chunks.filter(F.col("partition").isin(wanted))
    for key, value in (filters or {}).items():
        chunks = chunks.filter(F.col(key) == F.lit(value))
    return chunks


def top(scored: DataFrame, k: int, *, by: str = "query_id", score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each query with their rank from 1; ties go to the smaller id."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame, columns: Sequence[str]) -> Iterator[list]:
    """The queries on the driver, ``QUERY_SCAN`` at a time: what one scan of the chunks is compared with."""
    held: list = []
    for row in queries.select(*columns).toLocalIterator():
        held.append(row)
        if len(held) == QUERY_SCAN:
            yield held
            held = []
    if held:
        yield held


class _Best:
    """The k best chunks of each query that a task has seen, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids, self.k = np.full((n, k), -np.inf), np.zeros((n, k), dtype=np.int64), k

    def add(self, scores: np.ndarray, ids: np.ndarray, floor: float) -> None:
        """Take in the scores of chunks in the order of their ids; those at ``floor`` or below don't count.

        Only scores that reach a query's k-th best so far are sorted; a query that has many takes its k best of them first.
        """
        fine = (scores > floor) & (scores >= self.scores[:, -1:])
        many = np.flatnonzero(np.count_nonzero(fine, axis=1) > 4 * self.k)
        rest = fine.copy() if len(many) else fine
        rest[many] = False
        row, column = np.nonzero(rest)
        if len(many):
            near = np.argsort(np.where(fine[many], -scores[many], np.inf), axis=1, kind="stable")[:, : self.k]
            row, column = np.concatenate([row, np.repeat(many, near.shape[1])]), np.concatenate([column, near.reshape(-1)])
        if not len(row):
            return
        touched = np.unique(row)
        held = np.isfinite(self.scores[touched])
        row = np.concatenate([row, np.repeat(touched, held.sum(axis=1))])
        new, found = np.concatenate([scores[row[: len(column)], column], self.scores[touched][held]]), np.concatenate([ids[column], self.ids[touched][held]])
        order = np.lexsort((found, -new, row))
        row, new, found = row[order], new[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.scores[touched] = -np.inf
        self.scores[row[keep], place[keep]], self.ids[row[keep], place[keep]] = new[keep], found[keep]


def _kept(blocks: list[tuple[np.ndarray, np.ndarray]], query_ids: np.ndarray) -> pa.RecordBatch:
    scores, ids = (np.concatenate(x) for x in zip(*blocks))
    fine = np.isfinite(scores)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, fine.sum(axis=1))), pa.array(ids[fine]), pa.array(scores[fine])], ["query_id", "chunk_id", "score"])


def _task_best(blocks: list, batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, k: int, score: Callable, floor: float) -> Iterator[pa.RecordBatch]:
    """Run ``score(block, batch)`` for every block of queries over a task's batches; yields each query's best once."""
    best = [_Best(min(QUERY_BLOCK, len(query_ids) - i * QUERY_BLOCK), k) for i in range(len(blocks))]
    seen = False
    for batch in batches:
        if not batch.num_rows:
            continue
        seen = True
        ids = batch.column("chunk_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        for one, block in zip(best, blocks):
            one.add(score(block, batch)[:, order], ids[order], floor)
    if seen:
        yield _kept([(b.scores, b.ids) for b in best], query_ids)


SCORED = "query_id long, chunk_id long, score double"


def _union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], SCORED)
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, *, threshold: float | None = None, decimals: int = 6) -> DataFrame:
    """Exact cosine top-k: query_id, chunk_id, score, rank.

    Queries of one vector are searched once. One scan of the chunks serves ``QUERY_SCAN`` vectors of the queries (query_id, vector): they go to the workers as a broadcast of
    that size at most, each task multiplies its batches with them in blocks of ``QUERY_BLOCK`` and keeps k for each query, and one
    window picks among those. Only scores above ``threshold`` count. Scores are capped at 1 and rounded, then ranked, so ranks
    don't depend on summation noise. Chunks (chunk_id, vector) without a vector are left out; vectors are of one length.
    """
    spark = chunks.sparkSession
    small_batches(spark, 4096)
    floor = -np.inf if threshold is None else threshold
    asked = queries.filter("vector is not null").select("query_id", "vector")
    each = staged(asked.groupBy("vector").agg(F.min("query_id").alias("query_id")), "vectors")
    def unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)

    def search(held: list) -> DataFrame:
        ids = np.array([r.query_id for r in held], dtype=np.int64)
        shared = spark.sparkContext.broadcast(unit(np.array([r.vector for r in held], dtype=np.float64)))

        def score(block: tuple, batch: pa.RecordBatch) -> np.ndarray:
            return np.round(np.minimum(block[0] @ block[1](batch).T, 1.0), decimals)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: list = [None, None]

            def rows(batch: pa.RecordBatch) -> np.ndarray:
                if last[0] is not batch:
                    last[:] = batch, unit(batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
                return last[1]

            blocks = [(shared.value[i : i + QUERY_BLOCK], rows) for i in range(0, len(ids), QUERY_BLOCK)]
            yield from _task_best(blocks, batches, ids, k, score, floor)

        return chunks.filter("vector is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector").mapInArrow(run, SCORED)

    found = top(_union([search(b) for b in _blocks(each, ("query_id", "vector"))], spark), k)
    if asked.count() == each.count():
        return found
    as_first = asked.join(each.withColumnRenamed("query_id", "first"), "vector").select("query_id", "first")
    return as_first.join(found.withColumnRenamed("query_id", "first"), "first").select("query_id", "chunk_id", "score", "rank")


def _term_rows(chunks: DataFrame, vocabulary: list[str]) -> DataFrame:
    """chunk_id, dl (its terms), terms and tf: what each chunk has of the vocabulary, by number. One pass over the texts, written once."""
    shared = chunks.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(len(shared.value), 1)
        for batch in batches:
            lists = pc.split_pattern(pc.replace_substring_regex(batch.column("text"), T.NO_TOKEN, " "), " ")
            words = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            dl = np.bincount(row[pc.not_equal(words, "").to_numpy(zero_copy_only=False)], minlength=len(lists))
            term = pc.fill_null(pc.index_in(words, value_set=shared.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            key, tf = np.unique(row[term >= 0] * width + term[term >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(len(lists) + 1) * width).astype(np.int32))
            made = [pa.ListArray.from_arrays(ends, pa.array((key % width).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(dl.astype(np.int32)), *made], ["chunk_id", "dl", "terms", "tf"])

    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return staged(rows.mapInArrow(run, "chunk_id long, dl int, terms array<int>, tf array<int>"), "term-rows")


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, *, k1: float = 1.2, b: float = 0.75, decimals: int = 6) -> DataFrame:
    """BM25 top-k of ``queries`` (query_id, text) over ``chunks`` (chunk_id, text): query_id, chunk_id, score, rank.

    Texts are read once, for what each chunk has of the query terms. One aggregate counts the chunks, their terms and the chunks
    of each query term, summed in each task before its one row a term is shuffled. Then each task adds up its own chunks' term
    weights for every query and keeps k, and one window picks among those. No (query, chunk) pair leaves a task, and a frequent
    term is nobody's hot key; what is broadcast comes from ``QUERY_SCAN`` queries at most. Chunks that share no term with a
    query aren't listed.
    """
    spark = chunks.sparkSession
    small_batches(spark)

    def search(held: list) -> DataFrame:
        ids = np.array([r.query_id for r in held], dtype=np.int64)
        vocabulary: dict[str, int] = {}
        wanted = [[vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(r.terms)] for r in held]
        rows, size = _term_rows(chunks, list(vocabulary)), len(vocabulary)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, n, length = np.zeros(size, dtype=np.int64), 0, 0
            for batch in batches:
                df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
                n, length = n + batch.num_rows, length + int(batch.column("dl").to_numpy().sum())
            met = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((met, [-1, -2]))), pa.array(np.concatenate((df[met], [n, length])))], ["term", "n"])

        counted = rows.select("terms", "dl").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        sums = {r.term: r.n for r in counted.toLocalIterator()}  # a row for each query term
        n, length = sums.pop(-1, 0), sums.pop(-2, 0)
        df = np.zeros(size)
        df[list(sums)] = list(sums.values())
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        mean = length / n if n else 1.0
        # a block of queries: terms that many of them have as a matrix, and the (term, query) places of the others in the order of the terms
        blocks = []
        for lo in range(0, len(ids), QUERY_BLOCK):
            some = wanted[lo : lo + QUERY_BLOCK]
            term, query = np.array([t for ts in some for t in ts], dtype=np.int64), np.repeat(np.arange(len(some)), [len(ts) for ts in some])
            common = np.flatnonzero(np.bincount(term, minlength=size) > max(2, len(some) // 64))
            column = np.full(size, -1)
            column[common] = np.arange(len(common))
            dense = np.zeros((len(common), len(some)))
            often = column[term] >= 0
            dense[column[term[often]], query[often]] = 1.0
            order = np.argsort(term[~often], kind="stable")
            blocks.append((len(some), column, dense, query[~often][order], np.searchsorted(term[~often][order], np.arange(size + 1))))
        shared = spark.sparkContext.broadcast((blocks, idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks, idf = shared.value
            last: list = [None, None]

            def weighted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                if last[0] is not batch:
                    lists = batch.column("terms")
                    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                    term, tf = lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy().astype(np.float64)
                    dl = batch.column("dl").to_numpy()
                    last[:] = batch, (row, term, idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / mean)))
                return last[1]

            def score(block: tuple, batch: pa.RecordBatch) -> np.ndarray:
                row, term, weight = weighted(batch)
                n_queries, column, dense, query, first = block
                at, out = column[term], np.zeros((n_queries, batch.num_rows))
                for lo in range(0, len(dense), 4096):
                    here = (at >= lo) & (at < lo + 4096)
                    part = np.zeros((batch.num_rows, min(4096, len(dense) - lo)))
                    part[row[here], at[here] - lo] = weight[here]
                    out += (part @ dense[lo : lo + 4096]).T
                rest = np.flatnonzero(at < 0)
                for lo in range(0, len(rest), 65_536):
                    some = rest[lo : lo + 65_536]
                    times = first[term[some] + 1] - first[term[some]]
                    place = np.repeat(first[term[some]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    out += np.bincount(query[place] * batch.num_rows + np.repeat(row[some], times), np.repeat(weight[some], times), out.size).reshape(out.shape)
                return np.round(out, decimals)

            yield from _task_best(blocks, batches, ids, k, score, 0.0)

        return rows.mapInArrow(run, SCORED)

    tokens = queries.select("query_id", T.tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    return top(_union([search(held) for held in _blocks(tokens, ("query_id", "terms"))], spark), k)


def rrf(legs: Sequence[DataFrame], k: int, *, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, chunk_id, rank): the k best of each query by the sum of 1 / (constant + rank)."""
    rows = None
    for leg in legs:
        part = leg.select("query_id", "chunk_id", "rank")
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))), 9).alias("score"))
    return top(fused, k)


def hybrid_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, *, threshold: float | None = None) -> DataFrame:
    """Dense and keyword lists of k each, fused. ``queries`` (query_id, text, vector); the threshold is the dense leg's."""
    return rrf([dense_topk(queries, chunks, k, threshold=threshold), bm25_topk(queries, chunks, k)], k)


def search(queries: DataFrame, chunks: DataFrame, *, partitions: str | Sequence[str] | None = ("all",), filters: Mapping[str, object] | None = None, top_k: int = 5, threshold: float | None = 0.8, hybrid: bool = True) -> DataFrame:
    """The ``top_k`` chunks of each query within partitions and column filters: query_id, rank, score and the chunk's columns but its vector.

    ``queries`` (query_id, text, vector) against chunk-store rows. ``hybrid`` fuses the dense and the keyword list; else only
    chunks whose cosine is above ``threshold`` count.
    """
    some = scope(chunks, partitions, filters)
    return with_chunks(ranked(queries, some, top_k=top_k, threshold=threshold, hybrid=hybrid), some)


def ranked(queries: DataFrame, chunks: DataFrame, *, top_k: int = 5, threshold: float | None = 0.8, hybrid: bool = True) -> DataFrame:
    """What ``search`` finds in ``chunks``, as ids only: query_id, chunk_id, score, rank."""
    return (hybrid_topk if hybrid else dense_topk)(queries, chunks, top_k, threshold=threshold)


def with_chunks(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """found (query_id, chunk_id, score, rank) with the chunks' columns but the vector. The results, a few for each query, go to the
    chunks where they are: they are written once, and broadcast when there are ``BROADCAST_FOUND`` at most."""
    few = broadcast_if_small(staged(found.select("query_id", "chunk_id", "score", "rank"), "found"), BROADCAST_FOUND)
    return few.join(chunks.drop("vector", "score", "rank"), "chunk_id")


def page(rows: DataFrame, order: str | Sequence[str], *, offset: int, limit: int) -> DataFrame:
    """One page of rows in a stated order."""
    return rows.orderBy(*([order] if isinstance(order, str) else order)).offset(offset).limit(limit)


def merge_queries(found: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Results of several queries as one list for each ``by``: (query_idx, rank, chunk_id, score) -> chunk_id, score, first_query, first_rank, position.

    The last query's copy of a chunk counts, at the place where the chunk first came up; best score first.
    """
    one = found.groupBy(*by, "chunk_id").agg(F.max_by("score", "query_idx").alias("score"), F.min(F.struct("query_idx", "rank")).alias("first"))
    order = (F.desc("score"), F.col("first"))
    ranked = one.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))) if by else numbered(one, *order).withColumn("position", F.col("position").cast("int"))
    return ranked.select(*by, "chunk_id", "score", F.col("first.query_idx").alias("first_query"), F.col("first.rank").alias("first_rank"), "position")


def lsh_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, *, bucket: float = 0.5, tables: int = 8, distance: float = 1.2) -> DataFrame:
    """Approximate top-k of unit vectors: random-projection buckets fetch candidates, exact cosine ranks them.

    Chunks whose bucket is a query's in one of the tables are its candidates, those nearer than ``distance`` count. As in ``dense_topk``, queries go
    to the chunks by broadcast, ``QUERY_SCAN`` at a time, and each task keeps k for each, so no candidate is shuffled.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    spark = chunks.sparkSession
    small_batches(spark, 4096)

    @F.udf("array<int>")
    def buckets_of(h):
        return [int(x[0]) for x in h]

    def as_vector(df: DataFrame, i: str) -> DataFrame:
        return df.filter("vector is not null").select(F.col(i).cast("long").alias(i), "vector", array_to_vector(F.col("vector")).alias("v"))

    asked, held_chunks = as_vector(queries, "query_id"), as_vector(chunks, "chunk_id")
    if held_chunks.isEmpty():
        return top(_union([], spark), k)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=1).fit(held_chunks)

    def bucketed(df: DataFrame, i: str) -> DataFrame:
        return model.transform(df).select(i, "vector", buckets_of("h").alias("h"))

    def matrix(column: pa.Array, rows: int, kind: type) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(rows, -1)

    def search(held: list) -> DataFrame:
        ids = np.array([r.query_id for r in held], dtype=np.int64)
        shared = spark.sparkContext.broadcast((np.array([r.vector for r in held], dtype=np.float64), np.array([r.h for r in held], dtype=np.int32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors, buckets = shared.value
            squares = (vectors * vectors).sum(axis=1)

            def score(at: int, batch: pa.RecordBatch) -> np.ndarray:
                mine = slice(at, at + QUERY_BLOCK)
                rows, theirs = matrix(batch.column("vector"), batch.num_rows, np.float64), matrix(batch.column("h"), batch.num_rows, np.int32)
                apart = squares[mine, None] + (rows * rows).sum(axis=1)[None, :] - 2 * (vectors[mine] @ rows.T)
                met = np.zeros(apart.shape, dtype=bool)
                for t in range(theirs.shape[1]):
                    met |= buckets[mine, t][:, None] == theirs[:, t][None, :]
                met &= apart < distance * distance
                return np.where(met, np.round(1 - np.maximum(apart, 0) / 2, 6), -np.inf)

            yield from _task_best(list(range(0, len(ids), QUERY_BLOCK)), batches, ids, k, score, -np.inf)

        return bucketed(held_chunks, "chunk_id").mapInArrow(run, SCORED)

    return top(_union([search(held) for held in _blocks(bucketed(asked, "query_id"), ("query_id", "vector", "h"))], spark), k)
