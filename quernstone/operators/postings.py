"""A stored inverted index for keyword search: postings in blocks, by term within shards of documents.

A shard holds at most about ``SHARD`` chunks of one partition, so that one task can rank it for every query. Its postings lie sorted by term and
chunk in blocks of ``BLOCK``, each with its largest term frequency and shortest document, which bound the score of whatever it
holds. A search reads the blocks of its terms alone (pushed to Parquet's row groups and pages), counts documents by term from the
blocks' sizes, and visits a shard's stretches of chunk ids from the highest bound down until the k-th best score exceeds the next
bound (block-max pruning), so common terms' blocks are mostly skipped. Scores are those of ``search.bm25_topk``.

Statistics are those of the partitions searched. Files that were deleted since a part was written leave its statistics and its
results: their chunks are found in the part's narrow document table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import search as S
from quernstone.runtime import broadcast_if_small, small_batches, staged

SHARD, BLOCK = 16_384, 128
PAGE = 256  # blocks of a Parquet page, whose least and greatest terms decide whether it is read
BLOCKS = "partition string, shard int, term string, n int, max_tf int, min_dl int, ids array<long>, tf array<int>, dl array<int>"
DOCS = "partition string, shard int, chunk_id long, file_id string, dl int"
PUSHED_IN, PUSHED = 10, 256  # values of one IN list that reach Parquet's statistics; terms up to which lists are joined by OR
BROADCAST_DEAD = 1_000_000


@dataclass
class Part:
    """The postings of one insert: where they are, what was written, the partitions wanted, and the overlays over it."""

    path: str
    what: dict
    partitions: list[str]
    version: int
    overlays: list = field(default_factory=list)


def _term_lists(rows: DataFrame) -> DataFrame:
    """chunk_id, partition, file_id, shard, dl, terms, tf of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.split_pattern(pc.replace_substring_regex(batch.column("text"), T.NO_TOKEN, " "), " ")
            words = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
            coded = words.dictionary_encode()
            code, row = coded.indices.to_numpy()[real], row[real]
            width = max(len(coded.dictionary), 1)
            key, tf = np.unique(row * width + code, return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(len(lists) + 1) * width).astype(np.int32))
            terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(key % width)))
            dl = np.bincount(row, minlength=len(lists)).astype(np.int32)
            keep = [batch.column(c) for c in ("chunk_id", "partition", "file_id", "shard")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(dl), terms, pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))], ["chunk_id", "partition", "file_id", "shard", "dl", "terms", "tf"])

    return rows.mapInArrow(run, "chunk_id long, partition string, file_id string, shard int, dl int, terms array<string>, tf array<int>")


def _cut(lists: pa.Table) -> pa.Table:
    """A shard's term lists (partition, shard, chunk_id, dl, terms, tf) to its blocks, by term and chunk. Words are sorted once each, postings by number."""
    terms, tf = (lists.column(c).combine_chunks() for c in ("terms", "tf"))
    coded = terms.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
    by_word = pc.sort_indices(coded.dictionary)
    place = np.empty(len(by_word), dtype=np.int64)
    place[by_word.to_numpy()] = np.arange(len(by_word))
    term, ids = place[coded.indices.to_numpy()], lists.column("chunk_id").to_numpy()[row]
    order = np.lexsort((ids, term))
    term, ids, tf, dl = term[order], ids[order], tf.flatten().to_numpy()[order], lists.column("dl").to_numpy()[row][order]
    new = np.flatnonzero(np.concatenate((np.ones(min(len(term), 1), dtype=bool), term[1:] != term[:-1])))
    pieces = -(-np.diff(np.append(new, len(term))) // BLOCK)
    starts = np.repeat(new, pieces) + BLOCK * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    ends = pa.array(np.append(starts, len(term)).astype(np.int32))
    same = pa.array(np.zeros(len(starts), dtype=np.int64))
    arrays = [lists.column(c).combine_chunks().take(same) for c in ("partition", "shard")]
    arrays += [coded.dictionary.take(by_word).take(pa.array(term[starts])), pa.array(np.diff(np.append(starts, len(term))).astype(np.int32))]
    arrays += [pa.array(f(x, starts) if len(starts) else x) for f, x in ((np.maximum.reduceat, tf), (np.minimum.reduceat, dl))]
    arrays += [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids, tf, dl)]
    return pa.table(arrays, ["partition", "shard", "term", "n", "max_tf", "min_dl", "ids", "tf", "dl"])


def write(chunks: DataFrame, path: str) -> dict:
    """Write the postings of chunk-store rows: ``path``/blocks and ``path``/docs; the documents and their total length by partition."""
    small_batches(chunks.sparkSession)
    sizes = chunks.groupBy("partition").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    rows = chunks.join(broadcast_if_small(sizes, BROADCAST_DEAD), "partition")
    shard = F.pmod(F.xxhash64("chunk_id"), F.col("shards")).cast("int").alias("shard")
    lists = staged(_term_lists(rows.select("chunk_id", "partition", "file_id", shard, F.lower(F.coalesce("text", F.lit(""))).alias("text"))), "term-lists")
    lists.select("partition", "shard", "chunk_id", "file_id", "dl").write.parquet(f"{path}/docs")
    shards = lists.select("partition", "shard", "chunk_id", "dl", "terms", "tf").groupBy("partition", "shard").applyInArrow(_cut, BLOCKS)
    shards.write.option("parquet.page.row.count.limit", PAGE).parquet(f"{path}/blocks")
    stats = chunks.sparkSession.read.schema(DOCS).parquet(f"{path}/docs").groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("length"))
    return {"stats": {r.partition: [r.n, r.length or 0] for r in stats.toLocalIterator()}}


def has_term(vocabulary: list[str]) -> F.Column:
    """The filter for a vocabulary's blocks, in lists short enough for Parquet's statistics; a large vocabulary is one list."""
    if len(vocabulary) > PUSHED:
        return F.col("term").isin(vocabulary)
    terms = sorted(vocabulary)
    out = F.lit(False)
    for lo in range(0, len(terms), PUSHED_IN):
        some = F.col("term").isin(terms[lo : lo + PUSHED_IN])
        out = some if lo == 0 else out | some
    return out


def blocks_of(spark, part: Part, vocabulary: list[str]) -> DataFrame:
    rows = spark.read.schema(BLOCKS).parquet(f"{part.path}/blocks").filter(has_term(vocabulary))
    return rows if len(part.partitions) == len(part.what["stats"]) else rows.filter(F.col("partition").isin(part.partitions))


def shard_best(blocks: pa.Table, dead: np.ndarray, number: dict[str, int], wanted: list[list[int]], idf: np.ndarray, mean: float, k: int, k1: float, b: float, decimals: int, visited: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, chunk id, score) of each query's k best in one shard. ``visited`` gets the postings that were scored and those there are."""
    if not blocks.num_rows:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    term = np.array([number[t] for t in blocks.column("term").to_pylist()], dtype=np.int64)
    ids, tf, dl = (blocks.column(c).combine_chunks() for c in ("ids", "tf", "dl"))
    ends = ids.offsets.to_numpy().astype(np.int64)
    ids, tf, dl = (x.flatten().to_numpy() for x in (ids, tf, dl))
    ends = ends - ends[0]
    bound = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
    most = idf[term] * bound(blocks.column("max_tf").to_numpy().astype(np.float64), blocks.column("min_dl").to_numpy())
    first, last = ids[ends[:-1]], ids[ends[1:] - 1]
    order = np.argsort(term, kind="stable")
    at = np.searchsorted(term[order], np.arange(len(idf) + 1))
    out = []
    for q, terms in enumerate(wanted):
        mine = np.concatenate([order[at[t] : at[t + 1]] for t in terms]) if terms else np.empty(0, dtype=np.int64)
        if not len(mine):
            continue
        edges = np.unique(np.concatenate([first[mine], last[mine] + 1]))
        rise = np.bincount(np.searchsorted(edges, first[mine]), most[mine], len(edges)) - np.bincount(np.searchsorted(edges, last[mine] + 1), most[mine], len(edges))
        high = np.cumsum(rise)[:-1]
        by_bound = np.argsort(-high, kind="stable")
        scores, found = np.empty(0), np.empty(0, dtype=np.int64)
        lo, step = 0, 16
        while lo < len(by_bound):
            if len(scores) == k and high[by_bound[lo]] < scores[-1] - 2 * 10.0**-decimals:
                break
            chosen = np.zeros(len(edges), dtype=bool)
            chosen[by_bound[lo : lo + step]] = True
            count = np.concatenate(([0], np.cumsum(chosen)))
            a, z = np.searchsorted(edges, first[mine]), np.searchsorted(edges, last[mine] + 1)
            open_ = mine[count[z] > count[a]]  # blocks with a chosen stretch
            spans = ends[open_ + 1] - ends[open_]
            place = np.repeat(ends[open_] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
            place = place[chosen[np.searchsorted(edges, ids[place], side="right") - 1]]
            owner = np.searchsorted(ends, place, side="right") - 1
            if visited is not None:
                visited[0] += len(place)
            if len(place):
                doc, back = np.unique(ids[place], return_inverse=True)
                sums = np.round(np.bincount(back, idf[term[owner]] * bound(tf[place].astype(np.float64), dl[place]), len(doc)), decimals)
                fine = sums > 0
                if len(dead):
                    fine &= ~np.isin(doc, dead, assume_unique=False)
                scores, found = np.concatenate([scores, sums[fine]]), np.concatenate([found, doc[fine]])
                best = np.lexsort((found, -scores))[:k]
                scores, found = scores[best], found[best]
            lo, step = lo + step, step * 2
        if visited is not None:
            visited[1] += int((ends[mine + 1] - ends[mine]).sum())
        out.append((np.full(len(found), q), found, scores))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))


def search(store, queries: DataFrame, parts: list[Part], k: int, *, k1: float = 1.2, b: float = 0.75, decimals: int = 6) -> DataFrame:
    """BM25 top-k of ``queries`` (query_id, text) over parts of one store: query_id, chunk_id, score, rank.

    A scan of the wanted blocks serves ``search.QUERY_SCAN`` queries. Blocks, and no pairs, are dealt by shard; each shard's k best of a query go
    to one window.
    """
    spark = queries.sparkSession
    small_batches(spark)
    gone = None
    for i, part in enumerate(parts):
        if part.overlays:
            docs = spark.read.schema(DOCS).parquet(f"{part.path}/docs").filter(F.col("partition").isin(part.partitions)).withColumn("_version", F.lit(part.version).cast("long"))
            dead = store.deleted(docs, part.overlays).select(F.lit(i).alias("part"), "partition", "shard", "chunk_id", "dl")
            gone = dead if gone is None else gone.unionAll(dead)
    gone = staged(gone, "dead") if gone is not None else None
    lost = gone.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("length")).head() if gone is not None else None
    if lost is not None and not lost.n:
        gone = lost = None
    kept = [part.what["stats"].get(p, (0, 0)) for part in parts for p in part.partitions]
    n, length = sum(x[0] for x in kept) - (lost.n if lost else 0), sum(x[1] for x in kept) - (lost.length if lost else 0)
    mean = length / n if n and length else 1.0
    shard = ("part", "partition", "shard")

    def one(held: list) -> DataFrame:
        ids = np.array([r.query_id for r in held], dtype=np.int64)
        number: dict[str, int] = {}
        wanted = [[number.setdefault(t, len(number)) for t in dict.fromkeys(r.terms)] for r in held]
        read = [blocks_of(spark, p, list(number)).withColumn("part", F.lit(i)) for i, p in enumerate(parts)] if number else []
        if not read:
            return spark.createDataFrame([], S.SCORED)
        blocks = read[0]
        for more in read[1:]:
            blocks = blocks.unionByName(more)
        counts = blocks.groupBy("term").agg(F.sum("n").alias("n"))
        df = np.zeros(len(number))
        for r in counts.toLocalIterator():  # a row for each query term
            df[number[r.term]] = r.n
        if gone is not None:
            few = broadcast_if_small(gone.select("part", "chunk_id"), BROADCAST_DEAD)
            open_ = blocks.join(broadcast_if_small(gone.select(*shard).distinct(), BROADCAST_DEAD), list(shard), "left_semi")
            for r in open_.select("part", "term", F.explode("ids").alias("chunk_id")).join(few, ["part", "chunk_id"], "left_semi").groupBy("term").count().toLocalIterator():
                df[number[r.term]] -= r["count"]
        shared = spark.sparkContext.broadcast((number, wanted, np.log(1 + (n - df + 0.5) / (df + 0.5)), ids))

        def rank(blocks: pa.Table, dead: np.ndarray) -> pa.Table:
            number, wanted, idf, ids = shared.value
            q, chunk, score = shard_best(blocks, dead, number, wanted, idf, mean, k, k1, b, decimals)
            return pa.table({"query_id": pa.array(ids[q]), "chunk_id": pa.array(chunk), "score": pa.array(score)})

        columns = blocks.select(*shard, "term", "max_tf", "min_dl", "ids", "tf", "dl")
        if gone is None:
            return columns.groupBy(*shard).applyInArrow(lambda t: rank(t, np.empty(0, dtype=np.int64)), S.SCORED)
        both = columns.groupBy(*shard).cogroup(gone.select(*shard, "chunk_id").groupBy(*shard))
        return both.applyInArrow(lambda t, d: rank(t, d.column("chunk_id").to_numpy()), S.SCORED)

    tokens = queries.select("query_id", T.tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    return S.top(S._union([one(held) for held in S._blocks(tokens, ("query_id", "terms"))], spark), k)
