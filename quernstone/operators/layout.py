"""Reduction of vectors to few dimensions by the layout of their neighbour graph (the method known as UMAP).

The graph comes from neighbour descent: rows stand next to each other in the sort orders of a few random projections, which gives every row a first
list; in each round a row's neighbours, and a hashed choice of the rows that have it as a neighbour, are introduced to each other, and every
list keeps its nearest. A group is at most ``2 k + 1`` vectors, so rounds are linear in the rows and no list of pairs is made. Groups whose centers lie
together (a cell of ``cells.py``) are looked at together: a vector goes there once, a pair is measured once, and only what betters a list comes back.

Edges get fuzzy weights: each row's scale is such that its neighbours' memberships add up to log2(k), and both directions are united. The layout starts
from principal components. Rows are dealt by their first coordinate to blocks of ``BLOCK``; in each round every block moves its own rows for a few epochs
along their edges and away from a broadcast sample of ``SAMPLE`` rows, with the other blocks' rows where the last round left them. All draws are
seeded by (seed, round, block), so reruns agree as long as rows meet their blocks in the same order, which is by id.

Defined cases: vectors that are null, empty or hold null or non-finite entries have no place and get null; equal vectors are neighbours at distance
0; ids are not null and are unique; vectors are of one length; a single vector lies at 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators import cells as C
from quernstone.operators.density import apart
from quernstone.operators.numbering import numbered
from quernstone.runtime import small_batches, staged

BLOCK, SAMPLE, NEGATIVES = 4096, 4096, 5
ORDERS, ROUNDS, SETTLED = 4, 6, 0.002
GROUP, TOGETHER = 2048, 256  # centers of a block, and of a product
#: The curve 1 / (1 + A d^2B) that fits a least distance of 0.1 at a spread of 1.
CURVE_A, CURVE_B = 1.577, 0.895
PAIR = "a long, b long, d double"


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each a, each b once, ties to the smaller id; ``new`` is 0 if any of a pair's rows says so."""
    once = pairs.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).filter(F.col("n") <= k).drop("n")


def first_lists(points: DataFrame, k: int, seed: int) -> DataFrame:
    """(a, b, d): for each of ``points`` (id, v) the k nearest of those that stand near it in some random sort order."""
    small_batches(points.sparkSession, 4096)

    def projected(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = _matrix(batch.column("v"), batch.num_rows)
                    along = v @ np.random.default_rng((seed, turn)).standard_normal(v.shape[1])
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(along)], [*batch.schema.names, "along"])

        return run

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids = held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column("id").to_numpy(), _matrix(batch.column("v"), batch.num_rows)
            if held is not None:
                ids, v = np.concatenate([held_ids, ids]), np.concatenate([held, v])
            out = []
            for step in range(1, min(2 * k, len(ids) - 1) + 1):
                d = np.sqrt(((v[step:] - v[:-step]) ** 2).sum(axis=1))
                out += [(ids[step:], ids[:-step], d), (ids[:-step], ids[step:], d)]
            held_ids, held = ids[-2 * k :], v[-2 * k :]
            if out:
                a, b, d = map(np.concatenate, zip(*out))
                order = np.lexsort((b, d, a))
                place = np.arange(len(order)) - np.searchsorted(a[order], a[order])
                order = order[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(a[order]), pa.array(b[order]), pa.array(d[order])], ["a", "b", "d"])

    pairs = None
    for turn in range(ORDERS):
        one = points.mapInArrow(projected(turn), "id long, v array<double>, along double").repartitionByRange("along", "id").sortWithinPartitions("along", "id").mapInArrow(near, PAIR)
        pairs = one if pairs is None else pairs.unionAll(one)
    return staged(_nearest(pairs.withColumn("new", F.lit(1)), k), "lists")


def introduced(ids: np.ndarray, v: np.ndarray, reach: np.ndarray, listed: tuple, center: np.ndarray, member: np.ndarray, k: int) -> tuple:
    """(a, b, d): for each row of ``ids`` the k nearest of those that stand with it at some center, within its reach and not listed as near as that.

    ``listed`` is (row, id, distance); ``center`` and ``member`` are ids, a pair may come twice.
    """
    n, squares = len(ids), (v * v).sum(axis=1)
    slack = 2e-11 * squares.max(initial=0.0) + 1e-300
    _, center = np.unique(center, return_inverse=True)
    pairs = np.unique(center * n + np.searchsorted(ids, member))
    center, member = pairs // n, pairs % n
    starts = np.searchsorted(center, np.arange(center[-1] + 2 if len(center) else 1))
    limit, met = reach * reach + slack, [np.empty(0, dtype=np.int64)]
    for at in range(0, len(starts) - 1, TOGETHER):
        lo = starts[at : at + TOGETHER + 1]
        size = np.diff(lo)
        column = np.arange(size.max())
        there = column[None, :] < size[:, None]
        at_ = member[np.minimum(lo[:-1, None] + column[None, :], len(member) - 1)]
        x = v[at_]
        near = squares[at_][:, :, None] + squares[at_][:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        near = (near <= np.maximum(limit[at_][:, :, None], limit[at_][:, None, :])) & there[:, :, None] & there[:, None, :] & (column[:, None] < column[None, :])
        g, i, j = np.nonzero(near)
        met.append(np.unique(at_[g, i] * n + at_[g, j]))
    met = np.unique(np.concatenate(met))
    i, j = met // n, met % n
    d = apart(v, v, i, j)
    a, b, d = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, d])
    row, other, listed_d = listed
    place = np.minimum(np.searchsorted(ids, other), n - 1)
    here = ids[place] == other
    had, had_d = row[here] * n + place[here], listed_d[here]
    order = np.argsort(had)
    had, had_d = had[order], had_d[order]
    keep = d <= reach[a]
    if len(had):
        code = a * n + b
        at_ = np.minimum(np.searchsorted(had, code), len(had) - 1)
        keep &= (had[at_] != code) | (d < had_d[at_])
    a, b, d = a[keep], b[keep], d[keep]
    order = np.lexsort((b, d, a))
    order = order[np.arange(len(order)) - np.searchsorted(a[order], a[order]) < k]
    return ids[a[order]], ids[b[order]], d[order]


def neighbour_graph(points: DataFrame, k: int = 15, *, seed: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """(a, b, d): about the k nearest neighbours of each of ``points`` (id, v)."""
    lists = first_lists(points, k, seed)
    total = lists.count()
    # centers that lie together are looked at together, so that a vector that many of them know goes there once
    celled, _ = C.cut_up(points, points.count(), GROUP)
    crowd = F.broadcast(celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * GROUP)).alias("parts")))
    homes = staged(celled.join(crowd, "cell").select(F.col("id").alias("center"), F.struct("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).alias("home")), "homes")

    def introduce(known: pa.Table, links: pa.Table) -> pa.Table:
        order = pa.array(np.argsort(known.column("who").to_numpy(), kind="stable"))
        known = known.take(order).combine_chunks()
        lists_ = known.column("listed").combine_chunks()
        row = np.repeat(np.arange(known.num_rows), np.diff(lists_.offsets.to_numpy().astype(np.int64)))
        b, d = (lists_.flatten().field(c).to_numpy() for c in ("b", "d"))
        v = C.matrix(known.column("v").combine_chunks(), known.num_rows)
        out = introduced(known.column("who").to_numpy(), v, known.column("reach").to_numpy(), (row, b, d), links.column("center").to_numpy(), links.column("id").to_numpy(), k)
        return pa.table(dict(zip("abd", map(pa.array, out))))

    for turn in range(rounds):
        known = points.join(lists.groupBy("a").agg(F.max("d").alias("reach"), F.collect_list(F.struct("b", "d")).alias("listed")).withColumnRenamed("a", "id"), "id").withColumnRenamed("id", "who")
        chance = F.xxhash64("a", "b", F.lit(seed), F.lit(turn))
        back = lists.withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy(chance, "a"))).filter(F.col("n") <= k).select(F.col("b").alias("center"), F.col("a").alias("id"))
        members = lists.select(F.col("a").alias("center"), F.col("b").alias("id")).unionAll(back).unionAll(points.select(F.col("id").alias("center"), "id"))
        links = staged(members.join(homes, "center").select("home", "center", "id"), "links")
        there = links.select(F.col("home").alias("at"), F.col("id").alias("who")).distinct().join(known, "who")
        met = there.groupBy("at").cogroup(links.groupBy("home")).applyInArrow(introduce, PAIR)
        lists = staged(_nearest(lists.withColumn("new", F.lit(0)).unionByName(met.withColumn("new", F.lit(1))), k), "lists")
        if lists.agg(F.sum("new")).head()[0] <= SETTLED * total:
            break
    return lists.select("a", "b", "d")


def fuzzy_edges(lists: DataFrame, k: int) -> DataFrame:
    """(a, b, w) in both directions: memberships of the neighbour lists, united."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists_ = batch.column("d")
            ends = lists_.offsets.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            d = lists_.flatten().to_numpy()
            nearest = np.full(batch.num_rows, np.inf)
            np.minimum.at(nearest, row, np.where(d > 0, d, np.inf))
            nearest = np.where(np.isfinite(nearest), nearest, 0.0)
            gap = np.maximum(d - nearest[row], 0)
            low, high = np.full(batch.num_rows, 1e-12), np.full(batch.num_rows, max(1.0, float(gap.max(initial=0.0))) * 1e3)
            for _ in range(80):  # the scale at which memberships add up to log2(k), by halving
                mid = np.sqrt(low * high)
                large = np.bincount(row, np.exp(-gap / mid[row]), batch.num_rows) > np.log2(k)
                high, low = np.where(large, mid, high), np.where(large, low, mid)
            w = np.exp(-gap / high[row])
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("a").to_numpy()[row]), batch.column("b").flatten(), pa.array(w)], ["a", "b", "w"])

    grouped = lists.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("d", "b"))).alias("x")).select("a", F.col("x.b").alias("b"), F.col("x.d").alias("d"))
    one = grouped.mapInArrow(run, "a long, b long, w double")
    united = one.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg((F.max("w") + F.when(F.count(F.lit(1)) > 1, F.min("w") * (1 - F.max("w"))).otherwise(0.0)).alias("w"))
    united = staged(united, "fuzzy")
    return united.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "w").unionAll(united.select("hi", "lo", "w"))


def moved(y: np.ndarray, a: np.ndarray, b: np.ndarray, there: np.ndarray, w: np.ndarray, sample: np.ndarray, rng: np.random.Generator, epochs: int, rate: float, fall: float) -> np.ndarray:
    """Positions after some epochs: along edges from row ``a`` to row ``b`` (-1: a row elsewhere, at ``there``), away from draws of ``sample``."""
    y, inside = y.copy(), b >= 0
    for _ in range(epochs):
        end = there.copy()
        end[inside] = y[b[inside]]
        gap = y[a] - end
        square = np.maximum((gap * gap).sum(axis=1), 1e-12)
        pull = np.clip((-2 * CURVE_A * CURVE_B * square ** (CURVE_B - 1) / (1 + CURVE_A * square**CURVE_B))[:, None] * gap, -4, 4) * w[:, None]
        step = np.stack([np.bincount(a, pull[:, c], len(y)) for c in range(y.shape[1])], axis=1)
        for _ in range(NEGATIVES):
            gap = y - sample[rng.integers(0, len(sample), len(y))]
            square = (gap * gap).sum(axis=1)
            push = (2 * CURVE_B / ((0.001 + square) * (1 + CURVE_A * square**CURVE_B)))[:, None] * gap
            step += np.clip(push, -4, 4)
        y += rate * np.clip(step, -4, 4)
        rate = max(rate - fall, 0.0)
    return y


def _worker(shared, turn: int, dims: int, epochs: int, seed: int, fall: float):
    """The function that moves a block's rows (id, own) along their links (a, b, w, y of b) in one round."""

    def work(key: tuple, mine: pa.Table, links: pa.Table) -> pa.Table:
        order = np.argsort(mine.column("id").to_numpy(), kind="stable")
        ids, y = mine.column("id").to_numpy()[order], C.matrix(mine.column("own").combine_chunks(), mine.num_rows)[order]
        a, b = links.column("a").to_numpy(), links.column("b").to_numpy()
        by = np.lexsort((b, a))
        a, b, w = a[by], b[by], links.column("w").to_numpy()[by]
        there = C.matrix(links.column("y").combine_chunks(), links.num_rows)[by] if len(a) else np.empty((0, dims))
        at = np.minimum(np.searchsorted(ids, b), len(ids) - 1)
        at = np.where(ids[at] == b, at, -1)
        block = key[0].as_py()
        out = moved(y, np.searchsorted(ids, a), at, there, w, shared.value, np.random.default_rng((seed, turn, block)), epochs, 1.0 - turn * epochs * fall, fall)
        return pa.table({"id": pa.array(ids), "block": pa.array(np.full(len(ids), block, dtype=np.int32)), "y": pa.array(list(out))})

    return work


def graph_layout(rows: DataFrame, *, dims: int = 2, k: int = 15, rounds: int = 10, epochs: int = 20, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and position (array of ``dims`` doubles) of each row."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark = rows.sparkSession
    fine = F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))
    points = staged(rows.filter(fine).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")), "points")
    n = points.count()
    if n < 2:
        return rows.select(key, F.when(fine, F.array_repeat(F.lit(0.0), dims)).alias("position"))
    edges = fuzzy_edges(neighbour_graph(points, min(k, n - 1), seed=seed), min(k, n - 1))
    width = points.select(F.size("v")).head()[0]
    as_vectors = points.select("id", array_to_vector("v").alias("v"))
    parts = min(dims, width)
    start = PCA(k=parts, inputCol="v", outputCol="p").fit(as_vectors).transform(as_vectors).select("id", vector_to_array("p").alias("p"))
    wide = start.agg(*[F.struct(F.min(F.col("p")[i]), F.max(F.col("p")[i])) for i in range(parts)]).head()
    scaled = [F.when(F.lit(r[1] > r[0]), (F.col("p")[i] - r[0]) / F.lit((r[1] - r[0]) or 1.0) * 10).otherwise(0.0) for i, r in enumerate(wide)]
    jitter = lambda i: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1000)) / 1e5)
    placed = start.select("id", F.array(*[(scaled[i] if i < parts else F.lit(0.0)) + jitter(i) for i in range(dims)]).alias("y"))
    placed = numbered(placed, F.col("y")[0], "id", name="n").select("id", ((F.col("n") - 1) / BLOCK).cast("int").alias("block"), "y")
    placed = staged(placed, "layout")
    fall = 1.0 / (rounds * epochs)
    sharp = staged(edges.join(placed.select(F.col("id").alias("a"), "block"), "a"), "layout-edges")
    for turn in range(rounds):
        drawn = placed.orderBy(F.xxhash64("id", F.lit(seed), F.lit(turn)), "id").limit(SAMPLE).select("y").collect()
        shared = spark.sparkContext.broadcast(np.array([r.y for r in drawn]))

        met = sharp.join(placed.select(F.col("id").alias("b"), "y"), "b").select("block", "a", "b", "w", "y")
        mine = placed.select("id", F.col("block").alias("own_block"), F.col("y").alias("own"))
        placed = staged(mine.groupBy("own_block").cogroup(met.groupBy("block")).applyInArrow(_worker(shared, turn, dims, epochs, seed, fall), "id long, block int, y array<double>"), "layout")
    return rows.select(key).join(placed.select(F.col("id").alias("_id"), F.col("y").alias("position")), F.col(key) == F.col("_id"), "left").select(key, "position")
