"""Density clustering (HDBSCAN) of vectors: core distances, a minimum spanning tree by Boruvka rounds, a condensed tree with stabilities.

The core distance of a vector is the distance to its ``min_samples``-th other one; two vectors' mutual reachability is the largest of their distance and
both core distances. Neighbour lists are exact: blocks of ``SCAN`` vectors are broadcast and met by one pass over all rows, each task keeping a few for each.
A matrix product rules out most pairs with a margin for its rounding; the rest are measured by differences. Vectors of at most ``NARROW`` dimensions are not
scanned but cut into cells (``cells.py``): what a row has found bounds which other cells it is sent to, so that work grows with the rows; lists and edges are the same.
Where copies crowd a cell beyond ``CROWDED`` rows, and in more dimensions, where boxes rule out little, scans remain.

A round takes for every component the least edge that leaves it. The neighbour lists prove most of them: what a list leaves out is farther than
its last entry. Only the vectors of components that no list proves (and not those of the largest component, which the others reach)
are compared with all rows again, and each task returns one edge a component. No list of pairs is ever made. Chosen edges join components in one task up to
``ONE_TASK`` of them and by pointer jumping beyond, with the same result. Edges are ordered by (weight, smaller id, larger id), so ties close no circle.

The tree's n - 1 edges are condensed in one task, at about 50 bytes a vector; more than ``MOST`` vectors are refused, not sampled.

Defined cases: vectors that are null, empty or hold null or non-finite entries are noise (-1), as is everything when there is no cluster; distances below
``LEAST`` count as that; ids are not null and are unique; vectors are of one length; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators import cells as C
from quernstone.operators import search as S
from quernstone.runtime import small_batches, staged

SCAN = 32_768
ONE_TASK = 1_000_000
MOST = 50_000_000
LEAST = 1e-12
NEIGHBOURS = 15
CELLS = 2_000_000  # entries of a block of differences
LEAF, CROWDED = 1024, 32_768  # rows of a cell, and more than copies may make of it
NARROW = 8  # dimensions
EDGE = "comp long, w double, lo long, hi long, other long"
NONE = tuple(np.empty(0, dtype=t) for t in (np.int64, np.float64, np.int64, np.int64, np.int64))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, so that both orders of a pair give the same bits."""
    out = np.empty((len(a), len(b)))
    step = max(1, CELLS // max(1, b.size))
    for lo in range(0, len(a), step):
        d = a[lo : lo + step, None, :] - b[None, :, :]
        out[lo : lo + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def squares_apart(a: np.ndarray, squares_a: np.ndarray, b: np.ndarray, squares_b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one matrix product, and what they can be off by at most; they tell which pairs ``apart`` has to measure."""
    return squares_a[:, None] + squares_b[None, :] - 2 * (a @ b.T), 1e-11 * (squares_a.max(initial=0.0) + squares_b.max(initial=0.0)) + 1e-300


def apart(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of the pairs (a[i], b[j]) by differences, so that both orders of a pair give the same bits."""
    out, step = np.empty(len(i)), max(1, CELLS // max(1, a.shape[1]))
    for lo in range(0, len(i), step):
        d = a[i[lo : lo + step]] - b[j[lo : lo + step]]
        out[lo : lo + step] = np.sqrt(np.einsum("ik,ik->i", d, d))
    return out


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _held(rows: DataFrame, columns: tuple[str, ...]) -> Iterator[list]:
    """Rows on the driver, ``SCAN`` at a time."""
    some: list = []
    for r in rows.select(*columns).toLocalIterator():
        some.append(r)
        if len(some) == SCAN:
            yield some
            some = []
    if some:
        yield some


def neighbour_lists(points: DataFrame, k: int) -> DataFrame:
    """(a, b, d, rank): the ``k`` nearest other vectors of each of ``points`` (id, v), ties to the smaller id."""
    spark = points.sparkSession
    small_batches(spark, 1024)

    def one(held: list) -> DataFrame:
        ids = np.array([r.id for r in held], dtype=np.int64)
        shared = spark.sparkContext.broadcast(np.array([r.v for r in held], dtype=np.float64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            squares = (asked * asked).sum(axis=1)
            best = [S._Best(min(S.QUERY_BLOCK, len(ids) - at), k) for at in range(0, len(ids), S.QUERY_BLOCK)]
            for batch in batches:
                if not batch.num_rows:
                    continue
                there = batch.column("chunk_id").to_numpy()
                order = np.argsort(there, kind="stable")
                there, x = there[order], _matrix(batch.column("v"), batch.num_rows)[order]
                own = (x * x).sum(axis=1)
                for n, held in enumerate(best):
                    mine = slice(n * S.QUERY_BLOCK, n * S.QUERY_BLOCK + len(held.scores))
                    near, slack = squares_apart(asked[mine], squares[mine], x, own)
                    near[ids[mine][:, None] == there[None, :]] = np.inf
                    most = held.scores[:, -1] ** 2
                    if len(there) > k and not np.isfinite(most).all():
                        most = np.minimum(most, np.partition(near, k - 1, axis=1)[:, k - 1] + slack)
                    i, j = np.nonzero((near <= most[:, None] + slack) & np.isfinite(near))
                    if len(i):
                        out = np.full(near.shape, -np.inf)
                        out[i, j] = -apart(asked[mine], x, i, j)
                        held.add(out, there, -np.inf)
            yield S._kept([(b.scores, b.ids) for b in best], ids)

        return points.select(F.col("id").alias("chunk_id"), "v").mapInArrow(run, S.SCORED)

    found = S._union([one(held) for held in _held(points, ("id", "v"))], spark)
    return S.top(found, k).select(F.col("query_id").alias("a"), F.col("chunk_id").alias("b"), (-F.col("score")).alias("d"), "rank")


def _first_of(comp, w, lo, hi, other) -> tuple:
    order = np.lexsort((hi, lo, w, comp))
    head = order[np.concatenate(([True], comp[order][1:] != comp[order][:-1]))] if len(order) else order
    return tuple(x[head] for x in (comp, w, lo, hi, other))


def lesser(best: tuple, asked: tuple, there: tuple) -> tuple:
    """``best`` (comp, w, lo, hi, other) with the least edges from ``asked`` to ``there``, both (v, squares, core, id, comp)."""
    v, squares, core, ids, comp = asked
    x, own, core_there, ids_there, comp_there = there
    for at in range(0, len(ids), 1024):
        some = slice(at, at + 1024)
        near, slack = squares_apart(v[some], squares[some], x, own)
        near = np.maximum(np.maximum(near, core[some][:, None] ** 2), core_there[None, :] ** 2)
        near[comp[some][:, None] == comp_there[None, :]] = np.inf
        most = near.min(axis=1)
        if len(best[0]):  # what the component has already
            place = np.minimum(np.searchsorted(best[0], comp[some]), len(best[0]) - 1)
            most = np.minimum(most, np.where(best[0][place] == comp[some], best[1][place] ** 2, np.inf))
        i, j = np.nonzero((near <= most[:, None] + 2 * slack) & np.isfinite(near))
        if not len(i):
            continue
        w = np.maximum(np.maximum(apart(v[some], x, i, j), core[some][i]), core_there[j])
        a, b = ids[some][i], ids_there[j]
        new = (comp[some][i], w, np.minimum(a, b), np.maximum(a, b), comp_there[j])
        best = _first_of(*map(np.concatenate, zip(best, new)))
    return best


def least_outside(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(comp, w, lo, hi, other): for each component of ``asked`` the least edge from one of those vectors to a row of another component.

    Both are (id, v, core, comp).
    """
    spark = rows.sparkSession

    def one(held: list) -> DataFrame:
        made = (np.array([r.v for r in held], dtype=np.float64), *(np.array([r[c] for r in held], dtype=t) for c, t in (("core", np.float64), ("id", np.int64), ("comp", np.int64))))
        shared = spark.sparkContext.broadcast(made)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, core, ids, comp = shared.value
            squares = (v * v).sum(axis=1)
            best = NONE
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("v"), batch.num_rows)
                best = lesser(best, (v, squares, core, ids, comp), (x, (x * x).sum(axis=1), *(batch.column(c).to_numpy() for c in ("core", "id", "comp"))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["comp", "w", "lo", "hi", "other"])

        return rows.select("id", "v", "core", "comp").mapInArrow(run, EDGE)

    parts = [one(held) for held in _held(asked, ("id", "v", "core", "comp"))]
    out = spark.createDataFrame([], EDGE)
    for p in parts:
        out = out.unionAll(p)
    return _least(out)


def _sorted(group: pa.Table, *columns: str) -> list[np.ndarray]:
    """ids, vectors, their squares and ``columns`` of a group, by id."""
    ids = group.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    v = C.matrix(group.column("v").combine_chunks(), group.num_rows)[order]
    return [ids[order], v, (v * v).sum(axis=1), *(group.column(c).to_numpy()[order] for c in columns)]


def _some_nearest(asked: tuple, there: tuple, k: int) -> Iterator[tuple]:
    """(first row, i, j, d): the ``k`` nearest of ``there`` within the reach of each of ``asked``, both (ids, v, squares), asked with its reach, by distance and id."""
    ids, v, squares, reach = asked
    others, x, own = there
    for at in range(0, len(ids), 1024):
        some = slice(at, at + 1024)
        near, slack = squares_apart(v[some], squares[some], x, own)
        near[ids[some][:, None] == others[None, :]] = np.inf
        most = reach[some] ** 2
        if len(others) > k:
            most = np.minimum(most, np.partition(near, k - 1, axis=1)[:, k - 1] + slack)
        i, j = np.nonzero((near <= most[:, None] + slack) & np.isfinite(near))
        d = apart(v[some], x, i, j)
        order = np.lexsort((j, d, i))
        order = order[(d <= reach[some][i])[order]]
        place = np.arange(len(order)) - np.searchsorted(i[order], i[order])
        order = order[place < k]
        yield at, i[order], j[order], d[order]


def lists_by_cells(celled: DataFrame, boxes: C.Boxes, k: int) -> DataFrame:
    """What ``neighbour_lists`` gives, for (id, v, cell): the k-th nearest in a row's own cell bounds which other cells it has to see."""

    def inside(group: pa.Table) -> pa.Table:
        ids, v, squares = _sorted(group)
        reach, lists, far = np.full(len(ids), np.inf), [], np.full(len(ids), np.inf)
        for at, i, j, d in _some_nearest((ids, v, squares, far), (ids, v, squares), k):
            full = np.bincount(i, minlength=min(1024, len(ids) - at)) == k
            reach[at : at + len(full)][full] = d[np.searchsorted(i, np.flatnonzero(full), "right") - 1]
            lists.append((at + i, ids[j], d))
        i, b, d = (np.concatenate(x) for x in zip(*lists))
        ends = pa.array(np.searchsorted(i, np.arange(len(ids) + 1)).astype(np.int32))
        cell = np.full(len(ids), group.column("cell")[0].as_py(), dtype=np.int32)
        columns = [pa.array(ids), pa.array(list(v)), pa.array(cell), pa.array(reach), pa.ListArray.from_arrays(ends, pa.array(b)), pa.ListArray.from_arrays(ends, pa.array(d))]
        return pa.table(columns, names=["id", "v", "cell", "reach", "b", "d"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, cell = C.within(boxes, C.matrix(batch.column("v"), batch.num_rows), batch.column("reach").to_numpy())
                elsewhere = cell != batch.column("cell").to_numpy()[row]
                row = pa.array(row[elsewhere])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("v").take(row), batch.column("reach").take(row), pa.array(cell[elsewhere].astype(np.int32))], ["id", "v", "reach", "cell"])

    def meet(asked: pa.Table, there: pa.Table) -> pa.Table:
        out = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
        if asked.num_rows and there.num_rows:
            ids, v, squares, reach = _sorted(asked, "reach")
            others = _sorted(there)
            out += [(ids[at + i], others[0][j], d) for at, i, j, d in _some_nearest((ids, v, squares, reach), tuple(others), k)]
        return pa.table(dict(zip("abd", (pa.array(np.concatenate(x)) for x in zip(*out)))))

    own = staged(celled.groupBy("cell").applyInArrow(inside, "id long, v array<double>, cell int, reach double, b array<long>, d array<double>"), "own-cells")
    asked = own.select("id", "v", "cell", "reach").mapInArrow(walk, "id long, v array<double>, reach double, cell int")
    met = asked.groupBy("cell").cogroup(celled.groupBy("cell")).applyInArrow(meet, "a long, b long, d double")
    listed = own.select(F.col("id").alias("a"), F.explode(F.arrays_zip("b", "d")).alias("x")).select("a", "x.b", "x.d")
    order = Window.partitionBy("a").orderBy("d", "b")
    return listed.unionAll(met).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def outside_by_cells(rows: DataFrame, asked: DataFrame, cells: int, width: int) -> DataFrame:
    """What ``least_outside`` gives, for (id, v, core, comp, cell), ``asked`` with what is ``listed`` for its component: an edge that is known bounds which cells a row has to see."""
    one = F.struct("comp", "id", "v", "core")
    found = rows.groupBy("cell").agg(*C.bounds(width), F.min("core").alias("core"), F.min(one).alias("first"), F.max(one).alias("last")).collect()
    boxes = C.boxes_of([(r.cell, r.low, r.high, r.core, r.first.comp, r.last.comp) for r in found], cells, width)
    ends = [x for r in found for x in (r.first, r.last)]
    comp_there, v_there, core_there = np.array([x.comp for x in ends]), np.array([x.v for x in ends]).reshape(-1, width), np.array([x.core for x in ends])

    def some_edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(C.matrix(batch.column("v"), batch.num_rows), v_there)
                comp = batch.column("comp").to_numpy()
                d = np.maximum(np.maximum(d, batch.column("core").to_numpy()[:, None]), core_there[None, :])
                d[comp[:, None] == comp_there[None, :]] = np.inf
                yield pa.RecordBatch.from_arrays([batch.column("comp"), pa.array(d.min(axis=1))], ["comp", "most"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                most, core = batch.column("most").to_numpy(), batch.column("core").to_numpy()
                reach = np.where(core <= most * C.NEAR_ONE, most, -1.0)
                near = np.flatnonzero(reach >= 0)
                row, cell = C.within(boxes, C.matrix(batch.column("v"), batch.num_rows)[near], reach[near], batch.column("comp").to_numpy()[near])
                row = pa.array(near[row])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("id", "v", "core", "comp")), pa.array(cell.astype(np.int32))], ["id", "v", "core", "comp", "cell"])

    def meet(asked: pa.Table, there: pa.Table) -> pa.Table:
        best = NONE
        if asked.num_rows and there.num_rows:
            (ids, v, squares, core, comp), (others, x, own, core_, comp_) = (_sorted(t, "core", "comp") for t in (asked, there))
            best = lesser(best, (v, squares, core, ids, comp), (x, own, core_, others, comp_))
        return pa.table([pa.array(c) for c in best], names=["comp", "w", "lo", "hi", "other"])

    # a component without any listed edge takes one from a row of each of its cells to the first and last component of every cell
    lone = asked.filter("listed is null").groupBy("cell", "comp").agg(F.min(F.struct("core", "id", "v")).alias("x")).select("comp", "x.v", "x.core")
    some = lone.mapInArrow(some_edge, "comp long, most double").groupBy("comp").agg(F.min("most").alias("most"))
    known = asked.join(some, "comp", "left").select("id", "v", "core", "comp", F.coalesce("listed", "most").alias("most"))
    visits = known.mapInArrow(walk, "id long, v array<double>, core double, comp long, cell int")
    return _least(visits.groupBy("cell").cogroup(rows.groupBy("cell")).applyInArrow(meet, EDGE))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("comp", "e.*")


def _roots(chosen: DataFrame) -> DataFrame:
    """(comp, root): where each component of ``chosen`` (comp, other) ends up; components that chose no edge are roots."""
    if chosen.limit(ONE_TASK + 1).count() <= ONE_TASK:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = [b for b in batches if b.num_rows]
            if batches:
                comp, other = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("comp", "other"))
                nodes, at = np.unique(np.concatenate([comp, other]), return_inverse=True)
                parent = np.arange(len(nodes))
                parent[at[: len(comp)]] = at[len(comp) :]
                circle = (parent[parent] == np.arange(len(nodes))) & (np.arange(len(nodes)) < parent)  # two that chose each other
                parent[circle] = np.flatnonzero(circle)
                while (parent[parent] != parent).any():
                    parent = parent[parent]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[parent])], ["comp", "root"])

        return chosen.select("comp", "other").coalesce(1).mapInArrow(run, "comp long, root long")
    step = chosen.select("comp", F.col("other").alias("root"))
    back = chosen.select(F.col("comp").alias("root"), F.col("other").alias("back"))
    roots = staged(step.join(back, "root", "left").withColumn("root", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("root")), F.col("comp")).otherwise(F.col("root"))).select("comp", "root"), "roots")
    while True:  # every pass halves the way to the root
        after = staged(roots.join(roots.select(F.col("comp").alias("root"), F.col("root").alias("next")), "root", "left").select("comp", F.coalesce("next", "root").alias("root")), "roots")
        moved = after.join(roots.withColumnRenamed("root", "was"), "comp").filter("root <> was").limit(1).count()
        roots = after
        if not moved:
            return roots


def spanning_tree(points: DataFrame, min_samples: int) -> DataFrame:
    """(w, lo, hi): the minimum spanning tree of ``points`` (id, v) under mutual reachability."""
    spark = points.sparkSession
    k = max(min_samples, NEIGHBOURS)
    width = len((points.select("v").head() or [[]])[0])
    cells, narrow = 0, 0 < width <= NARROW
    if narrow:
        small_batches(spark, 4096)
        celled, cells = C.cut_up(points, points.count(), LEAF)
        celled = staged(celled, "cells")
        found = celled.groupBy("cell").agg(*C.bounds(width), F.count(F.lit(1)).alias("n")).collect()
        narrow = max(r.n for r in found) <= CROWDED
    if narrow:
        points = celled
        boxes = C.boxes_of([(r.cell, r.low, r.high, 0.0, 0, 0) for r in found], cells, width)
        lists = staged(lists_by_cells(points, boxes, k), "neighbours")
    else:
        lists = staged(neighbour_lists(points, k), "neighbours")
    core = lists.filter(F.col("rank") <= min_samples).groupBy("a").agg(F.max("d").alias("core"))
    reach = lists.groupBy("a").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("reach"))
    rows = points.join(core.withColumnRenamed("a", "id"), "id").join(reach.withColumnRenamed("a", "id"), "id")
    rows = staged(rows.select("id", "v", "core", "reach", *["cell"] * narrow), "cores")
    weight = F.greatest("d", "core_a", "core_b")
    named = lambda c: rows.select(F.col("id").alias(c), F.col("core").alias(f"core_{c}"))
    edges = lists.join(named("a"), "a").join(named("b"), "b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), weight.alias("w")).distinct()
    edges = staged(edges, "edges")
    comps = staged(rows.select("id", F.col("id").alias("comp")), "components")
    tree = None
    while True:
        sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.orderBy(F.desc("n"), "comp").limit(1).collect()
        if not largest or sizes.limit(2).count() < 2:
            return tree if tree is not None else spark.createDataFrame([], "w double, lo long, hi long")
        side = lambda c, name: comps.select(F.col("id").alias(c), F.col("comp").alias(name))
        crossing = staged(edges.join(side("lo", "x"), "lo").join(side("hi", "y"), "hi").filter("x <> y"), "crossing")
        both = crossing.select(F.col("x").alias("comp"), "w", "lo", "hi", F.col("y").alias("other")).unionAll(crossing.select(F.col("y").alias("comp"), "w", "lo", "hi", F.col("x").alias("other")))
        listed = _least(both)
        known = rows.join(comps, "id")
        bound = known.groupBy("comp").agg(F.min("reach").alias("reach")).join(listed, "comp", "left")
        bound = staged(bound, "bounds")
        # what a list leaves out is at least as far as its last entry; a tie there might be a smaller edge
        proven = bound.filter(F.col("w") < F.col("reach")).select("comp", "w", "lo", "hi", "other")
        unproven = bound.filter(F.coalesce(F.col("w") >= F.col("reach"), F.lit(True)) & (F.col("comp") != largest[0].comp)).select("comp", F.col("w").alias("listed"))
        asked = known.join(unproven, "comp").filter(F.coalesce(F.col("reach") <= F.col("listed"), F.lit(True)))
        found = outside_by_cells(known, asked, cells, width) if narrow else least_outside(known, asked.select("id", "v", "core", "comp"))
        chosen = staged(_least(proven.unionByName(found).unionByName(bound.join(unproven.select("comp"), "comp", "left_semi").filter("w is not null").select("comp", "w", "lo", "hi", "other"))), "chosen")
        new = chosen.select("w", "lo", "hi").distinct()
        tree = staged(new if tree is None else tree.unionAll(new), "tree")
        edges = crossing.select("lo", "hi", "w")
        comps = staged(comps.join(_roots(chosen), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "components")


def condensed_labels(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, labels) from a spanning tree: clusters by excess of mass, numbered by their smallest id; noise is -1. The whole is no cluster."""
    ids, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    n = len(ids)
    a, b = at[: len(lo)], at[len(lo) :]
    order = np.lexsort((hi, lo, w))
    # dendrogram: node n + i joins two nodes at the i-th weight
    left, right, size, height = np.empty(n - 1, dtype=np.int64), np.empty(n - 1, dtype=np.int64), np.ones(2 * n - 1, dtype=np.int64), np.maximum(w[order], LEAST)
    parent, node = np.arange(n), np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, e in enumerate(order):
        x, y = find(a[e]), find(b[e])
        left[i], right[i] = node[x], node[y]
        size[n + i] = size[node[x]] + size[node[y]]
        if size[node[x]] < size[node[y]]:
            x, y = y, x
        parent[y], node[x] = x, n + i
    # condensed tree, from the top: (cluster, its birth); a split into two large parts makes two clusters
    cluster_of, birth, above, stability, fallen = np.full(2 * n - 1, -1), [0.0], [-1], [0.0], np.full(n, -1)
    cluster_of[2 * n - 2] = 0
    for v in range(2 * n - 2, n - 1, -1):
        c = cluster_of[v]
        if c < 0:
            continue
        level = 1.0 / height[v - n]
        kids = (left[v - n], right[v - n])
        large = [x for x in kids if size[x] >= min_size]
        if len(large) == 2:
            for x in kids:
                stability[c] += size[x] * (level - birth[c])
                cluster_of[x] = len(birth)
                birth.append(level)
                above.append(c)
                stability.append(0.0)
        else:
            for x in kids:
                if size[x] >= min_size:
                    cluster_of[x] = c
                else:
                    stability[c] += size[x] * (level - birth[c])
                    stack = [x]  # this part falls out of the cluster here
                    while stack:
                        y = stack.pop()
                        if y < n:
                            fallen[y] = c
                        else:
                            stack += (left[y - n], right[y - n])
    # excess of mass, from the leaves
    m = len(birth)
    below = np.zeros(m)
    chosen = np.zeros(m, dtype=bool)
    kids_of: list[list[int]] = [[] for _ in range(m)]
    for c in range(m - 1, 0, -1):
        kids_of[above[c]].append(c)
        chosen[c] = not kids_of[c] or stability[c] >= below[c]
        below[above[c]] += stability[c] if chosen[c] else below[c]
    label = np.full(m, -1)
    for c in range(1, m):  # a cluster within a chosen one is part of it
        if label[above[c]] >= 0:
            label[c] = label[above[c]]
        elif chosen[c]:
            label[c] = c
    labels = np.where(fallen >= 0, label[fallen], -1)
    names, first = np.unique(labels[labels >= 0], return_index=True)
    number = np.full(m, -1)
    number[names[np.argsort(first)]] = np.arange(len(names))
    return ids, np.where(labels >= 0, number[labels], -1)


def density_clusters(rows: DataFrame, *, min_cluster_size: int = 5, min_samples: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, cluster of each row: clusters from 0, noise is -1."""
    fine = F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))
    points = staged(rows.filter(fine).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")), "points")
    n = points.count()
    if n > MOST:
        raise ValueError(f"{n} vectors are more than the {MOST} whose tree one task can condense")
    tree = spanning_tree(points, min_samples or min_cluster_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            lo, hi, w = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("lo", "hi", "w"))
            ids, labels = condensed_labels(lo, hi, w, min_cluster_size)
            for at in range(0, len(ids), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 65_536]), pa.array(labels[at : at + 65_536].astype(np.int32))], ["_id", "cluster"])

    labels = staged(tree.coalesce(1).mapInArrow(run, "_id long, cluster int"), "clusters")
    return rows.select(key).join(labels, F.col(key) == F.col("_id"), "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))
