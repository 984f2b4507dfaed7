"""Density clusters against brute force."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import cells, density

DATA = "/root/testdata/sf0.001"


def brute_tree(ids, v, min_samples):
    """Kruskal over all pairs."""
    d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2))
    core = np.sort(d + np.diag([-1.0] * len(v)), axis=1)[:, min_samples]
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    edges = sorted((w[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(v)) for j in range(i))
    root, out = {i: i for i in ids}, []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        x, y = find(e[1]), find(e[2])
        if x != y:
            root[x] = y
            out.append(e)
    return out


def brute_labels(edges, ids, min_size):
    """Clusters by walking down the levels of the hierarchy with sets."""
    lam = lambda w: 1.0 / max(w, density.LEAST)
    edges = sorted(edges)

    def parts(members, inner):
        """Take the last edge away: the two sides."""
        (w, a, b), rest = inner[-1], inner[:-1]
        near = {i: [] for i in members}
        for _, x, y in rest:
            near[x].append(y)
            near[y].append(x)
        seen, stack = {a}, [a]
        while stack:
            for z in near[stack.pop()]:
                if z not in seen:
                    seen.add(z)
                    stack.append(z)
        sides = (seen, members - seen)
        return w, [(s, [e for e in rest if e[1] in s]) for s in sides]

    def walk(members, inner, birth):
        """(stability, members as the cluster began, children) of the cluster that begins here."""
        whole, stability = set(members), 0.0
        while inner:
            w, sides = parts(members, inner)
            large = [s for s in sides if len(s[0]) >= min_size]
            if len(large) == 2:
                stability += sum(len(s[0]) for s in sides) * (lam(w) - birth)
                return stability, whole, [walk(s[0], s[1], lam(w)) for s in sides]
            stability += sum(len(s[0]) for s in sides if len(s[0]) < min_size) * (lam(w) - birth)
            if not large:
                break
            members, inner = large[0]
        return stability, whole, []

    def best(c):
        stability, whole, kids = c
        if not kids:
            return stability, [whole]
        below = [best(k) for k in kids]
        under = sum(b[0] for b in below)
        return (stability, [whole]) if stability >= under else (under, [s for b in below for s in b[1]])

    top = walk(set(ids), edges, 0.0)
    clusters = [s for k in top[2] for s in best(k)[1]]
    return {frozenset(c) for c in clusters}


def blobs(n, seed, d=5):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-6, 6, (6, d))
    size = rng.uniform(0.2, 1.2, 6)
    pick = rng.integers(0, 7, n)
    noise = rng.uniform(-9, 9, (n, d))
    return np.where((pick < 6)[:, None], centres[pick % 6] + rng.standard_normal((n, d)) * size[pick % 6][:, None], noise)


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_tree_and_clusters_equal_brute_force(spark, monkeypatch, one_task):
    monkeypatch.setattr(density, "ONE_TASK", one_task)
    n = 500 if one_task else 120
    v = blobs(n, 1)
    ids = [3 * i + 1 for i in range(n)]
    df = spark.createDataFrame([(i, x.tolist(), "s") for i, x in zip(ids, v)], "vec_id long, embedding array<double>, cluster string").repartition(4)
    points = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    tree = sorted(map(tuple, density.spanning_tree(points, 5).collect()))
    want = sorted(brute_tree(ids, v, 5))
    assert [t[1:] for t in tree] == [t[1:] for t in want] and np.allclose([t[0] for t in tree], [t[0] for t in want])
    got = {}
    for r in density.density_clusters(df).collect():
        got.setdefault(r.cluster, set()).add(r.vec_id)
    noise = got.pop(-1, set())
    clusters = brute_labels(want, ids, 5)
    assert {frozenset(c) for c in got.values()} == clusters and len(clusters) > 2
    assert noise == set(ids) - set().union(*clusters) and noise


def test_lists_alone_are_not_enough(spark, monkeypatch):
    """Two far and dense groups: their link is in no neighbour list."""
    monkeypatch.setattr(density, "NEIGHBOURS", 5)
    monkeypatch.setattr(density, "SCAN", 16)
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.standard_normal((40, 2)), rng.standard_normal((30, 2)) + 50, rng.standard_normal((3, 2)) + [200, 0]])
    ids = list(range(len(v)))
    points = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id long, v array<double>")
    assert sorted(t[1:] for t in map(tuple, density.spanning_tree(points, 4).collect())) == sorted(t[1:] for t in brute_tree(ids, v, 4))


def test_copies_bad_vectors_and_small_tables(spark):
    rows = [(i, [1.0, 1.0]) for i in range(8)] + [(10 + i, [5.0, 5.0 + i / 100]) for i in range(8)] + [(30, [90.0, 3.0]), (31, None), (32, [float("nan"), 0.0]), (33, [None, 0.0]), (34, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in density.density_clusters(df).collect()}
    assert {got[i] for i in range(8)} == {0} and {got[10 + i] for i in range(8)} == {1} and {got[i] for i in range(30, 35)} == {-1} and len(got) == len(rows)
    assert density.density_clusters(df.limit(0)).count() == 0
    assert {r.cluster for r in density.density_clusters(df.filter("vec_id in (1, 31)")).collect()} == {-1}


def test_few_pairs_are_measured_and_the_lists_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.standard_normal((700, 16)) + 50, np.ones((40, 16)), rng.standard_normal((60, 16)) * 1e-6])
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").coalesce(1)
    d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2))
    got = {(r.a, r["rank"]): (r.b, r.d) for r in density.neighbour_lists(points, 6).collect()}
    for a in range(len(v)):
        want = sorted((d[a, b], b) for b in range(len(v)) if b != a)[:6]
        assert np.allclose([got[a, n + 1][1] for n in range(6)], [w for w, _ in want], rtol=1e-12, atol=0)
        if len({w for w, _ in want}) == 6 or want[-1][0] == 0:
            assert [got[a, n + 1][0] for n in range(6)] == [b for _, b in want]
    near, slack = density.squares_apart(v, (v * v).sum(axis=1), v, (v * v).sum(axis=1))
    assert np.abs(near - d * d).max() <= slack
    i, j = np.nonzero(d < 1e-3)
    assert (density.apart(v, v, i, j) == density.apart(v, v, j, i)).all()


def listed(df):
    return sorted((r.a, r["rank"], r.b, r.d) for r in df.collect())


def test_cells_give_what_scans_give_and_see_few_rows(spark, monkeypatch):
    monkeypatch.setattr(density, "LEAF", 32)
    rng = np.random.default_rng(4)
    v = np.concatenate([blobs(1200, 5, d=3), np.repeat(rng.uniform(-9, 9, (6, 3)), 9, axis=0), rng.integers(0, 4, (80, 3)), rng.standard_normal((40, 3)) + 400])
    points = spark.createDataFrame([(7 * i - 900, x.tolist()) for i, x in enumerate(v.astype(float))], "id long, v array<double>").repartition(3).cache()
    celled, n = cells.cut_up(points, points.count(), 32)
    celled = celled.cache()
    found = celled.groupBy("cell").agg(*cells.bounds(3)).collect()
    boxes = cells.boxes_of([(r.cell, r.low, r.high, 0.0, 0, 0) for r in found], n, 3)
    assert n == 64 and len(found) > 48
    by_cells = listed(density.lists_by_cells(celled, boxes, 6))
    assert by_cells == listed(density.neighbour_lists(points, 6))
    reach = {a: d for a, rank, _, d in by_cells if rank == 6}
    asked = celled.orderBy("id").collect()
    row, _ = cells.within(boxes, np.array([r.v for r in asked]), np.array([reach[r.id] for r in asked]))
    assert len(row) / len(asked) < n / 4
    # far components without a listed edge, and near ones with one
    comp = F.when(F.col("v")[0] > 300, 5).when(F.col("id") % 3 == 0, F.col("id") - F.pmod("id", F.lit(60))).otherwise(-1).cast("long")
    known = celled.withColumn("core", F.pmod(F.xxhash64("id"), F.lit(100)) / 80).withColumn("comp", comp).cache()
    want = sorted(density.least_outside(known, known.filter("comp <> -1")).collect())
    upper = spark.createDataFrame([(r.comp, r.w if r.comp % 2 else None) for r in want], "comp long, listed double")
    got = density.outside_by_cells(known, known.join(upper, "comp"), n, 3)
    assert sorted(got.collect()) == want and len(want) > 50


def test_narrow_vectors_are_not_scanned(spark, monkeypatch):
    """The tree of a few dimensions comes without a comparison of all rows, but where copies crowd a cell."""
    v = blobs(400, 6, d=5)
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").cache()
    want = sorted(t[1:] for t in brute_tree(list(range(400)), v, 5))
    monkeypatch.setattr(density, "LEAF", 40)
    monkeypatch.setattr(density, "CROWDED", 30)
    assert sorted(t[1:] for t in map(tuple, density.spanning_tree(points, 5).collect())) == want
    monkeypatch.setattr(density, "CROWDED", 400)
    for name in ("neighbour_lists", "least_outside"):
        monkeypatch.setattr(density, name, None)
    assert sorted(t[1:] for t in map(tuple, density.spanning_tree(points, 5).collect())) == want


def test_labels_of_many_clusters_take_no_pass_a_cluster():
    """60,000 clusters of 5 in a line: numbered by their smallest id, in the time of a sort."""
    n = 60_000
    ids = np.arange(5 * n).reshape(n, 5)[np.random.default_rng(7).permutation(n)]
    near = (ids[:, :-1].ravel(), ids[:, 1:].ravel(), np.full(4 * n, 0.1))
    far = (ids[:-1, 4], ids[1:, 0], 1.0 + np.arange(n - 1) / n)
    start = time.process_time()
    got, labels = density.condensed_labels(*(np.concatenate(x) for x in zip(near, far)), 5)
    assert time.process_time() - start < 15
    assert (got == np.arange(5 * n)).all() and (labels == np.arange(5 * n) // 5).all()
