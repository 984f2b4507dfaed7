"""Neighbour graph and layout against exact neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import density, layout
from tests.test_density import blobs


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)


def exact(v, k):
    d = ((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)


def trustworthiness(v, y, k):
    near, _ = exact(y, k)
    _, rank = exact(v, k)
    n = len(v)
    out = np.take_along_axis(rank, near, axis=1) + 1
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(out - k, 0).sum()


def test_descent_finds_the_neighbours(spark):
    v = np.random.default_rng(1).standard_normal((800, 16))
    points = frame(spark, v).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    got = {}
    for r in layout.neighbour_graph(points, 10).collect():
        got.setdefault(r.a, set()).add(r.b)
        assert abs(r.d - np.linalg.norm(v[r.a] - v[r.b])) < 1e-9
    near, _ = exact(v, 10)
    assert np.mean([len(got[i] & set(near[i].tolist())) / 10 for i in range(800)]) >= 0.95
    assert all(len(x) == 10 for x in got.values())


def test_memberships_add_up_and_are_united(spark):
    lists = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (1, 4, 3.0), (2, 1, 1.0), (2, 3, 1.0), (2, 4, 1.5)], layout.PAIR)
    edges = {(r.a, r.b): r.w for r in layout.fuzzy_edges(lists, 3).collect()}
    assert edges[1, 2] == pytest.approx(1.0) and edges[1, 2] == edges[2, 1]  # the nearest belongs wholly
    assert 1 + edges[1, 3] + edges[1, 4] == pytest.approx(np.log2(3), abs=1e-6) or edges[1, 3] < 1
    assert len(edges) == 10


@pytest.mark.parametrize("block", [4096, 150])
def test_layout_keeps_neighbours_and_reruns_agree(spark, monkeypatch, block):
    monkeypatch.setattr(layout, "BLOCK", block)
    v = blobs(400, 3, d=12)
    df = frame(spark, v)
    first = {r.vec_id: r.position for r in layout.graph_layout(df, dims=2).collect()}
    y = np.array([first[i] for i in range(400)])
    assert trustworthiness(v, y, 10) >= 0.87
    if block == 4096:
        assert first == {r.vec_id: r.position for r in layout.graph_layout(df, dims=2).collect()}


def test_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 0.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.position for r in layout.graph_layout(df, dims=3).collect()} == {1: [0.0] * 3, 2: None, 3: None}
    assert layout.graph_layout(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)] + [(9, [])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.position for r in layout.graph_layout(same, dims=3, rounds=2).collect()}
    assert got[9] is None and all(np.isfinite(got[i]).all() and len(got[i]) == 3 for i in range(5))


def test_a_block_of_centers_gives_what_its_centers_give_one_by_one():
    rng = np.random.default_rng(5)
    n, k = 60, 4
    v = np.concatenate([rng.standard_normal((50, 6)), np.ones((10, 6))])
    ids = np.sort(rng.choice(10_000, n, replace=False)) - 5_000
    d = density.distances(v, v)
    lists = [rng.choice(np.delete(np.arange(n), a), k, replace=False) for a in range(n)]
    reach = np.array([d[a, x].max() for a, x in enumerate(lists)])
    center, member = np.repeat(np.arange(n), k + 1), np.concatenate([[*x, a] for a, x in enumerate(lists)])
    met = {(a, b) for c in range(n) for a in member[center == c] for b in member[center == c] if a != b and d[a, b] <= reach[a] and b not in lists[a]}
    want = {(ids[a], ids[b]) for a in range(n) for b in sorted((b for x, b in met if x == a), key=lambda b: (d[a, b], b))[:k]}
    known = (np.repeat(np.arange(n), k), np.concatenate([ids[x] for x in lists]), np.concatenate([d[a, x] for a, x in enumerate(lists)]))
    a, b, far = layout.introduced(ids, v, reach, known, np.concatenate([ids[center], ids[center[:9]]]), np.concatenate([ids[member], ids[member[:9]]]), k)
    assert set(zip(a, b)) == want and (far == d[np.searchsorted(ids, a), np.searchsorted(ids, b)]).all()
