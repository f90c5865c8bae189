"""Distances of all pairs, in blocks, against plain ones in one process."""

import numpy as np
import pytest

from tracelode.operators import graph, vectors


@pytest.fixture(scope="module")
def many():
    """More rows than a block has, some of them copies, some close, far from the origin."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (2300, 3)) + 1000
    return np.concatenate([x, x[:100], x[100:200] + 1e-7])


@pytest.fixture(scope="module")
def points(spark, many):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(many)], "dp_id long, x array<double>").repartition(4).cache()


def plain(x):
    out = np.zeros((len(x), len(x)))
    for k in range(x.shape[1]):
        out += (x[:, k, None] - x[None, :, k]) ** 2
    return out


def test_nearest_by_products_is_exact(points, many):
    d = plain(many)
    rough = vectors.rough_distances2(many[:300], many)[0]
    assert np.abs(rough - d[:300]).max() < 1e-10 and np.allclose(vectors.distances2(many, many), d, rtol=1e-9, atol=0)
    np.fill_diagonal(d, np.inf)
    got = {r.dp_id: (r.other, r.distance) for r in vectors.nearest(points, points).collect()}
    assert {i: o for i, (o, _) in got.items()} == dict(enumerate(d.argmin(axis=1).tolist()))
    assert [got[i][1] for i in range(len(d))] == pytest.approx(np.sqrt(d.min(axis=1)), rel=1e-12)


def test_each_pair_meets_once(points, many):
    got = vectors.mean_distance(points).first()
    i, j = np.triu_indices(len(many), 1)
    assert got.n_pairs == len(i) and got.mean_distance == pytest.approx(np.sqrt(plain(many)[i, j]).mean(), rel=1e-12)
    met = vectors.in_blocks(points, points, lambda a, x, b, y: a[["chunk", "block"]].drop_duplicates().rename(columns={"chunk": "c", "block": "d"}), "c int, d int", half=True)
    assert sorted(map(tuple, met.collect())) == [(0, 0), (0, 1), (1, 1)]


def test_bandwidths_from_half_of_the_blocks(points, many, monkeypatch):
    halves, plan = [], vectors.in_blocks
    monkeypatch.setattr(vectors, "in_blocks", lambda *a, **b: halves.append(b.get("half")) or plan(*a, **b))
    got = {r.bandwidth: r.fitness for r in vectors.bandwidths(points, [0.05, 0.5]).collect()}
    d, fold = plain(many), np.arange(len(many)) % 5
    other = fold[:, None] != fold
    for h in (0.05, 0.5):
        mean = np.maximum((np.exp(-d / (2 * h * h)) * other).sum(axis=1) / other.sum(axis=1), 1e-300)
        assert got[h] == pytest.approx((np.log(mean) - 3 * np.log(h * np.sqrt(2 * np.pi))).sum(), rel=1e-9)
    assert halves == [True]


def test_neighbours_of_clusters_are_measured_once(points, monkeypatch):
    names, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: names.append(name) or write(df, name))
    found = vectors.neighbour_clusters(points)
    assert names.count("nearest") == 1 and found.count() == 2500
