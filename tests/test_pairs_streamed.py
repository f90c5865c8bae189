"""Chunks of vectors that meet each other: written once, streamed pair by pair, and put together by the task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelode.operators import graph, vectors


@pytest.fixture
def written(monkeypatch):
    """Names and plans of what is written."""
    seen, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: seen.append((name, df)) or write(df, name))
    return seen


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(8)
    return np.concatenate([rng.normal(0, 1, (380, 3)), np.full((20, 3), 0.1), rng.integers(0, 3, (100, 3))])


@pytest.fixture(scope="module")
def points(spark, some):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(some)] + [(999, None)], "dp_id long, x array<double>").repartition(3).cache()


def small_blocks(monkeypatch):
    plan = vectors.in_blocks
    monkeypatch.setattr(vectors, "in_blocks", lambda *a, **k: plan(*a, **(k | {"size": 20})))


def all_pairs(x):
    return ((x[:, None] - x[None]) ** 2).sum(-1)


def test_vectors_are_written_once_and_rows_put_together(points, some, written, monkeypatch):
    """25 chunks: neither vectors nor what is made of them is copied for each block."""
    small_blocks(monkeypatch)
    got = {r.dp_id: (r.other, r.distance) for r in vectors.nearest(points, points).collect()}
    d = all_pairs(some)
    np.fill_diagonal(d, np.inf)
    assert {i: o for i, (o, _) in got.items()} == dict(enumerate(d.argmin(axis=1).tolist()))
    assert [got[i][1] for i in range(len(d))] == pytest.approx(np.sqrt(d.min(axis=1)), rel=1e-12)
    chunks = [df for name, df in written if name == "chunks"]
    met = [df for name, df in written if name == "met"]
    assert [df.count() for df in chunks] == [25] and sum(r.n for df in chunks for r in df.select(F.octet_length("packed").alias("n")).collect()) < 500 * 40 + 25 * 2000
    plan = met[0]._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    assert met[0].count() <= 500 * 25 // 4


def test_bandwidths_are_put_together_by_the_task(points, some, written, monkeypatch):
    small_blocks(monkeypatch)
    got = {r.bandwidth: r.fitness for r in vectors.bandwidths(points, [0.3, 1.0]).collect()}
    d, fold = all_pairs(some), np.arange(500) % 5
    other = fold[:, None] != fold
    for h in (0.3, 1.0):
        mean = np.maximum((np.exp(-d / (2 * h * h)) * other).sum(axis=1) / other.sum(axis=1), 1e-300)
        assert got[h] == pytest.approx((np.log(mean) - 3 * np.log(h * np.sqrt(2 * np.pi))).sum(), rel=1e-9)
    assert [name for name, _ in written] == ["chunks", "met"]
    assert written[1][1].count() <= 500 * 2 * 25 // 2  # a row for each pair of blocks would be 500 * 2 * 26


@pytest.mark.parametrize("sides", [(500, 1), (3, 500)])
def test_points_meet_others_of_another_number(points, some, sides, monkeypatch):
    """Every point with each of the others once, however few there are, and rows merged more than once."""
    monkeypatch.setattr(vectors, "MERGED", 30)
    a, b = (points.filter(F.col("dp_id") < n) for n in sides)
    got = vectors.in_blocks(a, b, lambda a, x, b, y: pd.DataFrame({"dp_id": a["dp_id"], "s": vectors.distances2(x, y).sum(axis=1), "n": len(y)}), "dp_id long, s double, n long", size=20, merged=vectors._sums)
    rows = {r.dp_id: (r.s, r.n) for r in got.groupBy("dp_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    d = ((some[: sides[0], None] - some[None, : sides[1]]) ** 2).sum(-1)
    assert {i: n for i, (_, n) in rows.items()} == dict.fromkeys(range(sides[0]), sides[1])
    assert [rows[i][0] for i in range(sides[0])] == pytest.approx(d.sum(axis=1), rel=1e-9)


def test_vectors_of_different_lengths_are_an_error(spark):
    uneven = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0])], "dp_id long, x array<double>")
    with pytest.raises(Exception, match="different lengths"):
        vectors.nearest(uneven, uneven).collect()
