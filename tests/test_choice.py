"""Choice of features: masks scored together, and the chain over groups; counters that add up."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracelode.operators import dataflow, learn, vectors


def entropy(rows):
    n = Counter(rows)
    return -sum(c / len(rows) * math.log(c / len(rows)) for c in n.values())


def test_masks_are_scored_by_direct_counts(spark):
    rng = random.Random(0)
    rows = [[round(rng.choice([0.0, 0.1, 0.5]), 1) for _ in range(4)] for _ in range(200)]
    points = spark.createDataFrame([(i, x) for i, x in enumerate(rows)] + [(900, None)], "dp_id long, x array<double>")
    masks = [[bool(m >> j & 1) for j in range(4)] for m in range(16)]
    got = {r["mask"]: r["entropy"] for r in learn.mask_entropies(points, masks).collect()}
    assert got == pytest.approx({i: entropy([tuple(v for v, on in zip(x, m, strict=True) if on) for x in rows]) for i, m in enumerate(masks)})
    assert learn.mask_entropies(points.filter("dp_id < 0"), masks).count() == 0


def test_the_chain_over_groups(spark):
    rng = random.Random(1)
    rows = [[float(rng.randrange(9)), 0.0, float(rng.randrange(2)), 1.0, float(rng.randrange(3))] for _ in range(100)]
    points = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "dp_id long, x array<double>")
    groups = [[0], [1], [2], [3], [4]]
    mask, fitness = learn.chosen_groups(points, groups, keep=3, rounds=60, fixed=[0])
    assert mask == [True, True, False, True, False]  # the two constant ones join the fixed one
    assert fitness == pytest.approx(1 / entropy([x[0] for x in rows]))
    assert learn.chosen_groups(points, groups, keep=3, rounds=30, fixed=[0], together=1) == learn.chosen_groups(points, groups, keep=3, rounds=30, fixed=[0], together=1)
    never, _ = learn.chosen_groups(points, groups, keep=2, rounds=20, regulation=0.0)
    first, _ = learn.chosen_groups(points, groups, keep=2, rounds=0)
    assert never == first  # beyond the regulation swaps are taken but are no candidates
    with pytest.raises(ValueError, match="fixed"):
        learn.chosen_groups(points, groups, keep=0, fixed=[0])


def test_neighbour_clusters_against_all_pairs(spark):
    rng = random.Random(2)
    rows = {i: [rng.gauss(i % 3 * 4, 1), rng.gauss(0, 1)] for i in range(120)} | {500: [100.0, 100.0]}
    points = spark.createDataFrame([(i, x) for i, x in rows.items()] + [(600, None)], "dp_id long, x array<double>")
    for cut in (None, 0.3):
        links = []
        for i, x in rows.items():
            d, j = min((math.dist(x, y), j) for j, y in rows.items() if j != i)
            if cut is None or d <= cut:
                links.append((i, j))
        of = {i: i for i in rows}
        for _ in rows:
            for i, j in links:
                of[i] = of[j] = min(of[i], of[j])
        assert {r.dp_id: r.cluster for r in vectors.neighbour_clusters(points, cut).collect()} == of
        got = vectors.neighbour_cluster_entropy(points, cut).first()
        assert got.entropy == pytest.approx(entropy(list(of.values()))) and (got.n_clusters, got.n_points) == (len(set(of.values())), 121)
    assert vectors.neighbour_cluster_entropy(points.filter("dp_id < 0")).first().entropy is None


def test_counters_add_up(spark):
    from test_engine import TARGET, trace

    ret, call = {"op": "Ret"}, {"op": "Call", "func": "g"}
    shapes = [[TARGET, ret], [TARGET, ret], [call, ret], [TARGET, call, call, call, ret], [TARGET, {"op": "Unreachable"}], [TARGET, call], [TARGET, call, ret]]
    every = None
    for i, rows in enumerate(shapes):
        t = trace(spark, *rows, trace_id=i)
        every = t if every is None else every.unionAll(t)
    found = dataflow.trace_outcomes(every, most=4)
    assert [r.outcome for r in found.orderBy("trace_id").collect()] == ["proper", "duplicate", "no_target", "exceeding_length", "unreachable", "unfinished", "proper"]
    parts = [dataflow.outcome_counts(found.filter(F.col("trace_id") % 3 == i)) for i in range(3)]
    one = dataflow.merged_counts(parts).first().asDict()
    assert one == dataflow.outcome_counts(found).first().asDict() == dataflow.merged_counts([dataflow.merged_counts(parts[:2]), parts[2]]).first().asDict()
    assert one["explored"] == 7 and one["proper"] == 2
