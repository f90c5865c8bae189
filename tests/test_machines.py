"""Machines and forests fitted over all points, against plain solvers in one process."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators import graph, learn, machines


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    return np.concatenate([rng.normal(0, 1, (480, 4)), rng.normal(5, 0.5, (20, 4))])


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "dp_id long, x array<double>")


def onto(a, top):
    """The nearest point with entries from 0 to top that sum to 1."""
    lo, hi = a.min() - 1, a.max()
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(a - mid, 0, top).sum() > 1 else (lo, mid)
    return np.clip(a - lo, 0, top)


def kernel(x):
    width = 1 / (x.shape[1] * x.var())
    return np.exp(-width * ((x[:, None] - x[None]) ** 2).sum(-1))


def dual_of_one_class(k, nu, steps=6000):
    n, top = len(k), 1 / (nu * len(k))
    a = y = np.full(n, 1 / n)
    t, size = 1.0, np.linalg.norm(k, 2)
    for _ in range(steps):
        b, s = onto(y - k @ y / size, top), (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, a, t = b + (t - 1) / s * (b - a), b, s
    return -0.5 * a @ k @ a


@pytest.mark.parametrize("nu", [0.02, 0.5])
def test_one_class_reaches_the_least_loss(spark, cloud, nu):
    """Within 1 % of a plain solver of the dual over the whole kernel; the loss is counted anew from the scores."""
    p = frame(spark, cloud)
    m, k = machines.one_class(p, nu, landmarks=500), kernel(cloud)
    score = np.array([r.score for r in m.scores(p).orderBy("dp_id").collect()]) - m.zone
    w2 = m.weights @ machines._kernel(m.landmarks, m.landmarks, m.width) @ m.weights
    loss = 0.5 * w2 - m.rho + np.maximum(0, -score).sum() / (nu * len(cloud))
    assert loss == pytest.approx(m.objective, rel=1e-6)
    least = dual_of_one_class(k, nu)
    assert least - 1e-9 <= loss <= least + 0.01 * abs(least)
    assert np.mean(score + m.zone < 0) <= nu + 1e-9


def test_semi_supervised_meets_its_dual(spark, cloud):
    """No dual point found by a plain ascent proves more than what the machine reaches, to 1 %; alarms lie outside."""
    p, k = frame(spark, cloud), kernel(cloud)
    y = np.zeros(500, int)
    y[:60], y[480:495] = 1, -1
    lab = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y) if v], "dp_id long, y int")
    m = machines.semi_supervised(p, lab, landmarks=500)
    score = np.array([r.score for r in m.scores(p).orderBy("dp_id").collect()]) - m.zone
    sign, known = np.where(y == 0, 1, y), y != 0
    w2 = m.weights @ machines._kernel(m.landmarks, m.landmarks, m.width) @ m.weights
    loss = 0.5 * w2 - m.rho - m.margin + np.maximum(0, known * m.margin - sign * score).sum()
    assert loss == pytest.approx(m.objective, rel=1e-6) and m.margin >= 0
    q = k * np.outer(sign, sign)
    # Ascent on the dual with a multiplier for each of its two constraints (augmented Lagrangian).
    a, l1, l2, r, step = np.full(500, 1 / 500), 0.0, 0.0, 1.0, None
    step = 1 / (np.linalg.norm(q, 2) + r * 1000)
    for i in range(30000):
        e1, e2 = a @ sign - 1, max(0.0, 1 - a[known].sum() + l2 / r)
        a = np.clip(a - step * (q @ a + (l1 + r * e1) * sign - r * e2 * known), 0, 1)
        if i % 100 == 99:
            l1, l2 = l1 + r * (a @ sign - 1), max(0.0, l2 + r * (1 - a[known].sum()))
    assert abs(a @ sign - 1) < 1e-3 and a[known].sum() > 1 - 1e-3
    assert loss == pytest.approx(-0.5 * a @ q @ a, rel=0.02)
    assert score[480:495].max() < score[:60].min()
    assert {r.dp_id for r in learn.ssad(p, lab).orderBy("score").limit(20).collect()} == set(range(480, 500))


def test_all_rows_take_part(spark, cloud):
    """Rows beyond the landmarks move the fit; repeated rows weigh; the partitioning doesn't matter; few landmarks come near."""
    p = frame(spark, cloud)
    few = machines.one_class(p, 0.1, landmarks=60)
    assert len(few.landmarks) == 60 and few.objective <= 0
    again = machines.one_class(p.repartition(7), 0.1, landmarks=60)
    assert again.objective == pytest.approx(few.objective, rel=1e-6) and (again.landmarks == few.landmarks).all()
    twice = machines.one_class(p.unionAll(p), 0.1, landmarks=60)
    assert twice.objective == pytest.approx(few.objective, rel=1e-6)
    moved = p.unionAll(p.filter("dp_id >= 480").crossJoin(spark.range(40)).select("dp_id", "x"))
    assert abs(machines.one_class(moved, 0.1, landmarks=60, width=few.width).rho - few.rho) > 0.01
    assert np.mean([r.score < 0 for r in few.scores(p).collect()]) == pytest.approx(0.1, abs=0.03)


def test_sums_in_two_levels(spark, cloud, monkeypatch):
    p = frame(spark, cloud)
    plain = machines.one_class(p, 0.2, landmarks=40)
    monkeypatch.setattr(machines, "GROUPS", 1)
    assert machines.one_class(p, 0.2, landmarks=40).objective == pytest.approx(plain.objective, rel=1e-9)


def test_cases_of_machines(spark):
    none = spark.createDataFrame([], "dp_id long, x array<double>")
    assert machines.one_class(none) is None
    odd = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.5, 1.0]), (3, None), (4, [float("nan"), 0.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0])], "dp_id long, x array<double>")
    assert {r.dp_id for r in learn.one_class(odd, nu=0.5).collect()} == {1, 2} == {r.dp_id for r in learn.isolation_forest(odd).collect()}
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "dp_id long, x array<double>")
    assert learn.one_class(same, nu=0.5).count() == 5
    assert machines.semi_supervised(odd, spark.createDataFrame([], "dp_id long, y int")).margin == 0
    # Labelled both ways: an alarm, once.
    both = spark.createDataFrame([(1, 1), (1, -1), (2, 1)], "dp_id long, y int")
    scores = {r.dp_id: r.score for r in learn.ssad(odd, both).collect()}
    assert len(scores) == 2 and scores[1] < scores[2]
    wide = odd.select("dp_id", "x", F.lit(1).alias("n"), F.lit(2).alias("sign"), F.lit(3).alias("luck"), F.lit(4).alias("tree"))
    assert learn.one_class(wide, nu=0.5).count() == learn.isolation_forest(wide).count() == 2


def test_dual_machines(spark, cloud):
    p = frame(spark, cloud)
    lab = spark.createDataFrame([(i, i >= 480) for i in [*range(40), *range(480, 490)]], "dp_id long, is_alarm boolean")
    got = {r.dp_id: r for r in learn.dual_one_class(p, lab).collect()}
    assert len(got) == 500 and all(got[i].target == -1 for i in range(480, 500)) and all(r.aggregate == r.target * r.outlier for r in got.values())
    assert sum(got[i].target == 1 for i in range(40)) > 30


def test_forest_from_all_points(spark):
    """Trees draw from all rows, whatever their number; the contaminated share lies below 0, and scattered rows lie lowest."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (5000, 3)), rng.normal(0, 12, (50, 3))])
    p = frame(spark, x)
    got = {r.dp_id: r.score for r in learn.isolation_forest(p).collect()}
    assert len(got) == 5050 and np.mean([s < 0 for s in got.values()]) == pytest.approx(0.01, abs=0.002)
    lowest = sorted(got, key=got.get)[:30]
    assert np.mean([i >= 5000 for i in lowest]) > 0.9
    again = {r.dp_id: r.score for r in learn.isolation_forest(p.repartition(5)).collect()}
    assert again == pytest.approx(got)


def test_classifiers_after_an_observation(spark, cloud):
    """A session that has observed a count can't be serialized; the classifiers don't send it."""
    assert graph.written_with_count(spark.range(3).toDF("a"), graph.shared_folder(spark, "observed")) == 3
    p = frame(spark, cloud)
    lab = spark.createDataFrame([(i, i >= 480) for i in [*range(40), *range(480, 490)]], "dp_id long, is_alarm boolean")
    pred = {r.dp_id: r.pred for r in learn.svc(p, lab).collect()}
    told = [*range(40), *range(480, 490)]
    assert len(pred) == 500 and set(pred.values()) <= {-1, 1} and np.mean([(pred[i] == -1) == (i >= 480) for i in told]) > 0.7
    unsure = [r.margin for r in learn.uncertain(p, lab).collect()]
    assert len(unsure) == 450 and unsure == sorted(unsure) and unsure[0] >= 0
