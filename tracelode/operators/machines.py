"""One-class and semi-supervised machines with an rbf kernel, fitted over all points on the cluster.

The kernel is that of LANDMARKS points (Nyström): they bound what a model holds, not what it learns from. Every point takes part in every step of the fit: tasks
sum value, gradient and curvature of the loss over their rows, the sums are added up in two levels, and the driver solves one system of LANDMARKS + 2 unknowns. Where
there are no more different points than landmarks the kernel is exact. A fit ends with the gap between its loss and what duality proves to be the least possible.

Defined cases: points whose vector is null, or holds null or non-finite components, take no part and get no score. Equal vectors are one row with a weight, so repeated rows each
count. Without points a fit is None. A point labelled both ways is an alarm. All vectors have one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

#: Points that span the kernel's space.
LANDMARKS = 256
#: Groups in which the sums of tasks are added up first, where there are more tasks than this.
GROUPS = 64
#: By how much each step of a line search is shorter than the one before, and how many there are.
SHORTER, LENGTHS = 0.7, 40
#: By how much each zone is narrower than the one before.
NARROWER = 3


@dataclass
class Machine:
    """A fitted machine: f(x) = sum of weights times kernels with the landmarks; objective: its loss with hinges; gap: how far that may be from the least one.

    Points on the edge, which hold the region up, are met to within the zone.
    """

    landmarks: np.ndarray
    weights: np.ndarray
    rho: float
    margin: float
    width: float
    zone: float
    objective: float
    gap: float

    def scores(self, points: DataFrame) -> DataFrame:
        """dp_id, score: f(x) - rho + zone, below 0 outside of the region; so points on its edge are inside, and of a one-class machine at most the share nu is outside."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                s = _kernel(np.stack(b["x"].to_numpy()).astype(float), self.landmarks, self.width) @ self.weights - self.rho + self.zone if len(b) else []
                yield pd.DataFrame({"dp_id": b["dp_id"], "score": s})

        return usable(points).select("dp_id", "x").mapInPandas(run, "dp_id long, score double")


def usable(points: DataFrame) -> DataFrame:
    """Points with a vector of finite components."""
    return points.filter(F.col("x").isNotNull() & F.forall("x", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False))))


def _kernel(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    return np.exp(-width * ((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T).clip(0))


def one_class(points: DataFrame, nu: float = 0.01, landmarks: int = LANDMARKS, width: float | None = None, tolerance: float = 5e-3) -> Machine | None:
    """The one-class machine: least of |w|^2 / 2 - rho + sum of max(0, rho - f(x)) / (nu n) over all n points."""
    rows = usable(points).select("x", F.lit(1).alias("sign"), F.lit(0).alias("known"))
    return _fitted(rows, lambda n: (1 / (nu * n), 0.0, 0.0), 0.0, landmarks, width, tolerance)


def semi_supervised(points: DataFrame, labeled: DataFrame, kappa: float = 1.0, cp: float = 1.0, cu: float = 1.0, cn: float = 1.0, landmarks: int = LANDMARKS, width: float | None = None, tolerance: float = 5e-3) -> Machine | None:
    """The convex semi-supervised machine: alarms (y = -1) are pushed out of the region and others (y = 1) into it by a margin of their own; labeled: dp_id, y.

    Least of |w|^2 / 2 - rho - kappa * margin + the costs (cu for what isn't labelled, cp and cn for y = 1 and -1) times the hinges of f(x) >= rho
    and y f(x) >= y rho + margin, with margin >= 0. Without labels kappa is 0.
    """
    y = labeled.filter("y <> 0").groupBy("dp_id").agg(F.min("y").alias("y"))
    rows = usable(points).join(y, "dp_id", "left").select("x", F.when(F.col("y") < 0, -1).otherwise(1).alias("sign"), F.col("y").isNotNull().cast("int").alias("known"))
    return _fitted(rows, lambda n: (cu, cp, cn), kappa, landmarks, width, tolerance)


def _fitted(rows: DataFrame, costs, kappa: float, landmarks: int, width: float | None, tolerance: float) -> Machine | None:
    spark, path = rows.sparkSession, graph.shared_folder(rows.sparkSession, "machine")
    rows.groupBy("x", "sign", "known").agg(F.count("*").alias("n")).write.parquet(path)
    rows = spark.read.parquet(path)
    try:
        size, total = F.size("x"), lambda f: F.aggregate("x", F.lit(0.0), lambda s, e: s + f(e.cast("double")))
        seen = rows.agg(
            F.sum("n").alias("n"), F.coalesce(F.sum(F.col("n") * F.col("known")), F.lit(0)).alias("known"), F.sum(F.col("n") * size).alias("m"),
            F.sum(F.col("n") * total(lambda e: e)).alias("s"), F.sum(F.col("n") * total(lambda e: e * e)).alias("q"), F.max(size).alias("d"),
        ).first()
        if not seen["n"]:
            return None
        spread = seen["q"] / max(seen["m"], 1) - (seen["s"] / max(seen["m"], 1)) ** 2
        width = width or 1 / max((seen["d"] or 1) * spread, 1e-12)
        plain, fine, alarm = costs(seen["n"])
        cost = F.when(F.col("known") == 0, plain).when(F.col("sign") > 0, fine).otherwise(alarm).cast("double")
        rows = rows.select("x", "sign", "known", (cost * F.col("n")).alias("cost"))
        return _newton(rows, _landmarks(rows, landmarks), width, kappa if seen["known"] else 0.0, tolerance)
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _landmarks(rows: DataFrame, most: int) -> np.ndarray:
    """Different points, least by hash; up to half of them labelled."""
    least = lambda df, n: [r["x"] for r in df.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(n).collect()]
    told = least(rows.filter("known = 1"), most // 2)
    found = {tuple(x) for x in told}
    others = [x for x in least(rows, most) if tuple(x) not in found]
    return np.array(told + others[: most - len(told)], float)


def _newton(rows: DataFrame, marks: np.ndarray, width: float, kappa: float, tolerance: float) -> Machine:
    """Newton's method on hinges rounded over a zone that gets narrower until the gap is within the tolerance; unknowns: w, rho, margin."""
    values, vectors = np.linalg.eigh(_kernel(marks, marks, width))
    good = values > values.max() * 1e-10
    to_space = vectors[:, good] / np.sqrt(values[good])
    m = int(good.sum())
    linear = np.concatenate([np.zeros(m), [-1.0, -kappa]])
    flat = np.concatenate([np.ones(m), [0.0, 0.0]])
    tasks = rows.rdd.getNumPartitions()

    def at(v: np.ndarray, d: np.ndarray, lengths: np.ndarray, zone: float):
        """Rounded and plain loss at v + length * d for each length; at the first gradient, curvature, and what rows within the zone give to the gradient."""
        got = _sums(rows, tasks, marks, width, to_space, v, d, lengths, zone)
        k, p = len(lengths), m + 2
        own = np.array([0.5 * (flat * u * u).sum() + linear @ u for u in (_moved(v, d, s) for s in lengths)])
        edge, slope, bent = got[2 * k : 2 * k + p], got[2 * k + p : 2 * k + 2 * p], got[2 * k + 2 * p :].reshape(p, p)
        return own + got[:k], own + got[k : 2 * k], flat * _moved(v, d, lengths[0]) + linear + slope, np.diag(flat) + bent, edge

    def step(v: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        free = np.ones(m + 2, bool)
        free[-1] = kappa > 0 and (v[-1] > 0 or g[-1] < 0)
        damp = np.concatenate([np.zeros(m), np.full(2, 1e-9 + 1e-2 * np.abs(g[free]).max())])
        d = np.zeros(m + 2)
        d[free] = -np.linalg.solve((h + np.diag(damp))[np.ix_(free, free)], g[free])
        return d

    def went(v: np.ndarray, d: np.ndarray, i: int, found, zone: float):
        """The point reached by the length chosen, and what is known there."""
        u = _moved(v, d, lengths[i])
        return u, found[0][i], found[1][i], *(found[2:] if i == 0 else at(u, np.zeros_like(u), np.ones(1), zone)[2:])

    v, zone, lengths = np.zeros(m + 2), 1.0, np.append(SHORTER ** np.arange(LENGTHS), 0.0)
    v, f, plain, g, h, edge = went(v, np.zeros_like(v), 0, at(v, np.zeros_like(v), lengths, zone), zone)
    while True:
        for _ in range(60):
            d = step(v, g, h)
            if -(g @ d) < 0.1 * tolerance * max(abs(plain), 1e-9):
                break
            found = at(v, d, lengths, zone)
            enough = np.flatnonzero(found[0][:-1] <= f + 1e-4 * lengths[:-1] * (g @ d))
            if not len(enough):
                break
            v, f, plain, g, h, edge = went(v, d, int(found[0].argmin()), found, zone)
        # At the rounded optimum the slopes of the hinges are feasible for the dual, whose value is -|w|^2 / 2.
        gap = plain + 0.5 * (v[:m] @ v[:m])
        if gap <= tolerance * max(abs(plain), 1e-9) or zone < 1e-9:
            return Machine(marks, to_space @ v[:m], float(v[m]), float(v[m + 1]), width, zone, float(plain), float(gap))
        # In a narrower zone the rows on the edge keep their slopes if they come nearer by as much.
        d = step(v, g + (NARROWER - 1) * edge, np.diag(flat) + (h - np.diag(flat)) * NARROWER)
        zone /= NARROWER
        found = at(v, d, lengths, zone)
        v, f, plain, g, h, edge = went(v, d, int(found[0].argmin()), found, zone)


def _moved(v: np.ndarray, d: np.ndarray, length: float) -> np.ndarray:
    out = v + length * d
    out[-1] = max(out[-1], 0.0)
    return out


def _sums(rows: DataFrame, tasks: int, marks: np.ndarray, width: float, to_space: np.ndarray, v: np.ndarray, d: np.ndarray, lengths: np.ndarray, zone: float) -> np.ndarray:
    """Over all rows: rounded and plain hinges for each length, then at the first what rows within the zone give to the gradient, and gradient and curvature of the rounded ones; a row of sums leaves each task."""
    moved = np.stack([_moved(v, d, s) for s in lengths], axis=1)
    p = len(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        out, some = np.zeros(2 * len(lengths) + 2 * p + p * p), False
        for b in batches:
            if not len(b):
                continue
            some = True
            z = _kernel(np.stack(b["x"].to_numpy()).astype(float), marks, width) @ to_space
            sign, cost = b["sign"].to_numpy(float), b["cost"].to_numpy(float)
            a = np.column_stack([-sign[:, None] * z, sign, b["known"].to_numpy(float)])
            over = (a @ moved).clip(0)
            within = np.minimum(over, zone)
            soft = within**2 / (2 * zone) + over - within
            inside = (a @ moved[:, 0] >= 0) & (over[:, 0] < zone)
            slope, bent = cost * within[:, 0] / zone, cost * inside / zone
            out += np.concatenate([cost @ soft, cost @ over, (slope * inside) @ a, slope @ a, ((a * bent[:, None]).T @ a).ravel()])
        if some:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [out.tobytes()]})

    def added(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("part")
        return pd.DataFrame({"part": found["part"].iloc[:1], "sums": [sum(np.frombuffer(s) for s in found["sums"]).tobytes()]})

    parts = rows.mapInPandas(run, "part int, sums binary")
    if tasks > GROUPS:
        parts = parts.groupBy(F.col("part") % GROUPS).applyInPandas(added, "part int, sums binary")
    return sum(np.frombuffer(r["sums"]) for r in sorted(parts.collect(), key=lambda r: r["part"]))
