"""Learners that have no counterpart in MLlib. All points take part in every fit; what the driver holds is a model of bounded size.

The machines are those of ``machines``, fitted over all points; the trees of an isolation forest grow in tasks, from rows drawn of all points;
``mcmc_mask`` counts all rows.

Defined cases: without points a result is empty (an entropy is null, a mask empty); without anything to fit on scores are 0, and a classifier
that was given one class only answers with it. Repeated rows each count and get a row. Points without vector take no part and get none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import machines


def scored(points: DataFrame, score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """dp_id and score of each point."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"dp_id": b["dp_id"], "score": score(np.stack(b["x"].to_numpy()).astype(float)) if len(b) else []})

    return machines.usable(points).select("dp_id", "x").mapInPandas(run, "dp_id long, score double")


def isolation_forest(points: DataFrame, trees: int = 100, size: int = 256, contamination: float = 0.01, seed: int = 0) -> DataFrame:
    """dp_id, score: below 0 for about the contaminated share, by depth at which random cuts isolate a point.

    Each tree grows in a task of its own, from the ``size`` points that a hash of tree and dp_id puts first among all; a row is sent to a tree only if that hash is low enough to have a
    chance. The trees, at most 2 * size nodes each, are all that the driver sees. The threshold is an approximate quantile of the scores of all points (to 0.01 % of ranks).
    """
    rows = machines.usable(points).select("dp_id", "x")
    n = rows.count()
    if not n:
        return _unfitted(points)
    share = min(1.0, (4 * size + 64) / n)
    luck = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col("dp_id")), F.lit(1 << 40)) / (1 << 40)
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), luck(t).alias("luck"))), lambda p: p["luck"] <= share)
    drawn = rows.select("dp_id", "x", F.inline(drawn))
    depth_limit = int(np.ceil(np.log2(max(min(size, n), 2))))

    def grown(found: pd.DataFrame) -> pd.DataFrame:
        tree = int(found["tree"].iloc[0])
        found = found.assign(x=found["x"].map(tuple)).sort_values(["luck", "dp_id", "x"])[:size]
        x, rng = np.array(found["x"].tolist(), float), np.random.default_rng([seed, tree])
        nodes, waiting = [[-1, 0.0, 0, 0, len(x)]], [(0, np.arange(len(x)), 0)]
        while waiting:
            at, of, depth = waiting.pop()
            spread = np.flatnonzero(np.ptp(x[of], axis=0) > 0) if len(of) > 1 and depth < depth_limit else []
            if not len(spread):
                continue
            f = int(rng.choice(spread))
            cut = rng.uniform(x[of, f].min(), x[of, f].max())
            left = x[of, f] < cut
            nodes[at][:4] = f, cut, len(nodes), len(nodes) + 1
            for side in (of[left], of[~left]):
                waiting.append((len(nodes), side, depth + 1))
                nodes.append([-1, 0.0, 0, 0, len(side)])
        out = pd.DataFrame(nodes, columns=["feature", "cut", "low", "high", "n"])
        return out.assign(tree=tree, node=range(len(nodes)))

    nodes = drawn.groupBy("tree").applyInPandas(grown, "feature int, cut double, low int, high int, n int, tree int, node int").toPandas()
    forest = [g.sort_values("node")[["feature", "cut", "low", "high", "n"]].to_numpy().T for _, g in nodes.groupby("tree")]

    def mean(n: np.ndarray) -> np.ndarray:
        return np.where(n > 1, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), 0.0)

    normal = max(float(mean(np.array(min(size, n)))), 1e-9)

    def raw(x: np.ndarray) -> np.ndarray:
        depths, every = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, low, high, count in forest:
            at = np.zeros(len(x), int)
            for _ in range(depth_limit):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                down = np.where(x[every, feature[at].astype(int).clip(0)] < cut[at], low[at], high[at]).astype(int)
                at, depths = np.where(inner, down, at), depths + inner
            depths += mean(count[at])
        return -(2 ** (-depths / len(forest) / normal))

    offset = scored(points, raw).agg(F.percentile_approx("score", contamination, 10000)).first()[0]
    return scored(points, lambda x: raw(x) - offset)


def _unfitted(points: DataFrame) -> DataFrame:
    return machines.usable(points).select("dp_id", F.lit(0.0).alias("score"))


def one_class(points: DataFrame, nu: float = 0.01, **options) -> DataFrame:
    """dp_id, score of a one-class support vector machine with an rbf kernel, fitted over all points (options: machines.one_class)."""
    machine = machines.one_class(points, nu, **options)
    return machine.scores(points) if machine else _unfitted(points)


def ssad(points: DataFrame, labeled: DataFrame, **options) -> DataFrame:
    """dp_id, score of semi-supervised anomaly detection over all points, labelled or not; labeled: dp_id, y, -1 for alarms and 1 for others (options: machines.semi_supervised)."""
    machine = machines.semi_supervised(points, labeled, **options)
    return machine.scores(points) if machine else _unfitted(points)


def random_features(points: DataFrame, features: int = 64, gamma: float = 0.5, seed: int = 0) -> DataFrame:
    """dp_id and z: random Fourier features, whose inner products approximate the rbf kernel, for linear learners."""
    dim = points.select(F.max(F.size("x")).alias("d")).first()["d"] or 1
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (dim, features)), rng.uniform(0, 2 * np.pi, features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            z = np.sqrt(2 / features) * np.cos(np.stack(p["x"].to_numpy()) @ w + b) if len(p) else []
            yield pd.DataFrame({"dp_id": p["dp_id"], "z": list(z)})

    return points.select("dp_id", "x").filter("x is not null").mapInPandas(run, "dp_id long, z array<double>")


def _one_label(train: DataFrame) -> int | None:
    """The label, if there aren't both (0 without rows), else None."""
    n = train.agg(F.count_if(F.col("label") == 1).alias("yes"), F.count_if(F.col("label") == 0).alias("no")).first()
    return None if n["yes"] and n["no"] else int(n["yes"] > 0)


def _margins(z: DataFrame, labeled: DataFrame) -> DataFrame | int:
    """dp_id, margin (above 0: alarm) of a linear machine fitted to the labelled rows of z (dp_id, z); where there is one class only, its label.

    The model's weights go into the plan as numbers. MLlib's own transform sends the model with its training summary and thereby the session, which can't be serialized once it has observed anything.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    train = z.join(labeled.select("dp_id", F.col("is_alarm").cast("double").alias("label")), "dp_id").select(array_to_vector("z").alias("features"), "label")
    if (only := _one_label(train)) is not None:
        return only
    model = LinearSVC(maxIter=50, regParam=0.01).fit(train)
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
    dot = F.aggregate(F.zip_with("z", weights, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    return z.select("dp_id", (dot + F.lit(float(model.intercept))).alias("margin"))


def svc(points: DataFrame, labeled: DataFrame, seed: int = 0) -> DataFrame:
    """dp_id, pred (-1 alarm, 1 not) of a support vector classifier with an approximate rbf kernel; labeled: dp_id, is_alarm."""
    margins = _margins(random_features(points, seed=seed), labeled)
    if isinstance(margins, int):
        return points.select("dp_id", F.lit(-1 if margins else 1).alias("pred"))
    return margins.select("dp_id", F.when(F.col("margin") > 0, -1).otherwise(1).alias("pred"))


def gmm_entropy(points: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """The entropy of the summed memberships of a Gaussian mixture."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = points.select(array_to_vector("x").alias("features"))
    if df.isEmpty():
        return df.sparkSession.createDataFrame([(None,)], "entropy double")
    out = GaussianMixture(k=k, seed=seed, maxIter=20).fit(df).transform(df).select(F.posexplode(vector_to_array("probability")).alias("c", "p")).groupBy("c").agg(F.sum("p").alias("n"))
    p = F.col("n") / F.col("t")
    return out.join(F.broadcast(out.agg(F.sum("n").alias("t")))).agg((-F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))).alias("entropy"))


def mcmc_mask(points: DataFrame, rounds: int = 50, groups: list[list[int]] | None = None, fixed: tuple[int, ...] = (), seed: int = 0) -> tuple[list[bool], float]:
    """A choice of features by a Markov chain: a flip of a feature or group is kept if it raises the fitness, or by chance. Groups that are fixed stay on.

    The fitness is the entropy of the chosen values, rounded to a tenth, over all rows, for each feature chosen. Executors count the
    distinct rows once; a choice then groups these, and only the entropy reaches the driver.
    """
    rng = np.random.default_rng(seed)
    width = points.select(F.max(F.size("x")).alias("d")).first()["d"] or 0
    groups = groups or [[i] for i in range(width)]
    if not width:
        return [], 0.0
    # Halves go to the even neighbour, as in numpy.
    distinct = points.select(F.transform("x", lambda v: F.rint(v * 10).cast("long")).alias("x")).groupBy("x").agg(F.count("*").alias("n")).persist()
    total = distinct.agg(F.sum("n")).first()[0] or 0
    known: dict[tuple[int, ...], float] = {}

    def fitness(on: np.ndarray) -> float:
        cols = [i for g, o in zip(groups, on, strict=True) if o for i in g]
        if not cols or not total:
            return 0.0
        if tuple(cols) not in known:
            p = F.sum("n") / F.lit(total)
            each = distinct.groupBy(F.array(*[F.get("x", F.lit(i)) for i in cols]).alias("k")).agg((-p * F.log(p)).alias("h"))
            known[tuple(cols)] = float(each.agg(F.sum("h")).first()[0]) / len(cols)
        return known[tuple(cols)]

    on = np.ones(len(groups), bool)
    now = best = fitness(on)
    kept = on.copy()
    for _ in range(rounds):
        trial, g = on.copy(), int(rng.integers(len(groups)))
        if g in fixed:
            continue
        trial[g] = ~trial[g]
        f = fitness(trial)
        if f / max(now, 1e-9) > rng.random():
            on, now = trial, f
            if now > best:
                best, kept = now, on.copy()
    distinct.unpersist()
    mask = np.zeros(width, bool)
    for g, o in zip(groups, kept, strict=True):
        mask[g] = o
    return mask.tolist(), best


def mask_entropies(points: DataFrame, masks: Sequence[Sequence[bool]]) -> DataFrame:
    """mask (its number), entropy: of the shares of points with equal values, rounded to a tenth, where a mask is on. All masks are counted in one job over the distinct rows; a mask that is off throughout has entropy 0. Points without vector are left out."""
    distinct = points.filter("x is not null").select(F.transform("x", lambda v: F.rint(v * 10).cast("long")).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    taken = [F.struct(F.lit(i).alias("mask"), F.array(*[F.get("x", F.lit(j)) for j, on in enumerate(m) if on]).cast("array<bigint>").alias("k")) for i, m in enumerate(masks)]
    per = distinct.select("n", F.explode(F.array(*taken)).alias("_m")).groupBy("_m.mask", "_m.k").agg(F.sum("n").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("mask"))
    return per.withColumn("_h", -p * F.log(p)).groupBy("mask").agg((F.sum("_h") + 0.0).alias("entropy"))


def chosen_groups(points: DataFrame, groups: Sequence[Sequence[int]], keep: int, rounds: int = 200, fixed: Sequence[int] = (), regulation: float | None = None, seed: int = 0, together: int = 16) -> tuple[list[bool], float]:
    """Which places of the vectors to keep, and the fitness: a Metropolis chain over choices of ``keep`` groups, each step swapping one for another.

    The fitness is one over the entropy (mask_entropies). A swap is taken if the ratio of the new fitness to the old is above a random number; where regulation is given and the new fitness
    isn't below it, the swap is taken whatever it is, but is no candidate for the best. Groups that are fixed stay. ``together`` swaps of the present choice are scored in one job: until one of them
    is taken the choice is the same, so the chain is that of one swap after the other.
    """
    rng, n = np.random.default_rng(seed), len(groups)
    width = max((i for g in groups for i in g), default=-1) + 1
    if keep > n or keep < len(set(fixed)):
        raise ValueError("as many groups as are fixed must be kept, and no more than there are")
    free = [g for g in range(n) if g not in fixed]
    now = frozenset(fixed) | frozenset(int(g) for g in rng.permutation(free)[: keep - len(set(fixed))])
    known: dict[frozenset[int], float] = {}

    def mask_of(choice: frozenset[int]) -> list[bool]:
        on = {i for g in choice for i in groups[g]}
        return [i in on for i in range(width)]

    def score(choices: list[frozenset[int]]) -> None:
        new = [c for c in dict.fromkeys(choices) if c not in known]
        if new:
            found = {r["mask"]: r["entropy"] for r in mask_entropies(points, [mask_of(c) for c in new]).collect()}
            known.update({c: 1 / max(found.get(i, 0.0), 1e-9) for i, c in enumerate(new)})

    score([now])
    best, at, step = now, known[now], 0
    while step < rounds:
        swaps = []
        for _ in range(min(together, rounds - step)):
            off, on = [g for g in range(n) if g not in now], [g for g in sorted(now) if g not in fixed]
            swaps.append((now if not off or not on else now - {on[int(rng.integers(len(on)))]} | {off[int(rng.integers(len(off)))]}, rng.random()))
        score([c for c, _ in swaps])
        for choice, luck in swaps:
            step += 1
            f = known[choice]
            if regulation is not None and f >= regulation:
                now, at = choice, f
                break
            if f / at > luck:
                now, at = choice, f
                if f > known[best]:
                    best = choice
                break
    return mask_of(best), known[best]


def random_order(points: DataFrame, seed: int = 0) -> DataFrame:
    """The baseline: datapoints in a seeded order."""
    return points.select("dp_id", (F.pmod(F.xxhash64(F.lit(seed), "dp_id"), F.lit(1 << 30)) / (1 << 30)).alias("score"))


def dual_one_class(points: DataFrame, labeled: DataFrame, how: str = "exp", **options) -> DataFrame:
    """dp_id, target, outlier (-1 or 1 by one machine on points labelled fine and one on alarms, 1 where there are none of a kind) and what the next question goes by: "exp" for their product, "sim" for how alike they are. labeled: dp_id, is_alarm."""

    def sign(hit: bool, nu: float, name: str) -> DataFrame:
        machine = machines.one_class(points.join(labeled.filter(F.col("is_alarm") == hit).select("dp_id"), "dp_id", "left_semi"), nu, **options)
        found = machine.scores(points) if machine else _unfitted(points)
        return found.select("dp_id", F.when(F.col("score") >= 0, 1).otherwise(-1).alias(name))

    both = sign(False, 0.1, "target").join(sign(True, 0.9, "outlier"), "dp_id")
    agg = F.col("target") * F.col("outlier") if how == "exp" else -F.abs(F.col("target") - F.col("outlier"))
    return both.withColumn("aggregate", agg)


def uncertain(points: DataFrame, labeled: DataFrame, seed: int = 0) -> DataFrame:
    """dp_id, margin: the points not labelled yet whose class the classifier is least sure of come first. labeled: dp_id, is_alarm."""
    margins, known = _margins(random_features(points, seed=seed), labeled), labeled.select("dp_id")
    if isinstance(margins, int):
        return points.join(known, "dp_id", "left_anti").select("dp_id", F.lit(0.0).alias("margin")).orderBy("dp_id")
    return margins.join(known, "dp_id", "left_anti").select("dp_id", F.abs("margin").alias("margin")).orderBy("margin", "dp_id")
