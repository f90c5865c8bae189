"""Feedback by batches: each label moves the scores of all datapoints, and sums of batches add up in any order. ``state`` keeps the same sums in a state store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import vectors


def contribution(points: DataFrame, labeled: DataFrame, bandwidth: float) -> DataFrame:
    """dp_id, pos, neg: sums of kernels over the labels (dp_id, is_alarm) of one batch, and how many they are (n, m); points and labels meet in blocks."""
    lab = labeled.join(points.select("dp_id", "x"), "dp_id").filter("x is not null")
    count = lab.agg(F.count_if("is_alarm").alias("n"), F.count_if(~F.col("is_alarm")).alias("m")).first()
    sums = vectors.kde_sums(points, lab, bandwidth)
    return sums.select("dp_id", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("pos", "neg")], *[F.lit(count[x]).cast("long").alias(x) for x in ("n", "m")])


def merge(state: DataFrame | None, more: DataFrame) -> DataFrame:
    """The sums of two states; addition makes the order of batches irrelevant."""
    both = more if state is None else state.unionByName(more)
    return both.groupBy("dp_id").agg(*[F.sum(x).alias(x) for x in ("pos", "neg", "n", "m")])


def scores(state: DataFrame) -> DataFrame:
    mean = lambda s, n: F.when(F.col(n) > 0, F.col(s) / F.col(n)).otherwise(0.0)
    return state.select("dp_id", (mean("pos", "n") - mean("neg", "m")).alias("score"))
