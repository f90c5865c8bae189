"""Evaluation of alarms: curves, areas, confusion and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


RANGE = 1 << 16


def running(rows: DataFrame, at: str, sums: dict[str, Column], width: int = RANGE) -> DataFrame:
    """rows with running sums (name: what is summed) in order of the whole number ``at``, null first.

    Each range of ``width`` numbers is summed by itself; what lies before it is a sum over ranges, of which there is one row each. Equal numbers share a sum.
    """
    rows = rows.withColumn("_range", F.floor(F.col(at) / width))
    per = rows.groupBy("_range").agg(*[F.sum(x).alias(f"_{k}") for k, x in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("_range", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0).cast("long")).alias(f"_before_{k}") for k in sums])
    both = rows.join(before, rows["_range"].eqNullSafe(before["_range"])).drop(before["_range"])
    within = Window.partitionBy("_range").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    out = both.select("*", *[(F.sum(x).over(within) + F.col(f"_before_{k}")).alias(k) for k, x in sums.items()])
    return out.drop("_range", *[f"_before_{k}" for k in sums])


def curve(feedback: DataFrame) -> DataFrame:
    """attempt, tp, fp: running counts over the attempts of an experiment.

    The curve starts with a point without true positives, which counts as a false one.
    """
    hit = F.col("is_alarm").cast("int")
    points = running(feedback, "attempt", {"tp": hit, "_fp": 1 - hit}).select("attempt", "tp", (F.col("_fp") + 1).alias("fp"))
    first = feedback.sparkSession.range(1).select(F.lit(0).alias("attempt"), F.lit(0).cast("long").alias("tp"), F.lit(1).cast("long").alias("fp"))
    return first.unionAll(points)


def auc(feedback: DataFrame) -> DataFrame:
    """The sum of tp at steps that add a false positive, over the product of the final counts; 0 if either is 0."""
    hit = F.col("is_alarm").cast("int")
    steps = running(feedback, "attempt", {"tp": hit})
    total = steps.agg(F.coalesce(F.sum(F.when(hit == 0, F.col("tp"))), F.lit(0).cast("long")).alias("s"), F.coalesce(F.sum(hit), F.lit(0).cast("long")).alias("tp"), (F.count_if(hit == 0) + 1).alias("fp"))
    return total.select(F.when(F.col("tp") * F.col("fp") > 0, F.col("s") / (F.col("tp") * F.col("fp"))).otherwise(0.0).alias("auc"), "tp", "fp")


def confusion(predictions: DataFrame) -> DataFrame:
    """tp, tn, fp, fn; predictions: pred (below 0: alarm) and is_alarm."""
    p, a = F.col("pred") < 0, F.col("is_alarm")
    return predictions.agg(F.count_if(p & a).alias("tp"), F.count_if(~p & ~a).alias("tn"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg(((F.col("pred") < 0) == F.col("is_alarm")).cast("int")).alias("accuracy"))


def brief(alarms: DataFrame) -> DataFrame:
    """bc, slice_id, num_traces, score_avg: alarms summed up by slice, lowest average first."""
    return alarms.groupBy("bc", "slice_id").agg(F.count("*").alias("num_traces"), F.avg("score").alias("score_avg")).orderBy("score_avg", "bc", "slice_id")


def steps(feedback: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Labelled points and mean seconds of a step, in all or for each value of ``by``; feedback: attempt, ts. The gaps between neighbours add up to the last time less the first."""
    micros = F.unix_micros("ts")
    n = F.count("*")
    return feedback.groupBy(*by).agg(n.alias("n_labeled"), ((F.max_by(micros, "attempt") - F.min_by(micros, "attempt")) / F.nullif(n - 1, F.lit(0)) / 1e6).alias("mean_seconds"))


def at_counts(ranked: DataFrame, counts: list[int]) -> DataFrame:
    """count, hits: how many of the first ``count`` rows by rank (from 1) are alarms, for each of the counts."""
    asked = F.explode(F.array(*map(F.lit, counts)))
    return ranked.select("rank", "is_alarm", asked.alias("count")).filter(F.col("rank") <= F.col("count")).groupBy("count").agg(F.count_if("is_alarm").alias("hits"))
