"""Labels of datapoints, kept as arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add(labels: Column, label: str) -> Column:
    return F.array_union(F.coalesce(labels, F.array().cast("array<string>")), F.array(F.lit(label)))


def erase(labels: Column, label: str) -> Column:
    return F.array_remove(F.coalesce(labels, F.array().cast("array<string>")), label)


def has(labels: Column, part: str | None = None) -> Column:
    """Any label contains the substring; without one, there is a label."""
    found = F.size(labels) > 0 if part is None else F.exists(labels, lambda x: x.contains(part))
    return F.coalesce(found, F.lit(False))


def alarms(labels: Column) -> Column:
    return F.filter(labels, lambda x: x.contains("alarm"))


def relabel(table: DataFrame, key: list[str], chosen: DataFrame, label: str, erase_it: bool = False) -> DataFrame:
    """table with the label added to, or erased from, the labels of the chosen keys."""
    mark = chosen.select(*key).distinct().withColumn("_chosen", F.lit(True))
    new = erase(F.col("labels"), label) if erase_it else add(F.col("labels"), label)
    return table.join(mark, key, "left").withColumn("labels", F.when(F.col("_chosen"), new).otherwise(F.col("labels"))).drop("_chosen")


def id_sets(labeled: DataFrame) -> DataFrame:
    """For each target and slice the set of its labelled traces."""
    return labeled.groupBy("target", "bc", "slice_id").agg(F.sort_array(F.collect_set("trace_id")).alias("traces"))
