"""Columns and tables that the older analysis had besides those of features and checkers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values as v
from ..sources.relations import KEY
from .features import any_, no, with_target


def context_columns(instrs: DataFrame) -> DataFrame:
    """key, has_other_retval_check, used_in_logical_formula, check_branch_taken, has_loop_after: optional columns of a trace."""
    rows = with_target(instrs)
    after = F.col("idx") > F.col("t")
    w = Window.partitionBy(*KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    mine = after & (F.col("op") == "ICmp") & no((F.col("op0") == F.col("r")) | (F.col("op1") == F.col("r")))
    others = F.collect_set(F.when(after & (F.col("op") == "Call"), F.col("res"))).over(w)
    checks = F.collect_set(F.when(mine, F.col("res"))).over(w)
    rows = rows.withColumn("mine", mine).withColumn("others", others).withColumn("checks", checks)
    other = after & (F.col("op") == "ICmp") & ~F.col("mine") & (F.array_contains("others", F.col("op0")) | F.array_contains("others", F.col("op1")))
    formula = after & (F.col("op") == "Bin") & (F.array_contains("checks", F.col("op0")) | F.array_contains("checks", F.col("op1")))
    taken = after & (F.col("op") == "CondBr") & F.array_contains("checks", F.col("cond"))
    return rows.groupBy(*KEY).agg(any_(other).alias("has_other_retval_check"), any_(formula).alias("used_in_logical_formula"), F.min_by(F.when(no(taken), F.col("br")), F.when(no(taken), F.col("idx"))).alias("check_branch_taken"), any_(after & F.col("beg_loop")).alias("has_loop_after"))


def weighted_dictionary(instrs: DataFrame, same_context: int = 10, argument: int = 2, result: int = 2) -> DataFrame:
    """target, func, weight: calls of other functions scored by what they share with the target (1, and more for the same context, an argument, the result), averaged over the target's traces."""
    rows = with_target(instrs).withColumn("tloc", F.max(F.when(F.col("is_target"), F.col("loc"))).over(Window.partitionBy(*KEY)))
    calls = rows.filter((F.col("op") == "Call") & ~F.col("is_target"))
    score = F.lit(1) + F.when(v.context(F.col("loc")) == v.context(F.col("tloc")), same_context).otherwise(0) + F.when(no(F.arrays_overlap("args", "targs")), argument).otherwise(0) + F.when(no(F.array_contains("args", F.col("r"))), result).otherwise(0)
    n = rows.select(*KEY).distinct().groupBy("target").agg(F.count("*").alias("n"))
    return calls.groupBy("target", "func").agg(F.sum(score).alias("s")).join(F.broadcast(n), "target").select("target", "func", (F.col("s") / F.col("n")).alias("weight"))


def result_table(stats: DataFrame) -> DataFrame:
    """Lines Count,Result of a function's statistics, most frequent first."""
    return stats.orderBy(F.desc("n"), "result").select(F.col("n").alias("Count"), F.col("result").alias("Result"))


def is_duplicate(a: DataFrame) -> DataFrame:
    """Graph traces by slice that have as many vertices as, and only vertices of, an earlier one (slice, trace_id, vertices)."""
    canon = a.withColumn("_v", F.array_sort("vertices"))
    return canon.withColumn("is_duplicate", F.row_number().over(Window.partitionBy("slice", "_v").orderBy("trace_id")) > 1).drop("_v")


def fold_runs(parts: list[DataFrame]) -> DataFrame:
    """Traces of several batches of a run as one table, with the number of the batch."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("batch", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out
