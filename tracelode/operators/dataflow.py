"""Order-dependent joins over a trace's instructions: as-of, lag and band joins as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.relations import KEY
from .graph import merged_clusters


def branch_comparisons(instrs: DataFrame) -> DataFrame:
    """Each branch with the latest comparison before it that has its condition (icmp_idx)."""
    w = Window.partitionBy(*KEY, "c").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = instrs.filter(F.col("op").isin("ICmp", "CondBr")).withColumn("c", F.coalesce(F.when(F.col("op") == "ICmp", F.col("res")), F.col("cond")))
    return rows.withColumn("icmp_idx", F.last(F.when(F.col("op") == "ICmp", F.col("idx")), ignorenulls=True).over(w)).filter((F.col("op") == "CondBr") & F.col("icmp_idx").isNotNull()).select(*KEY, "idx", "icmp_idx", "br")


def reaching_definitions(instrs: DataFrame) -> DataFrame:
    """Each load with the latest store to its place before it (def_idx)."""
    w = Window.partitionBy(*KEY, "mem").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = instrs.filter(F.col("op").isin("Load", "Store"))
    return rows.withColumn("def_idx", F.last(F.when(F.col("op") == "Store", F.col("idx")), ignorenulls=True).over(w)).filter((F.col("op") == "Load") & F.col("def_idx").isNotNull()).select(*KEY, "idx", "mem", "def_idx")


def use_chains(instrs: DataFrame, place: Column) -> DataFrame:
    """Each use of a place with the use before it (prev_idx)."""
    rows = instrs.withColumn("place", place).filter("place is not null")
    return rows.withColumn("prev_idx", F.lag("idx").over(Window.partitionBy(*KEY, "place").orderBy("idx"))).filter("prev_idx is not null").select(*KEY, "place", "idx", "prev_idx")


def syntactic_uses(operands: DataFrame, definitions: DataFrame) -> DataFrame:
    """Operands (key, idx, operand) with the instruction that defines them (key, idx, res)."""
    d = definitions.select(*KEY, F.col("res").alias("operand"), F.col("idx").alias("def_idx"))
    return operands.join(d, [*KEY, "operand"]).select(*KEY, "idx", "operand", "def_idx")


def control_edges(instrs: DataFrame) -> DataFrame:
    """Each instruction with the one before it in its trace."""
    return instrs.withColumn("src", F.lag("idx").over(Window.partitionBy(*KEY).orderBy("idx"))).filter("src is not null").select(*KEY, "src", F.col("idx").alias("dst"))


def phi_values(phis: DataFrame) -> DataFrame:
    """The incoming value of each phi (incoming: array of struct<block, value>) from the block before it (prev_block)."""
    return phis.withColumn("value", F.get(F.filter("incoming", lambda x: x["block"] == F.col("prev_block")), F.lit(0))["value"])


def argument_relations(instrs: DataFrame) -> DataFrame:
    """key, i, j: pairs of different arguments of the target that share a symbol or a call's result."""
    symbols = lambda a: F.array_distinct(F.regexp_extract_all(a, F.lit(r'("Sym":\d+|"id":\d+)'), F.lit(1)))
    args = instrs.filter("is_target").select(*KEY, F.posexplode("args").alias("i", "a")).withColumn("s", F.explode(symbols(F.col("a"))))
    other = args.select(*KEY, F.col("i").alias("j"), "s")
    return args.join(other, [*KEY, "s"]).filter("i != j").select(*KEY, "i", "j").distinct()


def whole_slices(points: DataFrame, chosen: DataFrame, width: int = 50) -> DataFrame:
    """Datapoints of a chosen one's slice whose numbers lie from ``width`` below to below ``width`` above it (points: dp_id, bc, slice_id)."""
    c = chosen.join(points, "dp_id").select(F.col("dp_id").alias("chosen"), "bc", "slice_id")
    return points.join(c, ["bc", "slice_id"]).filter((F.col("dp_id") >= F.col("chosen") - width) & (F.col("dp_id") < F.col("chosen") + width)).select("chosen", "dp_id")


def reduce_dugraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes to keep (key, id): all that are connected to the target by du edges (key, src, dst) either way, and those marked keep; nodes: key, id, is_target, keep."""
    node = lambda c: F.struct(*KEY, F.col(c).cast("long").alias("id"))
    clusters = merged_clusters(edges.filter("src is not null and dst is not null").select(node("src").alias("a"), node("dst").alias("b")))
    targets = nodes.filter("is_target").select(node("id").alias("node"))
    own = clusters.join(targets, "node", "left_semi").select("cluster").distinct()
    kept = clusters.join(own, "cluster", "left_semi").select("node").unionAll(targets).unionAll(nodes.filter("keep").select(node("id").alias("node")))
    return kept.distinct().select("node.*")


def relinked(kept: DataFrame) -> DataFrame:
    """Control edges (key, src, dst) among the nodes kept, in order."""
    return kept.withColumn("dst", F.lead("id").over(Window.partitionBy(*KEY).orderBy("id"))).filter("dst is not null").select(*KEY, F.col("id").alias("src"), "dst")


def legacy_metadata(instrs: DataFrame) -> DataFrame:
    """For each target: traces explored, duplicated (the same operations as an earlier one of their slice) and rejected (without the target), nodes and edges, and their averages over what is explored."""
    per = instrs.groupBy(*KEY).agg(F.bool_or("is_target").alias("hit"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "op"))), lambda x: x["op"]), ">").alias("seq"))
    w = Window.partitionBy("target", "bc", "slice_id", "seq").orderBy("trace_id")
    per = per.withColumn("again", F.row_number().over(w) > 1)
    out = per.groupBy("target").agg(F.count("*").alias("explored"), F.count_if("again").alias("duplicated"), F.count_if(~F.col("hit")).alias("rejected"), F.sum("n").alias("nodes"), F.sum(F.col("n") - 1).alias("edges"))
    return out.select("*", (F.col("nodes") / F.col("explored")).alias("avg_nodes"), (F.col("edges") / F.col("explored")).alias("avg_edges"))


def execution_metadata(instrs: DataFrame) -> DataFrame:
    """For each target and file: traces by how they finish: no target, returned, or cut."""
    per = instrs.groupBy(*KEY).agg(F.bool_or("is_target").alias("hit"), F.max_by("op", "idx").alias("final"), F.count("*").alias("n"))
    return per.groupBy("target", "bc").agg(F.count("*").alias("explored"), F.count_if(~F.col("hit")).alias("no_target"), F.count_if(F.col("hit") & (F.col("final") == "Ret")).alias("proper"), F.count_if(F.col("hit") & (F.col("final") != "Ret")).alias("cut"), F.sum("n").alias("nodes"))


OUTCOMES = ("proper", "duplicate", "no_target", "exceeding_length", "unreachable", "unfinished")


def trace_outcomes(instrs: DataFrame, most: int = 5000) -> DataFrame:
    """key, outcome: how each trace ended. Without target; with more than ``most`` instructions; at a point that can't be reached; with the same operations as an earlier one of its slice; with a return; or none of these (in this order)."""
    per = instrs.groupBy(*KEY).agg(F.bool_or("is_target").alias("hit"), F.count("*").alias("n"), F.max_by("op", "idx").alias("final"), F.xxhash64(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "op", F.coalesce("func", F.lit("")).alias("f")))), lambda x: F.concat_ws(":", x["op"], x["f"])), ">")).alias("seq"))
    again = F.row_number().over(Window.partitionBy("target", "bc", "slice_id", "seq").orderBy("trace_id")) > 1
    outcome = F.when(~F.coalesce("hit", F.lit(False)), "no_target").when(F.col("n") > most, "exceeding_length").when(F.col("final") == "Unreachable", "unreachable").when(again, "duplicate").when(F.col("final") == "Ret", "proper").otherwise("unfinished")
    return per.select(*KEY, outcome.alias("outcome"))


def outcome_counts(outcomes: DataFrame, by: tuple[str, ...] = ("target", "bc")) -> DataFrame:
    """by, a counter for each outcome, and explored, their sum."""
    return outcomes.groupBy(*by).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count("*").alias("explored"))


def merged_counts(parts: list[DataFrame], by: tuple[str, ...] = ("target", "bc")) -> DataFrame:
    """The counters of several runs, or of parts of one, added up; in any order and any grouping it is the same."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*by).agg(*[F.sum(c).alias(c) for c in (*OUTCOMES, "explored")])


def capped(traces: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    """At most so many traces of each key, in order: the engine's own limit on a slice."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return traces.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")
