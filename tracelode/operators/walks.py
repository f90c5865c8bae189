"""Walks over graphs that are keyed: the data flow of traces, the blocks of functions.

Graphs are edge tables (key columns, src, dst). Walks go level by level: each level joins the frontier with the edges on key and
node, so a hot key is spread over its nodes, and is written to the shared folder before the next one starts. A frontier holds only nodes that were not met before.

Defined cases: null nodes are no nodes. Repeated edges count once. Starts that have no edge are their own whole walk. Empty tables
give empty tables. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.relations import KEY
from . import filters, graph
from .features import no, with_target


def _edges(edges: DataFrame, key: Sequence[str], forward: bool = True) -> DataFrame:
    """Distinct edges as key, src, dst, turned round if not forward."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    return edges.select(*key, F.col(a).alias("src"), F.col(b).alias("dst")).filter("src is not null and dst is not null").distinct()


def _is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def reach(edges: DataFrame, starts: DataFrame, key: Sequence[str] = KEY, forward: bool = True, carry: Sequence[str] = (), rounds: int = 10_000) -> DataFrame:
    """key, carry, id, depth: all nodes that can be reached from the starts (key, carry, id), and over how many edges at least; the starts have depth 0.

    Walks whose starts differ in the columns to carry are walks of their own over the same edges. More than ``rounds`` levels are an error.
    """
    spark, folder, own = edges.sparkSession, graph.shared_folder(edges.sparkSession, "walk"), [*key, *carry]
    step = graph.written(_edges(edges, key, forward), "edges")
    level = starts.select(*own, "id").filter("id is not null").distinct().withColumn("depth", F.lit(0))
    for i in range(rounds + 1):
        n = graph.written_with_count(level, f"{folder}/level={i}")
        read = lambda *levels: spark.read.schema(level.schema).parquet(*[f"{folder}/level={j}" for j in levels])  # noqa: B023, E731
        front, seen = read(i), read(*range(i + 1))
        if not n:
            return seen
        found = front.withColumnRenamed("id", "src").join(step, [*key, "src"]).select(*own, F.col("dst").alias("id")).distinct()
        level = found.join(seen, [*own, "id"], "left_anti").withColumn("depth", F.lit(i + 1))
    raise RuntimeError(f"the walk is longer than {rounds} levels")


def def_use_edges(instrs: DataFrame) -> DataFrame:
    """key, src, dst: each instruction that uses a value (as argument, operand, condition, place or what is stored) with the latest one before it that gave it; a load also with the latest store to its place."""
    used = F.array_distinct(F.filter(F.concat(F.array("op0", "op1", "cond", "mem", "val"), F.coalesce("args", F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    mark = lambda place, gives, value: F.struct(F.lit(place).alias("place"), gives.alias("gives"), value.alias("value"))
    memory = F.when(F.col("op").isin("Load", "Store"), mark(True, F.col("op") == "Store", F.col("mem")))
    marks = F.filter(F.concat(F.transform(used, lambda x: mark(False, F.lit(False), x)), F.array(mark(False, F.lit(True), F.col("res")), memory)), lambda m: m["value"].isNotNull())
    rows = instrs.select(*KEY, "idx", F.explode(marks).alias("_m")).select(*KEY, "idx", "_m.*")
    # One sort finds both: what gave a value, and what was stored to a place.
    order = Window.partitionBy(*KEY, "place", "value").orderBy("idx").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("src", F.max(F.when(F.col("gives"), F.col("idx"))).over(order)).filter(~F.col("gives") & F.col("src").isNotNull())
    return found.select(*KEY, "src", F.col("idx").alias("dst")).distinct()


def reachable_calls(instrs: DataFrame, edges: DataFrame, forward: bool = True) -> DataFrame:
    """The calls (rows with t, r and targs) that a walk from the target comes to, itself excluded; edges: key, src, dst by place in the trace."""
    rows = with_target(instrs)
    starts = rows.filter(F.col("idx") == F.col("t")).select(*KEY, F.col("t").alias("id"))
    met = reach(edges, starts, KEY, forward).filter("depth > 0").select(*KEY, F.col("id").alias("idx"))
    return rows.filter((F.col("op") == "Call") & (F.col("idx") != F.col("t"))).join(met, [*KEY, "idx"], "left_semi")


def causal_dictionary(instrs: DataFrame, edges: DataFrame, types: DataFrame | None = None, forward: bool = True) -> DataFrame:
    """target, func, weight: calls that a walk from the target comes to, each 1, and 10 more for a call of the target itself, 2 for an argument, 2 for a result and 1 for a struct type in common, summed and divided by the target's traces.

    types: func and type, one row each, the text of the function's type. Functions with names of compiler constructs or instrumentation are left out.
    """
    n = instrs.filter("is_target").select(*KEY).distinct().groupBy("target").agg(F.count("*").alias("_traces"))
    calls = reachable_calls(instrs, edges, forward).filter(filters.causal_name(F.col("func"))).select("target", "func", "args", "targs", "r", "res")
    shared = F.lit(0)
    if types is not None:
        of = types.select("func", graph.struct_names(F.col("type")).alias("_mine"))
        calls = calls.join(of, "func", "left").join(of.select(F.col("func").alias("target"), F.col("_mine").alias("_theirs")), "target", "left")
        shared = F.when(no(F.arrays_overlap("_mine", "_theirs")), 1).otherwise(0)
    arguments = F.when(no(F.arrays_overlap("args", "targs")), 2).otherwise(0)
    results = F.when(no(F.array_contains("args", F.col("r"))) | no(F.array_contains("targs", F.col("res"))), 2).otherwise(0)
    score = 1 + F.when(F.col("func") == F.col("target"), 10).otherwise(0) + arguments + results + shared
    return calls.withColumn("_score", score).groupBy("target", "func").agg(F.sum("_score").alias("_s")).join(n, "target").select("target", "func", (F.col("_s") / F.col("_traces")).alias("weight"))


def kept_nodes(nodes: DataFrame, du_edges: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Nodes of a trace that its reduction keeps: what a data-flow path joins with the target or leads to control flow, control flow and related calls themselves, and all that data flows to from these.

    nodes: key, id, is_target, is_control, is_related.
    """
    pick = lambda flag: nodes.filter(flag).select(*key, "id")
    above = reach(du_edges, pick("is_target or is_control"), key, forward=False).select(*key, "id")
    sources = above.unionAll(pick("is_target or is_related"))
    return reach(du_edges, sources, key).select(*key, "id")


def spliced(kept: DataFrame, edges: DataFrame, key: Sequence[str] = KEY, rounds: int = 64) -> DataFrame:
    """key, src, dst among the nodes kept (key, id): their edges, and for each path through removed nodes only an edge that bridges it.

    The way through removed nodes is found by pointer jumping: after i rounds each removed node knows the kept nodes within 2^i steps and the removed ones after exactly so many, so the
    rounds grow with the logarithm of the longest way.
    """
    all_edges = graph.written(_edges(edges, key), "edges")
    mark = kept.select(*key, F.col("id").alias("dst"), F.lit(True).alias("_kept")).distinct()
    marked = all_edges.join(mark, [*key, "dst"], "left").withColumn("_kept", no(F.col("_kept")))
    jumps = graph.written(marked.join(kept.select(*key, F.col("id").alias("src")), [*key, "src"], "left_anti").select(*key, "src", "dst", "_kept"), "jumps")
    state = lambda df: df.agg(F.count_if("_kept").alias("n"), F.sum(F.when(F.col("_kept"), F.xxhash64(*key, "src", "dst")).cast("decimal(38,0)")).alias("h"), F.count_if(~F.col("_kept")).alias("left")).first()
    was = state(jumps)
    for _ in range(rounds):
        if not was["left"]:
            break
        on = jumps.select(*key, F.col("src").alias("dst"), F.col("dst").alias("_next"), F.col("_kept").alias("_arrives"))
        further = jumps.filter(~F.col("_kept")).join(on, [*key, "dst"]).select(*key, "src", F.col("_next").alias("dst"), F.col("_arrives").alias("_kept"))
        jumps = graph.written(jumps.filter("_kept").unionByName(further).distinct(), "jumps")
        now = state(jumps)
        if (now["n"], now["h"]) == (was["n"], was["h"]):
            break
        was = now
    else:
        raise RuntimeError(f"bridges did not settle in {rounds} rounds")
    bridges = jumps.filter("_kept").select(*key, F.col("src").alias("dst"), F.col("dst").alias("_over"))
    own = marked.join(kept.select(*key, F.col("id").alias("src")).distinct(), [*key, "src"], "left_semi")
    over = own.filter(~F.col("_kept")).join(bridges, [*key, "dst"]).select(*key, "src", F.col("_over").alias("dst"))
    return own.filter("_kept").select(*key, "src", "dst").unionAll(over).distinct()


def block_graph(blocks: DataFrame, key: Sequence[str] = ("func",)) -> DataFrame:
    """key, src, dst: from each block (key, block, next: array of blocks) to those that its last instruction can go to."""
    return blocks.select(*key, F.col("block").alias("src"), F.explode("next").alias("dst")).filter("dst is not null").distinct()


def block_paths(edges: DataFrame, ends: DataFrame, most: int, key: Sequence[str] = ("func",), rounds: int = 10_000, kept: bool = False) -> DataFrame:
    """key, start, stop, path: the first ``most`` paths without repeated nodes for each of the ends (key, start, stop), the shortest first and those of one length in order of their nodes.

    A partial path is worth its length and the distance that is left; at each level only the best are followed, a budget for each end, so a function with
    2^30 paths costs what its first ones cost. Where a loop makes followed paths die, something left aside could have come first: an end whose last path
    found doesn't come before all that was left aside is done again with four times the budget. Where a start has more than TOGETHER ends on the average, they are searched
    together first, and only those of functions where a path met itself one by one. kept: the edges are a written table, which can be read again at each level.
    """
    todo, done = graph.written(ends.select(*key, "start", "stop").filter("start is not null and stop is not null").distinct(), "ends"), []
    size = todo.agg(F.count("*").alias("ends"), F.count_distinct(F.struct(*key, "start")).alias("starts")).first()
    if size["ends"] > TOGETHER * size["starts"]:
        step = edges.select(*key, "src", "dst").filter("src is not null and dst is not null")
        found, looped = _paths_together(step if kept else graph.written(step, "edges"), todo, most, key, rounds)
        done.append(found)
        todo = graph.written(todo.join(looped, [*key, "start"], "left_semi"), "ends")
    if _is_empty(todo):
        return done[0] if done else todo.withColumn("path", F.array("start"))
    step = graph.written(_edges(edges, key), "edges")
    stops = todo.select(*key, F.col("stop").alias("id"), "stop").distinct()
    left = reach(step, stops, key, forward=False, carry=["stop"], rounds=rounds)
    left = graph.written(left.withColumnsRenamed({"id": "dst", "depth": "left"}), "distances")
    # The edges from which a stop can be reached, for each stop: no more than the walk back has met, and no partial path ever meets another.
    step = graph.written(step.join(left, [*key, "dst"]).select(*key, "stop", "src", "dst", "left"), "steps")
    same, budget = [*key, "start", "stop"], most
    while not _is_empty(todo):
        found, aside = _paths_within(step, todo, left, most, budget, key, rounds)
        last = found.groupBy(*same).agg(F.count("*").alias("n"), F.max(F.struct("length", "path")).alias("last"))
        first_aside = aside.groupBy(*same).agg(F.min(F.struct("worth", "path")).alias("aside"))
        # What was left aside starts with its path; any path through it comes after the last one found if it is worth more, or as much and later in order.
        sure = F.col("aside").isNull() | (no(F.col("n") >= most) & no(F.struct(F.col("last.length"), F.col("last.path")) < F.struct(F.col("aside.worth"), F.col("aside.path"))))
        verdict = graph.written(todo.join(last, same, "left").join(first_aside, same, "left").withColumn("sure", sure).select(*same, "sure"), "verdict")
        done.append(graph.written(found.join(verdict.filter("sure"), same, "left_semi").select(*same, "path"), "paths"))
        todo, budget = verdict.filter(~F.col("sure")).select(*same), 4 * budget
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


#: Ends for each start beyond which they are searched together.
TOGETHER = 256


def _paths_together(step: DataFrame, ends: DataFrame, most: int, key: Sequence[str], rounds: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` paths of the ends, and the starts (key, start) whose ends are not among them, as a path of theirs came back to one of its blocks.

    Level by level from the starts, each block keeps the first ``most`` paths to it. As long as none comes back, the first paths to a block go over the first ones to the blocks before it, so
    nothing that is dropped can matter, and all ends of a start share the work: less than twice ``most`` rows for each edge and start.
    """
    spark, folder, own = step.sparkSession, graph.shared_folder(step.sparkSession, "together"), [*key, "start"]
    front = ends.select(*own).distinct().select(*own, F.col("start").alias("at"), F.array("start").alias("path"), F.lit(False).alias("looped"))
    # Joins and windows sort by a number first, which is cheaper than names that begin alike.
    number = lambda *names: F.xxhash64(*names).alias("_h")
    step = step.select(number(*key, "src"), *key, "src", "dst")
    order = Window.partitionBy("_h", *own, "at", "looped").orderBy("path")
    read = lambda *levels: spark.read.schema(front.schema).parquet(*[f"{folder}/level={j}" for j in levels])
    for i in range(rounds + 1):
        n = graph.written_with_count(front, f"{folder}/level={i}")
        kept = read(*range(i + 1))
        looped = kept.filter("looped").select(*own).distinct()
        if not n:
            break
        now = read(i).filter("not looped").drop("looped").join(looped, own, "left_anti")
        if i:  # what has enough paths from the levels before needs no more
            full = read(*range(i)).filter("not looped").groupBy(number(*own, "at"), *own, "at").agg(F.count("*").alias("_n")).filter(F.col("_n") >= most)
            now = now.join(full.select(*own, "at"), [*own, "at"], "left_anti")
        onward = now.withColumnRenamed("at", "src").withColumn("_h", number(*key, "src")).join(step, ["_h", *key, "src"])
        onward = onward.select(number(*own, "dst"), *own, F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("looped"))
        # Repeated edges give equal paths, of which the first counts.
        ranked = onward.withColumn("_rank", F.dense_rank().over(order)).withColumn("_new", ~F.lag("path").over(order).eqNullSafe(F.col("path")))
        front = ranked.filter(F.col("_new") & (F.col("_rank") <= F.when(F.col("looped"), 1).otherwise(most))).drop("_rank", "_new", "_h")
    else:
        raise RuntimeError(f"a path is longer than {rounds} nodes")
    looped, same = graph.written(looped, "looped"), ["_h", *own, "stop"]
    found = kept.filter("not looped").select(number(*own, "at"), *own, F.col("at").alias("stop"), "path").join(ends.withColumn("_h", number(*own, "stop")), same, "left_semi").join(looped, own, "left_anti")
    first = Window.partitionBy(*same).orderBy(F.size("path"), "path")
    found = found.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= most).drop("_h", "_rank")
    return graph.written(found, "paths"), looped


def _paths_within(step: DataFrame, ends: DataFrame, left: DataFrame, most: int, budget: int, key: Sequence[str], rounds: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` paths of each end that a search with this budget finds (with their length), and what it left aside (with its worth); step: edges by stop, with what is left after them."""
    spark, folder = step.sparkSession, graph.shared_folder(step.sparkSession, "paths")
    same = [*key, "start", "stop"]
    here = left.select(*key, "stop", F.col("dst").alias("start"), F.col("left").alias("worth"))
    front = ends.join(here, same).select(*same, F.col("start").alias("at"), F.array("start").alias("path"), F.lit(0).alias("length"), "worth")
    order = Window.partitionBy(*same).orderBy("worth", "path")
    for i in range(rounds):
        ranked = front.withColumn("_rank", F.row_number().over(order)).withColumn("kind", F.when(F.col("at") == F.col("stop"), "found").when(F.col("_rank") > budget, "aside").otherwise("front"))
        ranked = ranked.drop("_rank")
        if not graph.written_with_count(ranked, f"{folder}/level={i}"):
            break
        now = spark.read.schema(ranked.schema).parquet(f"{folder}/level={i}").filter("kind = 'front'")
        onward = now.withColumnRenamed("at", "src").join(step, [*key, "stop", "src"]).filter(~F.array_contains("path", F.col("dst")))
        front = onward.select(*same, F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.lit(i + 1).alias("length"), (F.col("left") + i + 1).alias("worth"))
    else:
        raise RuntimeError(f"a path is longer than {rounds} nodes")
    every = spark.read.schema(ranked.schema).parquet(*[f"{folder}/level={j}" for j in range(i + 1)])
    n = Window.partitionBy(*same).orderBy("length", "path")
    found = every.filter("kind = 'found'").withColumn("_n", F.row_number().over(n)).filter(F.col("_n") <= most).select(*same, "path", "length")
    return found, every.filter("kind = 'aside'").select(*same, "path", "worth")


def numbered_choices(parts: DataFrame, key: Sequence[str], pos: str, options: str, first: int = 0, most: int | None = None) -> DataFrame:
    """key, number, choice: ways to take one option of each part, those numbered from ``first`` on, ``most`` of them or all.

    The number of a way, written with a digit for each part in order of pos, tells which option is taken (the last part's digit changes fastest), so any page of a product is
    made without the rest. Keys with a part that has no options (null or empty) have no ways. A product of 2^63 or more ways is given up to that number.
    """
    lists = parts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.coalesce(F.col(options), F.array().cast(parts.schema[options].dataType)).alias("o")))), lambda x: x["o"]).alias("_lists"))
    # Below each part: how many ways the parts after it have; capped where that leaves 64 bits.
    big = F.lit((1 << 63) - 1)
    times = lambda a, b: F.when((a > 0) & (b > 0) & (a > _div(big, b)), big).otherwise(a * b)
    below = F.aggregate(F.reverse("_lists"), F.array(F.lit(1).cast("long")), lambda done, o: F.concat(F.array(times(done[0], F.size(o).cast("long"))), done))
    ways = lists.withColumn("_below", below).withColumn("_n", F.col("_below")[0])
    end = F.col("_n") if most is None else F.least(F.col("_n"), F.lit(min(first + most, (1 << 63) - 1)))
    pages = ways.filter((end > first) & (F.col("_n") > 0)).withColumn("number", F.explode(F.sequence(F.lit(first).cast("long"), end - 1)))
    choice = F.transform("_lists", lambda o, i: F.get(o, F.pmod(_div(F.col("number"), F.get("_below", i + 1)), F.size(o).cast("long")).cast("int")))
    return pages.select(*key, "number", choice.alias("choice"))


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of longs; a double would round."""
    return F.call_function("div", a, b)


def block_traces(calls: DataFrame, paths: DataFrame, first: int = 0, most: int | None = None) -> DataFrame:
    """trace, number, blocks: ways through the blocks of all functions of a call path, one block path for each in order; calls: trace, pos, func, block (where the next one is called); paths: func, stop, path."""
    options = paths.groupBy(F.col("func"), F.col("stop").alias("block")).agg(F.array_sort(F.collect_list("path")).alias("options"))
    parts = calls.join(options, ["func", "block"], "left").select("trace", "pos", "options")
    return numbered_choices(parts, ["trace"], "pos", "options", first, most).withColumnRenamed("choice", "blocks")
