"""Call graphs (edge_id, caller, callee): bounded reachability, entries, slices and paths.

Frontiers grow by equi-joins, one for each level; the number of levels is a parameter and small. Each level is distinct before the next and is
written, so Spark knows its size: a frontier that is small beside the edges is sent to them, and only the edges that it meets are shuffled.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import filters


def from_instrs(instrs: DataFrame, keep_intrinsics: bool = False) -> DataFrame:
    """Call edges of direct calls; instrs: func, op, callee, loc."""
    calls = instrs.filter((F.col("op") == "Call") & F.col("callee").isNotNull())
    calls = calls if keep_intrinsics else calls.filter(filters.not_intrinsic(F.col("callee")))
    return calls.select(F.col("loc").alias("edge_id"), F.col("func").alias("caller"), "callee")


def target_edges(edges: DataFrame, keep: Column) -> DataFrame:
    """Edges whose callee the predicate keeps."""
    return edges.filter(keep)


def _met(edges: DataFrame, frontier: DataFrame, on: str) -> DataFrame:
    """The distinct edges that start at a function of a written frontier."""
    return edges.join(frontier.select(on), on, "left_semi").distinct()


def _risen(now: DataFrame, edges: DataFrame, depth: int, carry: str) -> DataFrame:
    """carry and entry, ``depth`` callers up from where now (carry, entry) is, or fewer where nothing calls it."""
    up = edges.select(F.col("callee").alias("entry"), F.col("caller").alias("up"))
    for _ in range(depth):
        now = written(now, "entries")
        now = now.join(_met(up, now, "entry"), "entry", "left").select(carry, F.coalesce("up", "entry").alias("entry")).distinct()
    return now


def entries(edges: DataFrame, targets: DataFrame, depth: int = 1) -> DataFrame:
    """target, entry: functions ``depth`` callers up from the callers of each target (targets: target), or fewer where nothing calls them."""
    targets = written(targets.select("target"), "targets")
    callers = edges.join(targets, edges["callee"] == targets["target"]).select("target", F.col("caller").alias("entry")).distinct()
    return _risen(callers, edges, depth, "target")


def edge_entries(edges: DataFrame, targets: DataFrame, depth: int = 1) -> DataFrame:
    """Slices: for each call edge to a target and each entry of its caller a row (target, edge_id, caller, entry)."""
    targets = written(targets.select("target"), "targets")
    calls = written(edges.join(targets, edges["callee"] == targets["target"]).select("target", "edge_id", "caller"), "calls")
    now = _risen(calls.select("caller").distinct().withColumn("entry", F.col("caller")), edges, depth, "caller")
    return calls.join(now, "caller").select("target", "edge_id", "caller", "entry")


def numbered_slices(slices: DataFrame, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """slice_id: the place of a slice among those of its target (or target and file), from 0, by edge and entry."""
    return slices.withColumn("slice_id", F.row_number().over(Window.partitionBy(*by).orderBy("edge_id", "entry")) - 1)


def reachable(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """target, entry, func: functions within ``hops`` calls of the entry, never entering the target (starts: target, entry)."""
    down = edges.select(F.col("caller").alias("func"), F.col("callee").alias("down"))
    now = written(starts.select("target", "entry", F.col("entry").alias("func")).distinct(), "slices")
    found = [now]
    for _ in range(hops):
        now = written(now.join(down, "func").filter(F.col("down") != F.col("target")).select("target", "entry", F.col("down").alias("func")).distinct(), "slices")
        found.append(now)
    return reduce(DataFrame.unionAll, found).distinct()


def reduced(slices: DataFrame, edges: DataFrame, hops: int, related: Column | None = None) -> DataFrame:
    """Functions of a slice (target, entry, func) from which a function related to the target can be reached in ``hops`` calls; by default one whose name starts with the same character."""
    rel = (F.substring("func", 1, 1) == F.substring("target", 1, 1)) if related is None else related
    callers = edges.select(F.col("caller").alias("from"), F.col("callee").alias("func"))
    slices = written(slices, "slices")
    now = written(slices.filter(rel).select("target", "entry", "func").distinct(), "related")
    found = [now]
    for _ in range(hops):
        now = written(now.join(callers, "func").select("target", "entry", F.col("from").alias("func")).distinct(), "related")
        found.append(now)
    return slices.join(reduce(DataFrame.unionAll, found).distinct(), ["target", "entry", "func"], "left_semi")


def struct_names(function_type: Column) -> Column:
    """Names of the struct types that a function's type mentions, however deep in arrays, pointers, vectors or functions."""
    return F.array_distinct(F.regexp_extract_all(function_type, F.lit(r"%?struct\.([A-Za-z_][\w.]*)"), F.lit(1)))


def related_by_structs(slices: DataFrame, types: DataFrame) -> DataFrame:
    """slices (target, entry, func) with ``related``: the function and the target use a struct type in common (types: func, type, one row each)."""
    slices = written(slices.select("target", "entry", "func"), "slices")
    asked = slices.select("func").unionAll(slices.select(F.col("target").alias("func"))).distinct()
    of = written(types.join(asked, "func", "left_semi").select("func", struct_names(F.col("type")).alias("structs")), "structs")
    both = slices.join(of, "func", "left").join(of.select(F.col("func").alias("target"), F.col("structs").alias("wanted")), "target", "left")
    none = F.array().cast("array<string>")
    return both.select("target", "entry", "func", share_structs(F.coalesce("structs", none), F.coalesce("wanted", none)).alias("related"))


def num_elements(batched: DataFrame) -> DataFrame:
    """Elements of all batches, and of each target over all its batches (target null: all)."""
    return batched.rollup("target").agg(F.count("*").alias("n"))


def of_entries(slices: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """Slices whose entry stands in a file that matches the regular expression, or in none that is known (files: entry, file, a row each)."""
    named = files.select("entry", F.col("file").alias("_file"))
    return slices.join(named, "entry", "left").filter(F.col("_file").isNull() | F.col("_file").rlike(pattern)).drop("_file")


def share_structs(a: Column, b: Column) -> Column:
    """Two functions use a struct type in common."""
    return F.arrays_overlap(a, b)


def simple_paths(edges: DataFrame, ends: DataFrame, max_length: int, most: int | None = None) -> DataFrame:
    """start, stop, path: paths without repeated nodes of at most ``max_length`` edges (ends: start, stop). Their number can be exponential in the length; ``most`` for each pair is the caller's limit."""
    step = edges.select(F.col("caller").alias("at"), F.col("callee").alias("next"))
    now = ends.select("start", "stop", F.col("start").alias("at"), F.array("start").alias("path"))
    found = []
    for _ in range(max_length):
        now = written(now, "paths")
        on = now.filter(F.col("at") != F.col("stop")) if found else now
        if found:
            found[-1] = now.filter(F.col("at") == F.col("stop")).select("start", "stop", "path")
        now = on.join(_met(step, on, "at"), "at").filter(~F.array_contains("path", F.col("next"))).select("start", "stop", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
        found.append(now.filter(F.col("at") == F.col("stop")).select("start", "stop", "path"))
    out = reduce(DataFrame.unionAll, found)
    if most is None:
        return out
    n = F.row_number().over(Window.partitionBy("start", "stop").orderBy(F.size("path"), F.array_join("path", ">")))
    return out.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def function_traces(edges: DataFrame, slices: DataFrame, members: DataFrame, max_length: int, most: int) -> DataFrame:
    """Paths from the entry of a slice to its caller within the slice's functions (slices: target, entry, caller; members: target, entry, func); one path where they are the same."""
    ends = slices.select(F.col("entry").alias("start"), F.col("caller").alias("stop")).distinct()
    same = ends.filter("start = stop").select("start", "stop", F.array("start").alias("path"))
    paths = simple_paths(edges, ends.filter("start != stop"), max_length, most).unionAll(same)
    inside = members.groupBy(F.col("entry").alias("start")).agg(F.collect_set("func").alias("inside"))
    return paths.join(inside, "start").filter(F.size(F.array_except("path", "inside")) == 0).select("start", "stop", "path")


def choices(parts: DataFrame, key: list[str], pos: str, options: str) -> DataFrame:
    """All ways to take one option of each part: the product over a key's parts, in order of pos, of their arrays of options."""
    lists = parts.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct(pos, options))), lambda x: x[options]).alias("_lists"))
    start = F.array(F.array().cast("array<string>"))
    product = F.aggregate("_lists", start, lambda done, opts: F.flatten(F.transform(done, lambda d: F.transform(opts, lambda o: F.concat(d, F.array(o))))))
    return lists.select(*key, F.explode(product).alias("choice"))


def distinct_sequences(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Sequences of values with equal neighbours collapsed, each distinct sequence once for each key but its last part (the trace)."""
    w = Window.partitionBy(*key).orderBy(order)
    kept = rows.withColumn("_before", F.lag(value).over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col(value)))
    seqs = kept.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]), ">").alias("seq"))
    return seqs.groupBy(*key[:-1], "seq").agg(F.min(key[-1]).alias(key[-1]), F.count("*").alias("n_same"))


def batches(slices: DataFrame, size: int) -> DataFrame:
    """batch: slices in order of target and id, ``size`` at a time, numbered by prefix sums over targets, so that no task orders them all."""
    w = Window.partitionBy("target").orderBy("slice_id")
    per = slices.groupBy("target").agg(F.count("*").alias("_n"))
    before = per.select("target", (F.sum("_n").over(Window.orderBy("target")) - F.col("_n")).alias("_before"))
    out = slices.join(before, "target").withColumn("_at", F.row_number().over(w) - 1 + F.col("_before"))
    return out.withColumn("batch", F.floor(F.col("_at") / size).cast("long")).drop("_at", "_before")


def merged_clusters(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node, cluster: connected components of links (a, b) by the least node.

    Large and small stars in turn until nothing changes, which takes about as many rounds as the logarithm of the longest
    chain; an error if ``rounds`` are not enough.
    """
    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    ensure_checkpoints(links.sparkSession)
    nodes = links.select(F.col("a").alias("node")).unionAll(links.select("b")).filter("node is not null").distinct().checkpoint()
    now = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct().checkpoint()
    was = state(now)
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        now = large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("b")).filter("m < b").select(F.col("m").alias("a"), "b").distinct().checkpoint()
        found = state(now)
        if found == was:
            break
        was = found
    else:
        raise RuntimeError(f"clusters did not settle in {rounds} rounds")
    return nodes.join(now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("cluster")), "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def ensure_checkpoints(spark) -> None:
    """Checkpoints go to the folder that spark.checkpoint.dir names; where it is unset, to one of our own, which only a local session may use."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tracelode-")
    spark.sparkContext.setCheckpointDir(folder)


def shared_folder(spark, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names."""
    ensure_checkpoints(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or str(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return f"{base.rstrip('/')}/tracelode/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: computed once, and safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_with_count(df: DataFrame, path: str) -> int:
    """Write df as Parquet under the path, and count its rows while that runs."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a DOT text, in order: nodes (id, label, is_target) and edges (src, dst, kind: du or cf)."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    style = F.when(F.col("is_target"), ', style=filled, fillcolor=blue, fontcolor=white').otherwise("")
    ns = nodes.select(F.lit(1).alias("part"), F.col("id").cast("long").alias("n1"), F.lit(0).cast("long").alias("n2"), F.concat(F.col("id").cast("string"), F.lit(" [label="), quote(F.col("label")), style, F.lit("];")).alias("line"))
    es = edges.select(F.lit(2).alias("part"), F.col("src").cast("long").alias("n1"), F.col("dst").cast("long").alias("n2"), F.concat(F.col("src").cast("string"), F.lit(" -> "), F.col("dst").cast("string"), F.lit(" [color="), F.when(F.col("kind") == "du", "red").otherwise("black"), F.lit("];")).alias("line"))
    return ns.unionAll(es).orderBy("part", "n1", "n2").select("line")
