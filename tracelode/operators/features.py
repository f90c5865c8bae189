"""Features of a trace around its target call, as groupings and windows over its instructions.

Input: the long table of instructions (sources.relations.trace_instrs). Every function returns the key of the
trace and boolean columns. Traces without a target have no features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values as v
from ..sources.relations import KEY, SLICE


def no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def any_(c: Column) -> Column:
    return no(F.bool_or(no(c)))


def with_target(instrs: DataFrame) -> DataFrame:
    """The rows of traces that have a target, with its place t, result r, arguments targs, and the trace's last place; no shuffle beyond that of the key."""
    w = Window.partitionBy(*KEY)
    t = F.max(F.when(F.col("is_target"), F.struct("idx", "res", "args"))).over(w)
    return instrs.withColumn("_t", t).filter("_t is not null").withColumn("last_idx", F.max("idx").over(w)).select("*", F.col("_t.idx").alias("t"), F.col("_t.res").alias("r"), F.col("_t.args").alias("targs")).drop("_t")


def shape(instrs: DataFrame) -> DataFrame:
    """target_idx, number of rows, rows before and after the target."""
    return with_target(instrs).groupBy(*KEY).agg(F.max("t").alias("target_idx"), F.count("*").alias("n_instrs"), F.count_if(F.col("idx") < F.col("t")).alias("n_before"), F.count_if(F.col("idx") > F.col("t")).alias("n_after"))


def control_flow(instrs: DataFrame) -> DataFrame:
    depth = F.when(F.col("beg_loop"), 1).otherwise(0) - F.when(F.col("end_loop"), 1).otherwise(0)
    return with_target(instrs).groupBy(*KEY).agg(
        any_(F.col("beg_loop")).alias("has_loop"),
        no(F.sum(F.when(F.col("idx") < F.col("t"), depth)) > 0).alias("target_in_a_loop"),
        any_((F.col("op") == "CondBr") & (F.col("idx") > F.col("t"))).alias("has_cond_br_after_target"),
    )


def _op(*names: str) -> Column:
    return F.col("op").isin(*names)


def ret(instrs: DataFrame) -> DataFrame:
    """What happens to the target's result after the call."""
    rows = with_target(instrs).filter(F.col("idx") > F.col("t"))
    before = Window.partitionBy(*KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    r, mem, val = F.col("r"), F.col("mem"), F.col("val")
    stored = _op("Store") & (val == r) & (mem != r)
    children = F.collect_set(F.when(_op("GEP") & (mem == r), F.col("res"))).over(before)
    tracked = F.collect_set(F.when(stored, F.when(mem.rlike(v.PLACES), mem).otherwise(F.when(mem.startswith('{"GEP":'), v.base_of(mem))))).over(before)
    rows = rows.withColumn("cp", children).withColumn("tv", tracked)
    child, ends = F.array_contains("cp", mem), _op("Ret") & (F.col("idx") == F.col("last_idx"))
    in_call = _op("Call") & F.array_contains("args", r)
    in_bin = _op("Bin") & ((F.col("op0") == r) | (F.col("op1") == r))
    in_icmp = _op("ICmp") & ((F.col("op0") == r) | (F.col("op1") == r))
    derefed = (_op("Load") & ((mem == r) | child)) | (_op("Store") & ((mem == r) | (child & (val != r)))) | (_op("GEP") & (mem == r))
    found = rows.groupBy(*KEY).agg(
        any_(no(in_call) | no(in_bin) | no(in_icmp)).alias("used"), any_(in_call).alias("used_in_call"), any_(in_bin).alias("used_in_bin"), any_(stored).alias("stored"), any_(derefed).alias("derefed"),
        any_(ends & (F.col("op0") == r)).alias("returned"), any_(ends & (F.col("op0") != r) & F.array_contains("tv", F.col("op0"))).alias("indir_returned"),
    )
    return _complete(instrs, found)


def _complete(instrs: DataFrame, found: DataFrame) -> DataFrame:
    """Traces whose target is the last row have all flags false."""
    flags = [x for x in found.columns if x not in KEY]
    keys = instrs.filter("is_target").select(*KEY)
    return keys.join(found, KEY, "left").select(*KEY, *[no(F.col(x)).alias(x) for x in flags])


def _checks(rows: DataFrame, value: Column, partition: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Aggregates over rows, in order of idx, that tell how a value is compared and which way the branch on it goes."""
    running = Window.partitionBy(*partition).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    hit = _op("ICmp") & no((F.col("op0") == value) | (F.col("op1") == value))
    rows = rows.withColumn("_hit", hit).withColumn("_cmp", F.last(F.when(F.col("_hit"), F.struct(F.col("res").alias("res"), F.col("pred").alias("pred"), F.coalesce(v.number_of(F.col("op0")), v.number_of(F.col("op1"))).alias("number"))), ignorenulls=True).over(running))
    branch = _op("CondBr") & no(F.col("cond") == F.col("_cmp.res"))
    zero = branch & no(F.col("_cmp.number") == 0)
    decided = zero & F.col("_cmp.pred").isin("EQ", "NE")
    is_zero = (F.col("_cmp.pred") == "EQ") == (F.col("br") == "Then")
    last = F.max_by(F.when(decided, is_zero), F.when(decided, F.col("idx")))
    return rows, {"checked": any_(F.col("_hit")), "br_eq_zero": no(last), "br_neq_zero": no(~last), "compared_with_zero": any_(zero), "compared_with_non_const": any_(branch & F.col("_cmp.number").isNull())}


def ret_check(instrs: DataFrame) -> DataFrame:
    """How the target's result is checked; of several branches on zero the last decides. slice_checked: checked in any trace of the slice."""
    rows, found = _checks(with_target(instrs).filter(F.col("idx") > F.col("t")), F.col("r"), KEY)
    done = _complete(instrs, rows.groupBy(*KEY).agg(*[x.alias(k) for k, x in found.items()]))
    return done.withColumn("slice_checked", F.bool_or("checked").over(Window.partitionBy(*SLICE)))


def _arguments(instrs: DataFrame, i: int, depth: int) -> DataFrame:
    """Rows of traces whose target has an argument i, once for each of the values it stands for (arg, at)."""
    rows = with_target(instrs).withColumn("_a", F.get("targs", F.lit(i))).filter("_a is not null")
    return rows.select("*", F.posexplode(v.candidates(F.col("_a"), depth)).alias("at", "arg"))


def arg_pre(instrs: DataFrame, i: int = 0, lookahead: int = 5) -> DataFrame:
    """What argument i is and how it is checked before the call; a branch within ``lookahead`` rows of the comparison counts."""
    rows = _arguments(instrs, i, 3)
    ahead = Window.partitionBy(*KEY, "at").orderBy("idx").rowsBetween(1, lookahead)
    ways = F.collect_list(F.when(_op("CondBr"), F.struct("cond", "br"))).over(ahead)
    rows = rows.withColumn("kind", v.kind_of(F.col("arg"))).withColumn("ways", ways)
    # Once a value is constant, it and those after it are not checked.
    constant = F.min(F.when(F.col("kind") == "Const", F.col("at"))).over(Window.partitionBy(*KEY))
    rows = rows.withColumn("open", no(F.col("at") < constant) | constant.isNull())
    hit = _op("ICmp") & (F.col("idx") < F.col("t")) & F.col("open") & ((F.col("op0") == F.col("arg")) | (F.col("op1") == F.col("arg")))
    other = F.when(F.col("op0") == F.col("arg"), F.col("op1")).otherwise(F.col("op0"))
    zero = hit & v.is_zero(other)
    then = F.when(F.col("pred") == "EQ", "Then").when(F.col("pred") == "NE", "Else")
    way = lambda br: F.exists("ways", lambda x: (x["cond"] == F.col("res")) & (x["br"] == br))
    opposite = F.when(then == "Then", "Else").when(then == "Else", "Then")
    kind = lambda *names: any_(F.col("kind").isin(*names))
    return rows.groupBy(*KEY).agg(
        any_(hit).alias("checked"), any_(zero).alias("compared_with_zero"), any_(zero & way(then)).alias("arg_check_is_zero"), any_(zero & way(opposite)).alias("arg_check_not_zero"),
        kind("Arg").alias("is_arg"), kind("Const").alias("is_constant"), kind("Glob").alias("is_global"), kind("Alloc").alias("is_alloca"),
    )


def arg_post(instrs: DataFrame, i: int = 0) -> DataFrame:
    """What happens to argument i after the call, for each of the values it stands for in turn.

    A place that the argument is stored to is tracked, as is what is allocated there; of a GEP its location is tracked instead. What a value
    finds is remembered for those after it.
    """
    rows = _arguments(instrs, i, 5)
    before = Window.partitionBy(*KEY).orderBy("at", "idx").rowsBetween(Window.unboundedPreceding, -1)
    arg, mem, after = F.col("arg"), F.col("mem"), F.col("idx") > F.col("t")
    into = no(_op("Store") & (mem == arg))
    kept = after & _op("Store") & (F.col("val") == arg) & ~into
    place = F.when(mem.rlike(r'^\{"(Arg|Sym|Glob|Alloc)":'), mem).when(mem.startswith('{"GEP":'), F.get_json_object(mem, "$.GEP.loc"))
    children = F.collect_set(F.when(after & _op("GEP") & (mem == arg), F.col("res"))).over(before)
    places = F.collect_set(F.when(kept, place)).over(before)
    allocated = F.collect_set(F.when(kept, F.concat(F.lit('{"AllocOf":'), mem, F.lit("}")))).over(before)
    rows = rows.withColumn("cp", children).withColumn("tv", F.concat(places, allocated))
    child, ends = F.array_contains("cp", mem), _op("Ret") & (F.col("idx") == F.col("last_idx"))
    either = (F.col("op0") == arg) | (F.col("op1") == arg)
    in_call, in_check, in_bin = after & _op("Call") & F.array_contains("args", arg), after & _op("ICmp") & either, after & _op("Bin") & either
    derefed = after & (into | (_op("Load") & ((mem == arg) | child)) | (_op("Store") & no(F.col("val") != arg) & child))
    out = F.col("op0")
    return rows.groupBy(*KEY).agg(
        any_(no(in_call) | no(in_check) | no(in_bin) | no(derefed)).alias("used"), any_(in_call).alias("used_in_call"), any_(in_bin).alias("used_in_bin"), any_(in_check).alias("used_in_check"), any_(derefed).alias("derefed"),
        any_(after & ends & (out == arg)).alias("returned"), any_(after & ends & (out != arg) & (F.array_contains("tv", out) | out.contains(arg))).alias("indir_returned"),
    )


# Causality: functions called in the traces of a target, and how those calls relate to it.


def dictionary(instrs: DataFrame, exclude: str = r"__asan|__sanitizer|__kasan|printk") -> DataFrame:
    """target, func, weight: over the target's slices the share of traces that call func, summed."""
    size = with_target(instrs).select(*KEY).distinct().groupBy(*SLICE).agg(F.count("*").alias("n"))
    calls = with_target(instrs).filter(_op("Call") & ~F.col("func").rlike(exclude)).select(*KEY, "func").distinct().groupBy(*SLICE, "func").agg(F.count("*").alias("c"))
    return calls.join(size, SLICE).groupBy("target", "func").agg(F.sum(F.col("c") / F.col("n")).alias("weight"))


def top_functions(words: DataFrame, k: int = 5) -> DataFrame:
    """The k heaviest functions of each target."""
    w = Window.partitionBy("target").orderBy(F.round("weight", 9).desc(), "func")
    return words.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def causality(instrs: DataFrame, words: DataFrame, after: bool, depth: int = 2) -> DataFrame:
    """For each trace and function of the dictionary (target, func) how calls of it before or after the target relate to the target. The dictionary has few rows for each target."""
    rows = with_target(instrs)
    side = F.col("idx") > F.col("t") if after else F.col("idx") < F.col("t")
    calls = rows.filter(side & _op("Call")).join(words.select("target", "func"), ["target", "func"]).select(*KEY, "func", "idx", "res", "args", "r", "targs")
    unwrap = lambda a: F.flatten(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: v.candidates(x, depth)))
    mine, theirs = unwrap(F.col("args")), unwrap(F.col("targs"))
    returns = F.array_contains(mine, F.col("r")) if after else F.array_contains(theirs, F.col("res"))
    calls = calls.withColumn("_ret", no(returns)).withColumn("_arg", no(F.arrays_overlap(mine, theirs)))
    # How the result of each call is checked after it; of several calls with a result the one farthest from the target decides.
    later = calls.filter("res is not null").select(*KEY, "func", F.col("idx").alias("call_idx"), F.col("res").alias("value")).join(rows.drop("func"), KEY).filter(F.col("idx") > F.col("call_idx"))
    checked, found = _checks(later, F.col("value"), [*KEY, "func", "call_idx"])
    each = checked.groupBy(*KEY, "func", "call_idx").agg(found["checked"].alias("checked"), found["br_eq_zero"].alias("is_zero"), found["br_neq_zero"].alias("not_zero"))
    calls = calls.join(each.withColumnRenamed("call_idx", "idx"), [*KEY, "func", "idx"], "left")
    far = F.when(F.col("res").isNotNull(), F.col("idx") if after else -F.col("idx"))
    decided = lambda flag: no(F.max_by(no(F.col(flag)), far))
    hits = calls.groupBy(*KEY, "func").agg(
        F.lit(True).alias("invoked"), (F.count("*") > 1).alias("invoked_more_than_once"), any_(F.col("_ret")).alias("share_return"), any_(F.col("_arg")).alias("share_argument"),
        decided("checked").alias("checked"), decided("is_zero").alias("is_zero"), decided("not_zero").alias("not_zero"),
    )
    return unify(instrs.filter("is_target").select(*KEY), words, hits)


def unify(points: DataFrame, words: DataFrame, hits: DataFrame) -> DataFrame:
    """A row for each datapoint and function of its target's dictionary; flags that are not known are false."""
    flags = [x for x in hits.columns if x not in [*KEY, "func"]]
    every = points.join(words.select("target", "func"), "target")
    return every.join(hits, [*KEY, "func"], "left").select(*KEY, "func", *[no(F.col(x)).alias(x) for x in flags])
