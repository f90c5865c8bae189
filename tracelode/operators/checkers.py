"""Checkers by majority: what most traces of a target do is right, what few do is an alarm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values as v
from ..sources.relations import KEY
from . import filters
from .features import any_, no, with_target


def retval_results(instrs: DataFrame) -> DataFrame:
    """key, result: the first comparison of the target's result with a constant after the call, "Checked(pred,const)" with NE told as EQ, or "NoCheck"."""
    return _first_check(with_target(instrs).withColumn("x", F.col("r")), F.col("idx") > F.col("t"), F.col("idx"))


def argval_results(instrs: DataFrame, i: int = 0) -> DataFrame:
    """The same for argument i before the call, the nearest comparison counting."""
    rows = with_target(instrs).withColumn("x", F.get("targs", F.lit(i))).filter("x is not null")
    return _first_check(rows, F.col("idx") < F.col("t"), -F.col("idx"))


def _first_check(rows: DataFrame, side: Column, order: Column) -> DataFrame:
    other = F.when(F.col("op0") == F.col("x"), F.col("op1")).when(F.col("op1") == F.col("x"), F.col("op0"))
    number = v.number_of(other)
    hit = no(side & (F.col("op") == "ICmp") & number.isNotNull())
    pred = F.when(F.col("pred") == "NE", "EQ").otherwise(F.col("pred"))
    text = F.concat(F.lit("Checked("), pred, F.lit(","), number.cast("string"), F.lit(")"))
    return rows.groupBy(*KEY).agg(F.coalesce(F.min_by(F.when(hit, text), F.when(hit, order)), F.lit("NoCheck")).alias("result"))


def causality_results(words: DataFrame, hits: DataFrame) -> DataFrame:
    """key, func, result: whether each function of the dictionary is called ("Causing f") or not ("None"); hits: from features.causality."""
    return hits.select(*KEY, "func", F.when(F.col("invoked"), F.concat(F.lit("Causing "), F.col("func"))).otherwise("None").alias("result"))


def branch_results(instrs: DataFrame) -> DataFrame:
    """key, idx, result: how each comparison after the target treats its result: against a constant with the branch taken and whether it follows at once, against a variable, or another variable."""
    rows = with_target(instrs).filter(F.col("idx") > F.col("t"))
    ahead = Window.partitionBy(*KEY).orderBy("idx").rowsBetween(1, 5)
    way = F.get(F.filter(F.collect_list(F.struct("op", "cond", "br", "idx")).over(ahead), lambda x: (x["op"] == "CondBr") & (x["cond"] == F.col("res"))), F.lit(0))
    rows = rows.withColumn("way", way).filter("op = 'ICmp'")
    mine = no((F.col("op0") == F.col("r")) | (F.col("op1") == F.col("r")))
    number = F.coalesce(v.number_of(F.col("op0")), v.number_of(F.col("op1")))
    said = F.concat_ws(",", F.col("pred"), number.cast("string"), F.coalesce("way.br", F.lit("-")), F.when(F.col("way.idx") == F.col("idx") + 1, "now").otherwise("later"))
    return rows.select(*KEY, "idx", F.when(mine & number.isNotNull(), F.concat(F.lit("Checked("), said, F.lit(")"))).when(mine, "CheckedAgainstVar").otherwise("CheckedOtherVar").alias("result"))


def stats(results: DataFrame, by: str = "target") -> DataFrame:
    """by, result, n and total: how often each result occurs, and all results."""
    counted = results.groupBy(by, "result").agg(F.count("*").alias("n"))
    return counted.withColumn("total", F.sum("n").over(Window.partitionBy(by)))


def scores(results: DataFrame, by: str = "target") -> DataFrame:
    """key, result, score: the least over the trace's results of 1 - n / total. The counts are few, results many."""
    s = stats(results, by)
    per = results.join(s, [by, "result"]).withColumn("score", 1 - F.col("n") / F.col("total"))
    return per.groupBy(*KEY).agg(F.min_by("result", F.struct("score", "result")).alias("result"), F.min("score").alias("score"))


def bugs(scored: DataFrame, problematic: Column, threshold: float = 0.9) -> DataFrame:
    return scored.filter(problematic & (F.col("score") > threshold))


def fopen_rule(instrs: DataFrame, closing: str = "fclose", writing: str = "fputs", opens: Column | None = None) -> DataFrame:
    """key, verdict: Ok or Alarm for a call that opens a file, by the first comparison after it.

    On the branch where the result is null nothing may be closed or written to; where it isn't, the file must be closed; a
    result that isn't compared with null, or whose branch doesn't follow at once, is an alarm. Traces without rows after the call are alarms too.
    opens: for which targets the rule is; by default those with fopen in their names.
    """
    instrs = instrs.filter(filters.opens_file(F.col("target")) if opens is None else opens)
    rows = with_target(instrs)
    later = (F.col("idx") > F.col("t")) & (F.col("op") == "Call")
    calls = rows.groupBy(*KEY).agg(any_(later & (F.col("func") == closing)).alias("closed"), any_(later & (F.col("func") == writing)).alias("wrote"))
    first = branch_results(instrs).groupBy(*KEY).agg(F.min_by("result", "idx").alias("first"))
    is_null = F.col("first").isin("Checked(EQ,0,Then,now)", "Checked(NE,0,Else,now)")
    not_null = F.col("first").isin("Checked(EQ,0,Else,now)", "Checked(NE,0,Then,now)")
    ok = no(is_null & ~F.col("closed") & ~F.col("wrote")) | no(not_null & F.col("closed"))
    return calls.join(first, KEY, "left").select(*KEY, F.when(ok, "Ok").otherwise("Alarm").alias("verdict"))


def matches(features: DataFrame, predicate: str) -> DataFrame:
    """Datapoints that satisfy a specification, a SQL expression over feature columns; an alarm is one that does not."""
    return features.withColumn("is_alarm", ~no(F.expr(predicate)))


class Checker:
    """A checker that plugs into ``run``: which targets it is for, what it finds in a trace, and which results are problematic."""

    name: str
    #: The result of a trace in which nothing is found; with None such a trace has no result.
    default: str | None = "NoCheck"

    def applies(self, returns: Column, kinds: Column) -> Column:
        """Whether a target with such a result and arguments (an array of kinds, "*" for a pointer) is checked."""
        return F.lit(True)

    def results(self) -> Column:
        """Aggregate over a trace's rows (with t, r and targs): an array of results, empty or null if nothing is found."""
        raise NotImplementedError

    def present(self) -> Column:
        """Aggregate: whether a trace has what is checked; without it there is no result, not even the default."""
        return F.lit(True)

    def problematic(self, result: Column) -> Column:
        return result == self.default


def _checked(value: Column, side: Column, order: Column) -> Column:
    other = F.when(F.col("op0") == value, F.col("op1")).when(F.col("op1") == value, F.col("op0"))
    number = v.number_of(other)
    hit = no(side & (F.col("op") == "ICmp") & number.isNotNull())
    text = F.concat(F.lit("Checked("), F.when(F.col("pred") == "NE", "EQ").otherwise(F.col("pred")), F.lit(","), number.cast("string"), F.lit(")"))
    first = F.min_by(F.when(hit, text), F.when(hit, order))
    return F.when(first.isNotNull(), F.array(first))


class ReturnValue(Checker):
    """The first comparison of the target's result with a constant after the call."""

    name = "retval"

    def applies(self, returns: Column, kinds: Column) -> Column:
        return returns != "void"

    def results(self) -> Column:
        return _checked(F.col("r"), F.col("idx") > F.col("t"), F.col("idx"))


class ArgumentValue(Checker):
    """The nearest comparison of argument i with a constant before the call; for pointers only."""

    def __init__(self, i: int) -> None:
        self.i, self.name = i, f"argval-{i}"

    def applies(self, returns: Column, kinds: Column) -> Column:
        return F.get(kinds, F.lit(self.i)) == "*"

    def results(self) -> Column:
        found = _checked(F.get("targs", F.lit(self.i)), F.col("idx") < F.col("t"), -F.col("idx"))
        return F.coalesce(found, F.array().cast("array<string>"))

    def present(self) -> Column:
        return F.max(F.get("targs", F.lit(self.i))).isNotNull()


class ArgumentRelation(Checker):
    """Pairs of different arguments of the target that use a symbol or a call's result in common."""

    name, default = "argrel", "NoRelation"

    def results(self) -> Column:
        args = F.max(F.when(F.col("is_target"), F.col("targs")))
        used = F.transform(args, v.symbols)
        pairs = F.flatten(F.transform(used, lambda a, i: F.filter(F.transform(used, lambda b, j: F.when((i != j) & F.arrays_overlap(a, b), F.concat(F.lit("Relation("), i.cast("string"), F.lit(","), j.cast("string"), F.lit(")")))), lambda x: x.isNotNull())))
        return pairs


class Called(Checker):
    """Functions called after the target, one result for each."""

    name, default = "causality", "None"

    def results(self) -> Column:
        call = (F.col("idx") > F.col("t")) & (F.col("op") == "Call")
        return F.transform(F.array_sort(F.collect_set(F.when(call, F.col("func")))), lambda f: F.concat(F.lit("Causing("), f, F.lit(")")))


def standard(arguments: int = 4) -> list[Checker]:
    return [ReturnValue(), *[ArgumentValue(i) for i in range(arguments)], ArgumentRelation(), Called()]


def run(instrs: DataFrame, checkers: Sequence[Checker], types: DataFrame | None = None) -> DataFrame:
    """key, checker and result of all checkers from one grouping of the instructions by trace.

    types: target, returns and kinds, a row for each target; without it every checker is for every target. A trace in which a checker finds nothing
    has the checker's default, or no row if that is None; nor has it one if the checker isn't for the target or what it checks isn't there.
    """
    rows = with_target(instrs)
    found = rows.groupBy(*KEY).agg(F.lit(1).alias("_one"), *[x for i, c in enumerate(checkers) for x in (c.results().alias(f"c{i}"), c.present().alias(f"p{i}"))])
    for i, c in enumerate(checkers):
        none = F.lit(None) if c.default is None else F.array(F.lit(c.default))
        full = F.when(F.coalesce(F.size(f"c{i}"), F.lit(0)) > 0, F.col(f"c{i}")).otherwise(none)
        found = found.withColumn(f"c{i}", F.when(F.col(f"p{i}"), full))
    if types is not None:
        fits = types.select("target", *[c.applies(F.col("returns"), F.col("kinds")).alias(f"f{i}") for i, c in enumerate(checkers)])
        found = found.join(fits, "target", "left").withColumns({f"c{i}": F.when(F.col(f"f{i}"), F.col(f"c{i}")) for i in range(len(checkers))})
    each = F.filter(F.array(*[F.struct(F.lit(c.name).alias("checker"), F.col(f"c{i}").alias("results")) for i, c in enumerate(checkers)]), lambda x: x["results"].isNotNull())
    return found.select(*KEY, F.explode(each).alias("e")).select(*KEY, "e.checker", F.explode("e.results").alias("result"))


def scored(results: DataFrame) -> DataFrame:
    """The results of ``run`` with n and total (how often each occurs for its checker and target, and all of them) and score, 1 - n / total."""
    counted = results.groupBy("checker", "target", "result").agg(F.count("*").alias("n"))
    counted = counted.withColumn("total", F.sum("n").over(Window.partitionBy("checker", "target")))
    return results.join(counted, ["checker", "target", "result"]).withColumn("score", 1 - F.col("n") / F.col("total"))


def flagged(found: DataFrame, checkers: Sequence[Checker], threshold: float = 0.9) -> DataFrame:
    """Of ``scored``, the problematic results whose score is above the threshold."""
    bad = F.lit(False)
    for c in checkers:
        bad = bad | ((F.col("checker") == c.name) & no(c.problematic(F.col("result"))))
    return found.filter(bad & (F.col("score") > threshold))
