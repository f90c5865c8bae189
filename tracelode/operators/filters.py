"""Predicates and slicing filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values as v

INTRINSIC = r"llvm\."
DUMMY = "dbg|eh|lifetime"
LEGACY_DUMMY = r"^(__.+|llvm\..+|__asan_.+)"
SANITIZERS = "__asan|__sanitizer|__kasan|printk"


def target_filter(name: Column, include: str | None = None, exclude: str | None = None, regex: bool = False) -> Column:
    """Included and not excluded; a pattern is searched for anywhere in the name cut at its first dot."""
    name = F.substring_index(name, ".", 1)
    hit = lambda p: name.rlike(p) if regex else name == p
    keep = F.lit(True) if include is None else hit(include)
    return keep if exclude is None else keep & ~hit(exclude)


def anchored_filter(name: Column, include: str | None = None, exclude: str | None = None) -> Column:
    """The same with patterns that match from the start of the whole name."""
    keep = F.lit(True) if include is None else v.prefix_match(name, include)
    return keep if exclude is None else keep & ~v.prefix_match(name, exclude)


def entry_location(filename: Column, pattern: str) -> Column:
    return filename.isNull() | filename.rlike(pattern)


def size_guard(blocks: Column, n_functions: Column, most: int = 1000) -> Column:
    """Whole blocks a function on average are below the limit; a slice without functions fails."""
    return F.coalesce(F.try_divide(blocks - blocks % F.nullif(n_functions, F.lit(0)), n_functions) < most, F.lit(False))


def not_intrinsic(name: Column) -> Column:
    return ~name.rlike(INTRINSIC)


def dummy(name: Column) -> Column:
    return name.rlike(DUMMY)


def legacy_dummy(name: Column) -> Column:
    return name.rlike(LEGACY_DUMMY)


def sanitizer(name: Column) -> Column:
    return name.rlike(SANITIZERS)


def causal_name(name: Column, exclude: str | None = None) -> Column:
    """Names that can stand in a dictionary: no expression, no register, no assembly."""
    keep = ~name.startswith("(") & ~name.startswith("%") & ~name.contains(" asm ")
    return keep if exclude is None else keep & ~name.rlike(exclude)


def pointer_only(ret_kind: Column, arg_kinds: Column) -> Column:
    return (ret_kind == "*") | F.exists(arg_kinds, lambda x: x == "*")


def applicable(ret_kind: Column, n_args: Column, arg_kinds: Column, extractors: int = 7) -> Column:
    """Names of the feature extractors that apply to a target."""
    names = F.when(ret_kind != "void", F.array(F.lit("ret"), F.lit("ret.check"))).otherwise(F.array().cast("array<string>"))
    args = [F.when(n_args > i, F.array(F.lit(f"arg.{i}.pre"), F.lit(f"arg.{i}.post"))).otherwise(F.array().cast("array<string>")) for i in range(extractors)]
    return F.concat(names, *args)


def pointer_argument(arg_kinds: Column, i: int) -> Column:
    return F.coalesce(F.get(arg_kinds, F.lit(i)) == "*", F.lit(False))


def min_frequency(slices: DataFrame, least: int, callee: str = "callee") -> DataFrame:
    return slices.withColumn("_n", F.count("*").over(Window.partitionBy(callee))).filter(F.col("_n") >= least).drop("_n")


def sampled(entries: DataFrame, location: Column, pattern: str, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Rows whose location matches, and of the others a share chosen by a seeded hash of the row."""
    luck = F.pmod(F.xxhash64(F.lit(seed), *entries.columns), F.lit(1 << 30)) < int(share * (1 << 30))
    return entries.filter(location.rlike(pattern) | luck)


def datapoints(points: DataFrame, bcs: Sequence[str] | None = None, slice_id: int | None = None, where: str | None = None) -> DataFrame:
    """Datapoints of some files and one slice (0 counts) for which a SQL expression over their columns holds."""
    if bcs is not None:
        points = points.filter(F.col("bc").isin(list(bcs)))
    if slice_id is not None:
        points = points.filter(F.col("slice_id") == slice_id)
    return points if where is None else points.filter(F.expr(where))


def has_context(instrs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and has_context: each argument of the target that is no constant is some result before it, or its result is used after it."""
    t = instrs.filter("is_target").select(*keys, F.col("idx").alias("t"), F.col("args").alias("targs"), F.col("res").alias("r"))
    rows = instrs.join(t, list(keys))
    made = F.array_distinct(F.collect_list(F.when(F.col("idx") < F.col("t"), F.col("res"))))
    uses = F.coalesce(F.array_contains("args", F.col("r")), F.lit(False)) | F.coalesce(F.col("r").isin(F.col("op0"), F.col("op1"), F.col("mem"), F.col("val")), F.lit(False))
    out = rows.groupBy(*keys).agg(F.first("targs").alias("targs"), made.alias("made"), F.coalesce(F.bool_or((F.col("idx") > F.col("t")) & uses), F.lit(False)).alias("used"))
    given = F.forall(F.filter("targs", lambda a: ~a.rlike(v.CONSTANTS)), lambda a: F.array_contains("made", a))
    return out.select(*keys, (given | F.col("used")).alias("has_context"))


def opens_file(name: Column) -> Column:
    """Functions that the file rule is for: fopen anywhere in the name's first line."""
    return name.rlike(r"\A.*fopen")
