"""Occurrence tables (bc, func, n), counts of slices and traces, and package queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values as v


def page(df: DataFrame, skip: int | None = None, limit: int | None = None, default: int = 50) -> DataFrame:
    """Rows skip to skip + limit of an ordered DataFrame; with skip alone, ``default`` rows."""
    if skip:
        return df.offset(skip).limit(default if limit is None else limit)
    return df if limit is None else df.limit(limit)


def top(occ: DataFrame, threshold: int = 0, skip: int | None = None, limit: int | None = None) -> DataFrame:
    """Functions by total count over all files, those with at least ``threshold``, most frequent first."""
    total = occ.groupBy("func").agg(F.sum("n").alias("n")).filter(F.col("n") >= threshold)
    return page(total.orderBy(F.desc("n"), "func"), skip, limit)


def function_total(occ: DataFrame, name: str | None = None, regex: str | None = None) -> DataFrame:
    """Counts by file of one function, or of those that a pattern matches from the start, and a row Total."""
    hit = F.col("func") == name if name is not None else v.prefix_match(F.col("func"), regex)
    return _with_total(occ.filter(hit))


def _with_total(occ: DataFrame) -> DataFrame:
    return occ.rollup("bc").agg(F.sum("n").alias("n"), F.grouping("bc").alias("g")).select(F.when(F.col("g") == 1, "Total").otherwise(F.col("bc")).alias("bc"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def intersection(occ: DataFrame, bcs: Sequence[str]) -> DataFrame:
    """Functions that occur in every one of the files, with the count in each (func, bc, n)."""
    some = occ.filter(F.col("bc").isin(list(bcs)))
    every = some.groupBy("func").agg(F.countDistinct("bc").alias("files")).filter(F.col("files") == len(set(bcs))).select("func")
    return some.join(every, "func", "left_semi").select("func", "bc", "n")


def call_sites(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Call sites of each function, 0 for those never called."""
    return functions.join(edges.groupBy(F.col("callee").alias("func")).agg(F.count("*").alias("n")), "func", "left").select("func", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def entries_total(edges: DataFrame) -> DataFrame:
    """For each callee the sum over its edges of entries at depth 1: the caller's callers, or the caller if nothing calls it."""
    callers = edges.groupBy(F.col("callee").alias("caller")).agg(F.countDistinct("caller").alias("up"))
    return edges.join(callers, "caller", "left").groupBy("callee").agg(F.sum(F.coalesce("up", F.lit(1).cast("long"))).alias("n"))


def slice_counts(traces: DataFrame) -> DataFrame:
    """Slices and traces for each target and file."""
    return traces.select("target", "bc", "slice_id", "trace_id").distinct().groupBy("target", "bc").agg(F.countDistinct("slice_id").alias("n_slices"), F.count("*").alias("n_traces"))


def traces_of_slices(traces: DataFrame, where: Column | None = None) -> DataFrame:
    keys = ["target", "bc", "slice_id", "trace_id"]
    return (traces if where is None else traces.filter(where)).select(keys).distinct().groupBy(keys[:3]).agg(F.count("*").alias("n_traces"))


def one_per_slice(datapoints: DataFrame, by_file: bool = True) -> DataFrame:
    """The first trace of each slice; by_file=False takes slices of one number for one slice, whatever their file."""
    key = ["target", "bc", "slice_id"] if by_file else ["target", "slice_id"]
    w = Window.partitionBy(*key).orderBy("bc", "trace_id")
    return datapoints.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def find_file(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted substring (part) the first file that contains it; wanted is a short list."""
    return files.select("bc").distinct().join(F.broadcast(wanted), F.col("bc").contains(F.col("part"))).groupBy("part").agg(F.min("bc").alias("bc"))


def package_status(packages: DataFrame) -> DataFrame:
    return packages.select("name", F.when(F.col("fetched"), "fetched").otherwise("not fetched").alias("fetch"), F.when(F.col("build_result") == "success", "built").otherwise(F.col("build_result")).alias("build"))


def package_files(packages: DataFrame, full: bool = False) -> DataFrame:
    """The bitcode files of built packages, in order (name, pos, bc)."""
    files = packages.select("name", F.posexplode("libs").alias("pos", "lib"))
    return files.select("name", "pos", (F.concat("name", F.lit("/source/"), "lib", F.lit(".bc")) if full else F.concat("lib", F.lit(".bc"))).alias("bc"))


def build_kind(source: Column, files: Column) -> Column:
    """How a package is built, from its kind of source and the names of its files."""
    has = lambda *names: F.arrays_overlap(files, F.array(*map(F.lit, names)))
    return F.when(source == "debian", "dpkg").when(has("configure", "config"), "config").when(has("Makefile", "makefile"), "makeonly").otherwise("unknown")


def library_name(path: Column) -> Column:
    """The name of a library from its path: the parts but the last two, joined by _."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), "_")


def deduplicated_names(df: DataFrame, name: str = "name", order: str = "path") -> DataFrame:
    """Names made distinct: the second and later of a name get _dedup and a number."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("lib", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_dedup"), (n - 1).cast("string"))))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of either side; where both have the key, the new side's values where it has any."""
    cols = [x for x in old.columns if x != key]
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[F.coalesce(f"n.{x}", f"o.{x}").alias(x) for x in cols])


def slice_totals(traces: DataFrame, bc_part: str | None = None) -> DataFrame:
    """Slices and traces at every grouping: of a target in a file, of a target, of a file, and of all (null where summed over); bc_part: only files whose name contains it."""
    own = traces if bc_part is None else traces.filter(F.col("bc").contains(bc_part))
    per = own.select("target", "bc", "slice_id", "trace_id").distinct().groupBy("target", "bc", "slice_id").agg(F.count("*").alias("n"))
    return per.cube("target", "bc").agg(F.count("*").alias("n_slices"), F.sum("n").alias("n_traces"))


def function_types(definitions: DataFrame) -> DataFrame:
    """func, type: the type of each function in the first package that defines it (definitions: pos, func, type; ties by type)."""
    return definitions.groupBy("func").agg(F.min_by("type", F.struct("pos", "type")).alias("type"))


def input_kind(name: Column, is_folder: Column) -> Column:
    """What an input is taken for: a list of packages, a bitcode file, a folder of sources, or the name of a package."""
    return F.when(name.contains(".json"), "list").when(name.contains(".bc"), "bitcode").when(is_folder, "folder").otherwise("debian")


def build_state(n_libs: Column, n_files: Column) -> Column:
    """The result of a build by what it left: libraries, and bitcode files in them."""
    return F.when(n_libs == 0, "nolibs").when(n_files == 0, "nobc").otherwise("success")


def alarms_of_points(alarms: DataFrame, points: DataFrame) -> DataFrame:
    """Alarms (bc, slice_id, trace_id, score) with their datapoints (dp_id, target, ...), those of unknown traces left out."""
    return alarms.join(points, ["bc", "slice_id", "trace_id"])
