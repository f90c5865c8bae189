"""The database of an analysis: a directory of JSON documents and tables, and its sources and sinks.

Layout: packages/<name>/index.json; analysis/occurrences/<bc>.json; analysis/{slices,traces,features}/<target>/<bc>/...
JSON documents are read with declared schemas; what the engine writes itself are versioned tables (``versions``) by target and file.

Documents are looked up by key: only the files of the key are listed and opened. A target that the database doesn't have, or a full key without document, raises
KeyError; parts of a key that are given as a range of ids take what is there.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions

MARKER = ".tracelode"
SOURCE = "struct<src_type:string,link:string>"
BUILD = "struct<build_type:string,build_dir:string,result:string,libs:array<string>>"
PACKAGE = f"name string, pkg_src {SOURCE}, fetched boolean, pkg_dir string, build {BUILD}"
SLICE = "entry string, caller string, callee string, instr string, functions array<string>"
TRACE = "instrs array<struct<loc:string,sem:string,res:string>>, target int, statically_checked boolean, labels array<string>"
ALARM = "bc string, slice_id long, trace_id long, score double, alarms string, attempt int"


class Workspace:
    """A database directory on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        if not self._exists(f"{self.root}/{MARKER}"):
            raise FileNotFoundError(f"{root} is no database: it lacks {MARKER}")
        self.versions = Versions(spark, f"{self.root}/tables")

    @classmethod
    def init(cls, spark: SparkSession, root: str) -> Workspace:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{MARKER}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True).close()
        return cls(spark, root)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return bool(fs.globStatus(p)) if "*" in path else fs.exists(p)

    def _json(self, pattern: str, schema: str) -> DataFrame:
        path = f"{self.root}/{pattern}"
        reader = self.spark.read.schema(schema).option("multiLine", True)
        return (reader.json(path) if self._exists(path) else self.spark.createDataFrame([], schema)).withColumn("_path", F.col("_metadata.file_path") if self._exists(path) else F.lit(""))

    def packages(self) -> DataFrame:
        """Package indexes with the defaults of fields that are missing."""
        p = self._json("packages/*/index.json", PACKAGE).drop("_path")
        build = F.struct(F.coalesce("build.build_type", F.lit("unknown")).alias("build_type"), F.coalesce("build.build_dir", F.lit("")).alias("build_dir"), F.coalesce("build.result", F.lit("notbuilt")).alias("result"), F.coalesce("build.libs", F.array().cast("array<string>")).alias("libs"))
        return p.select("name", "pkg_src", F.coalesce("fetched", F.lit(False)).alias("fetched"), "pkg_dir", build.alias("build"))

    def manifest(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"name string, pkg_src {SOURCE}").option("multiLine", True).json(path)

    def extraction_manifest(self, path: str) -> DataFrame:
        """func, package, n_slices of a manifest for several packages."""
        m = self.spark.read.schema("functions array<struct<name:string,occurrences:array<array<string>>>>").option("multiLine", True).json(path)
        f = m.select(F.explode("functions").alias("f")).select(F.col("f.name").alias("func"), F.explode("f.occurrences").alias("o"))
        return f.select("func", F.get("o", F.lit(0)).alias("package"), F.get("o", F.lit(1)).cast("long").alias("n_slices"))

    def bitcode(self, folder: str, name: str = "*.bc") -> DataFrame:
        """path, length and content of bitcode files under a folder."""
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folder)

    def occurrences(self, bcs: list[str] | None = None) -> DataFrame:
        """bc, func, n from one JSON object for each file; files without one are left out."""
        path = f"{self.root}/analysis/occurrences/*.json"
        if not self._exists(path):
            return self.spark.createDataFrame([], "bc string, func string, n long")
        rows = self.spark.read.text(path, wholetext=True).select(_stem("bc"), F.explode(F.from_json("value", "map<string,bigint>")).alias("func", "n"))
        return rows if bcs is None else rows.filter(F.col("bc").isin(bcs))

    def slices(self, target: str = "*") -> DataFrame:
        s = self._json(f"analysis/slices/{target}/*/*.json", SLICE)
        return s.select(_part(3).alias("target"), _part(2).alias("bc"), _number(1).alias("slice_id"), *[x.split()[0] for x in SLICE.split(", ")])

    def traces(self, target: str = "*") -> DataFrame:
        t = self._json(f"analysis/traces/{target}/*/*/*.json", TRACE)
        return t.select(_part(4).alias("target"), _part(3).alias("bc"), _number(2).alias("slice_id"), _number(1).alias("trace_id"), F.col("target").alias("target_idx"), "instrs", "statically_checked", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))

    def features(self, target: str = "*") -> DataFrame:
        """Feature documents as canonical JSON, by key."""
        path = f"{self.root}/analysis/features/{target}/*/*/*.json"
        if not self._exists(path):
            return self.spark.createDataFrame([], "target string, bc string, slice_id long, trace_id long, doc string")
        rows = self.spark.read.text(path, wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
        return rows.select(_part(4).alias("target"), _part(3).alias("bc"), _number(2).alias("slice_id"), _number(1).alias("trace_id"), F.to_json(F.parse_json("value")).alias("doc"))

    def _paths(self, kind: str, key: list[str | int | range | None]) -> list[str]:
        """Files of documents by key: a value, a range of ids, or None for all; each level lists only the folders that fit."""
        fs, top = self._fs(f"{self.root}/analysis/{kind}")
        found = [top] if fs.exists(top) else []
        for depth, part in enumerate(key):
            last, below = depth == len(key) - 1, []
            for p in found:
                if isinstance(part, str | int):
                    child = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, f"{part}.json" if last else str(part))
                    below += [child] if fs.exists(child) else []
                    continue
                for status in fs.listStatus(p):
                    name = status.getPath().getName().removesuffix(".json") if last else status.getPath().getName()
                    if part is None or (name.isdigit() and int(name) in part):
                        below.append(status.getPath())
            if not below and depth == 0:
                raise KeyError(f"no function {key[0]} in the database")
            found = below
        return [p.toString() for p in found]

    def _documents(self, kind: str, key: list[str | int | range | None]) -> DataFrame:
        """value, the text of each document, and its path."""
        paths = self._paths(kind, key)
        if not paths and all(isinstance(x, str | int) for x in key):
            raise KeyError(f"no {kind[:-1]} {'/'.join(map(str, key))}")
        if not paths:
            return self.spark.createDataFrame([], "value string, _path string")
        return self.spark.read.text(paths, wholetext=True).withColumn("_path", F.col("_metadata.file_path"))

    def find_slices(self, target: str, bc: str | None = None, slice_id: int | range | None = None) -> DataFrame:
        rows = self._documents("slices", [target, bc, slice_id])
        doc = F.from_json("value", SLICE)
        return rows.select(_part(3).alias("target"), _part(2).alias("bc"), _number(1).alias("slice_id"), *[doc[x.split()[0]].alias(x.split()[0]) for x in SLICE.split(", ")])

    def find_traces(self, target: str, bc: str | None = None, slice_id: int | range | None = None, trace_id: int | range | None = None) -> DataFrame:
        rows = self._documents("traces", [target, bc, slice_id, trace_id])
        doc = F.from_json("value", TRACE)
        return rows.select(_part(4).alias("target"), _part(3).alias("bc"), _number(2).alias("slice_id"), _number(1).alias("trace_id"), doc["target"].alias("target_idx"), doc["instrs"].alias("instrs"), doc["statically_checked"].alias("statically_checked"), F.coalesce(doc["labels"], F.array().cast("array<string>")).alias("labels"))

    def find_features(self, target: str, bc: str | None = None, slice_id: int | range | None = None, trace_id: int | range | None = None) -> DataFrame:
        rows = self._documents("features", [target, bc, slice_id, trace_id])
        return rows.select(_part(4).alias("target"), _part(3).alias("bc"), _number(2).alias("slice_id"), _number(1).alias("trace_id"), F.to_json(F.parse_json("value")).alias("doc"))

    def find_datapoints(self, target: str, bc: str | None = None, slice_id: int | range | None = None, trace_id: int | range | None = None) -> DataFrame:
        """Traces with slices and features, where a feature document is there; files of other keys are not opened."""
        key = ["target", "bc", "slice_id"]
        f = self.find_features(target, bc, slice_id, trace_id)
        return self.find_traces(target, bc, slice_id, trace_id).join(self.find_slices(target, bc, slice_id), key).join(f, [*key, "trace_id"])

    def datapoints(self, target: str = "*") -> DataFrame:
        """Traces with their slices, those that have features."""
        key = ["target", "bc", "slice_id"]
        return self.traces(target).join(self.slices(target), key).join(self.features(target).select(*key, "trace_id"), [*key, "trace_id"], "left_semi")

    def alarms(self, path: str) -> DataFrame:
        return self.spark.read.schema(ALARM).option("header", True).csv(path)

    # Sinks.

    def save(self, df: DataFrame, name: str, by: tuple[str, ...] = ("target", "bc"), append: bool = False) -> int:
        """Make a table hold these rows (or add them); the number of the version."""
        return self.versions.commit({name: df}, by, append=append).number

    def save_all(self, tables: dict[str, DataFrame], by: tuple[str, ...] = ("target", "bc")) -> int:
        """Several tables in one version."""
        return self.versions.commit(tables, by).number

    def load(self, name: str, version: int | None = None, **values: str) -> DataFrame:
        """A table as it is now or as a version had it; with values of its partitions only their files are opened."""
        return (self.versions.latest() if version is None else self.versions.at(version)).read(name, **values)

    def save_json(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").json(f"{self.root}/json/{name}")

    def save_alarms(self, alarms: DataFrame, exp: str, match: bool = False) -> None:
        """alarms.csv, or match.csv with score 0 and the attempt."""
        out = alarms.select("bc", "slice_id", "trace_id", F.lit(0.0).alias("score"), "alarms", "attempt").orderBy("attempt") if match else alarms.select("bc", "slice_id", "trace_id", "score", "alarms").orderBy("score", "bc", "slice_id", "trace_id")
        out.write.mode("overwrite").option("header", True).csv(f"{self.root}/learning/{exp}/{'match' if match else 'alarms'}.csv")

    def slice_counts(self) -> DataFrame:
        """target, n_slices: from the names of the slice files alone, which are not read."""
        path = f"{self.root}/analysis/slices/*/*/*.json"
        if not self._exists(path):
            return self.spark.createDataFrame([], "target string, n_slices long")
        files = self.spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", r"\.json$", "").alias("_path"))
        return files.groupBy(_part(3).alias("target")).agg(F.count("*").alias("n_slices"))

    def save_occurrences(self, occurrences: DataFrame, location: str | None = None, pointer: bool = False) -> str:
        """One JSON object {function: count} for each file, under file=<bc>[_<location>][_ptr]."""
        name = F.concat(F.col("bc"), F.lit(f"_{location}" if location else ""), F.lit("_ptr" if pointer else ""))
        rows = occurrences.groupBy(name.alias("file")).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("func", "n"))))).alias("value"))
        path = f"{self.root}/analysis/occurrence_tables"
        rows.write.mode("overwrite").partitionBy("file").text(path)
        return path

    def save_occurrence_list(self, occurrences: DataFrame, name: str) -> str:
        """func, n over all files, most frequent first, as CSV."""
        path = f"{self.root}/analysis/{name}.csv"
        occurrences.groupBy("func").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "func").write.mode("overwrite").option("header", True).csv(path)
        return path

    def save_learning(self, exp: str, unified: list[str], vectors: DataFrame, model: dict, mask: list[bool] | None = None, fitness: float | None = None) -> None:
        """What an experiment leaves: the unified feature names, the vectors, the model's parameters, and mask and fitness of a feature choice."""
        base = f"{self.root}/learning/{exp}"
        said = json.dumps({"unified": unified, "model": model, "mask": mask, "fitness": fitness})
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/learned.json")
        vectors.write.mode("overwrite").parquet(f"{base}/vectors")

    def load_learning(self, exp: str) -> tuple[dict, DataFrame]:
        """The names, model, mask and fitness that ``save_learning`` wrote, and the vectors."""
        base = f"{self.root}/learning/{exp}"
        return json.loads(self.spark.read.text(f"{base}/learned.json").first()["value"]), self.spark.read.parquet(f"{base}/vectors")

    def relabel(self, chosen: DataFrame, label: str, erase: bool = False, name: str = "labels") -> int:
        """Add a label to, or erase it from, the traces of the chosen keys, in place: only the partitions with such traces are written anew."""
        from ..operators import labels
        from .relations import KEY

        return self.versions.update(name, chosen, lambda rows, keys: labels.relabel(rows, KEY, keys, label, erase)).number

    def remove(self, *names: str, target: str, bc: str | None = None) -> int:
        """Drop what the tables (all of them, if none are named) hold on a target, or on it and a file, in one version."""
        tables = self.versions.latest().tables
        chosen = [n for n in names or tables if n not in tables or "target" in tables[n]["by"]]
        return self.versions.drop(chosen, target=target, **({} if bc is None else {"bc": bc})).number

    def clear_file(self, name: str, bc: str) -> int:
        return self.versions.drop([name], bc=bc).number

    def append_batches(self, name: str, batches: DataFrame) -> int:
        """Commit slices of several batches (batch, local_id, callee, ...) with ids renumbered for each callee after those there are; of two that do so at once, one is told of the conflict and can do it again."""
        from pyspark.sql.window import Window

        now = self.versions.latest()
        there = now.read(name).groupBy("callee").agg((F.max("slice_id") + 1).alias("_from")) if name in now.tables else self.spark.createDataFrame([], "callee string, _from long")
        n = F.row_number().over(Window.partitionBy("callee").orderBy("batch", "local_id")) - 1
        out = batches.join(there, "callee", "left").withColumn("slice_id", (n + F.coalesce("_from", F.lit(0))).cast("long")).drop("_from", "batch", "local_id")
        return self.versions.commit({name: out}, ["callee"], before=now, append=True).number


def _segments() -> Column:
    return F.split(F.regexp_replace("_path", r"\.json$", ""), "/")


def _part(back: int) -> Column:
    return F.try_element_at(_segments(), F.lit(-back))


def _number(back: int) -> Column:
    return _part(back).try_cast("long")


def _stem(name: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias(name)


def long_traces(traces: DataFrame) -> DataFrame:
    """The long table of instructions from traces read from files."""
    rows = traces.select("target", "bc", "slice_id", "trace_id", "target_idx", F.posexplode("instrs").alias("idx", "i"))
    g = lambda path: F.get_json_object("i.sem", path)
    kind = F.get(F.json_object_keys("i.sem"), F.lit(0))
    of = lambda *ops, path: F.coalesce(*[g(f"$.{op}.{path}") for op in ops])
    value = lambda c: F.to_json(F.try_parse_json(F.when(c.startswith("{") | c.startswith("["), c).when(c.isNotNull(), F.concat(F.lit('"'), c, F.lit('"')))))
    return rows.select(
        "target", "bc", "slice_id", "trace_id", "idx", (F.col("idx") == F.col("target_idx")).alias("is_target"), F.col("i.loc").alias("loc"), kind.alias("op"),
        g("$.Call.func.Func").alias("func"), F.transform(F.from_json(g("$.Call.args"), "array<string>"), value).alias("args"), g("$.ICmp.pred").alias("pred"),
        F.coalesce(value(g("$.ICmp.op0")), value(g("$.Bin.op0")), value(g("$.Ret.op"))).alias("op0"), F.coalesce(value(g("$.ICmp.op1")), value(g("$.Bin.op1"))).alias("op1"),
        value(g("$.CondBr.cond")).alias("cond"), g("$.CondBr.br").alias("br"), F.coalesce(g("$.CondBr.beg_loop").cast("boolean"), F.lit(False)).alias("beg_loop"), F.coalesce(g("$.UncondBr.end_loop").cast("boolean"), F.lit(False)).alias("end_loop"),
        value(of("Store", "Load", "GEP", path="loc")).alias("mem"), value(g("$.Store.val")).alias("val"), value(F.col("i.res")).alias("res"),
    )
