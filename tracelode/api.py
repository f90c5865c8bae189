"""The engine as one object: what a user does from collecting packages to looking at alarms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import checkers, evaluate, extractors, features, filters, graph, labels, learn, occurrence, symbolic, vectors
from .sources.catalog import Workspace, long_traces
from .sources.relations import KEY
from .streaming import state

#: Between a file's name and a function's, where functions of several files meet in one graph.
MARK = "\x1f"
#: Learners that need no labels, those that do, and those that ask for them.
UNSUPERVISED = {"one-class": learn.one_class, "isolation-forest": learn.isolation_forest}
SUPERVISED = {"svc": learn.svc}
ACTIVE = ("kde", "random")


class Engine:
    """Verbs over a database directory."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.db = spark, Workspace(spark, root)

    @classmethod
    def init(cls, spark: SparkSession, root: str) -> Engine:
        Workspace.init(spark, root)
        return cls(spark, root)

    # collect

    def collect(self, manifest: str) -> DataFrame:
        """Packages of a manifest joined into the index; what is there stays."""
        new = self.db.manifest(manifest).select("name", "pkg_src", F.lit(None).cast("boolean").alias("fetched"))
        out = occurrence.upsert(self.db.packages().select("name", "pkg_src", "fetched"), new, "name")
        return out.withColumn("fetched", F.coalesce("fetched", F.lit(False)))

    # analyze

    def slice(self, edges: DataFrame, include: str | None = None, exclude: str | None = None, regex: bool = False, slice_depth: int = 1, types: DataFrame | None = None, entry_file: str | None = None, files: DataFrame | None = None) -> int:
        """Slices around the calls of all targets that the filter keeps, of each file by itself; the number of the version.

        edges: bc, edge_id, caller, callee. types: func and type, one row each; with them a slice keeps the functions from which one that has a struct type in common with the target is
        reached, without them all. entry_file: only entries in files that match (files: bc, func, file, a row each).
        """
        own = lambda c: F.concat("bc", F.lit(MARK), c)
        edges = edges.filter(filters.not_intrinsic(F.col("callee")))
        keep = filters.target_filter(F.col("callee"), include, exclude, regex)
        marked = edges.withColumn("_keep", keep).select("bc", "edge_id", own("caller").alias("caller"), own("callee").alias("callee"), "_keep")
        targets = marked.filter("_keep").select(F.col("callee").alias("target")).distinct()
        marked = marked.select(F.concat("bc", F.lit(MARK), "edge_id").alias("edge_id"), "caller", "callee")
        found = graph.edge_entries(marked, targets, slice_depth)
        if entry_file is not None and files is not None:
            found = graph.of_entries(found, files.select(own("func").alias("entry"), "file"), entry_file)
        members = graph.reachable(marked, found.select("target", "entry").distinct(), 2 * slice_depth)
        if types is not None:
            bcs = edges.select("bc").distinct()
            of_file = bcs.join(types, F.lit(True)).select(own("func").alias("func"), "type")
            kept = graph.reduced(graph.related_by_structs(members, of_file), marked, 2 * slice_depth, F.col("related")).select("target", "entry", "func")
            members = kept.unionByName(members.filter("func = entry").select("target", "entry", "func")).distinct()
        bare = lambda c: F.substring_index(c, MARK, -1)
        bodies = members.groupBy("target", "entry").agg(F.sort_array(F.collect_set(bare("func"))).alias("functions"))
        full = found.join(bodies, ["target", "entry"]).select(bare("target").alias("target"), F.substring_index("target", MARK, 1).alias("bc"), bare("edge_id").alias("edge_id"), bare("caller").alias("caller"), bare("entry").alias("entry"), "functions")
        return self.db.save(graph.numbered_slices(full, ("target", "bc")), "slices")

    def analyze(self, ir: DataFrame, edges: DataFrame, dictionary_size: int = 5, limits: symbolic.Limits = symbolic.Limits(), path_constraints: bool = True, **slicing) -> None:
        """Slices (see ``slice``), traces and features, written to the database."""
        self.slice(edges, **slicing)
        self.db.save(symbolic.execute(self.db.load("slices"), ir, limits, path_constraints), "traces")
        self.extract(dictionary_size)

    def extract(self, dictionary_size: int = 5, types: DataFrame | None = None, more: Sequence[extractors.Extractor] = ()) -> int:
        """Features of the traces in the database, in one pass: a struct for each extractor. more: extractors of one's own; types: see extractors.run."""
        ti = self.db.load("traces")
        words = graph.written(features.top_functions(features.dictionary(ti), dictionary_size), "words")
        out = extractors.run(ti, [*extractors.standard(dictionary_size, words=words), *more], types)
        return self.db.save_all({"features": out, "words": words.withColumn("bc", F.lit(""))})

    def find_occurrences(self, functions: DataFrame, edges: DataFrame, location: str | None = None, pointer: bool = False) -> str:
        """Call sites of each function by file, written as one document for each file. functions: bc, func, returns, kinds; location: only calls whose edge_id contains it; pointer: only functions with a pointer in their type."""
        some = functions.filter(filters.pointer_only(F.col("returns"), F.col("kinds"))) if pointer else functions
        calls = edges if location is None else edges.filter(F.col("edge_id").contains(location))
        n = calls.groupBy("bc", F.col("callee").alias("func")).agg(F.count("*").alias("n"))
        counted = some.select("bc", "func").distinct().join(n, ["bc", "func"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        return self.db.save_occurrences(counted, location, pointer)

    # query

    def packages(self) -> DataFrame:
        return occurrence.package_status(self.db.packages().select("name", "fetched", F.col("build.result").alias("build_result")))

    def bc_files(self, package: str | None = None) -> DataFrame:
        p = self.db.packages().select("name", F.col("build.libs").alias("libs"))
        if package is not None:
            p = p.filter(F.col("name") == package)
            if p.isEmpty():
                raise KeyError(package)
        return occurrence.package_files(p)

    def occurrence(self, function: str | None = None, regex: str | None = None, threshold: int = 0, skip: int | None = None, limit: int | None = None, in_bc: list[str] | None = None) -> DataFrame:
        occ = self.db.occurrences()
        if in_bc:
            return occurrence.intersection(occ, in_bc)
        if function is not None or regex is not None:
            return occurrence.function_total(occ, function, regex)
        return occurrence.top(occ, threshold, skip, limit)

    def _chosen(self, rows: DataFrame, package: str | None, bc: str | None, function: str | None, slice_id: int | None, where: str | None = None) -> DataFrame:
        """Rows of a package's files, of files whose name contains bc, of a target, of a slice, and for which a SQL expression holds."""
        if package is not None:
            name = F.col(self.bc_files(package).columns[-1])
            rows = rows.join(self.bc_files(package).select(F.regexp_extract(name, r"([^/]+)$", 1).alias("bc")).distinct(), "bc", "left_semi")
        for wanted, has in ((bc, F.col("bc").contains(bc or "")), (function, F.col("target") == function), (slice_id, F.col("slice_id") == slice_id), (where, None if where is None else F.expr(where))):
            rows = rows if wanted is None else rows.filter(has)
        return rows

    def num_slices(self, package: str | None = None, bc: str | None = None, function: str | None = None) -> DataFrame:
        """bc, n_slices: of each file that has any, and of all ("Total")."""
        s = self._chosen(self.db.load("slices"), package, bc, function, None)
        return s.rollup("bc").agg(F.count("*").alias("n_slices")).select(F.coalesce("bc", F.lit("Total")).alias("bc"), "n_slices")

    def num_traces(self, package: str | None = None, bc: str | None = None, function: str | None = None, slice_id: int | None = None, where: str | None = None) -> DataFrame:
        """n_traces; where: a SQL expression over the structs of features."""
        table = self.db.load("traces").select(*KEY).distinct() if where is None else self.db.load("features")
        return self._chosen(table, package, bc, function, slice_id, where).agg(F.count("*").alias("n_traces"))

    def slices(self, target: str, location: str | None = None) -> DataFrame:
        s = self.db.load("slices", target=target)
        return s if location is None else s.filter(F.col("edge_id").contains(location))

    def _one(self, rows: DataFrame, what: str, key: tuple) -> DataFrame:
        if rows.isEmpty():
            raise KeyError(f"no {what} {'/'.join(map(str, key))}")
        return rows

    def one_slice(self, target: str, bc: str, slice_id: int) -> DataFrame:
        return self._one(self.db.load("slices", target=target, bc=bc).filter(F.col("slice_id") == slice_id), "slice", (target, bc, slice_id))

    def trace(self, target: str, bc: str, slice_id: int, trace_id: int) -> DataFrame:
        """The instructions of a trace; KeyError if there is none."""
        rows = self.db.load("traces", target=target, bc=bc).filter((F.col("slice_id") == slice_id) & (F.col("trace_id") == trace_id))
        return self._one(rows, "trace", (target, bc, slice_id, trace_id)).orderBy("idx")

    def feature(self, target: str, bc: str, slice_id: int, trace_id: int) -> DataFrame:
        """The structs of features of a trace; KeyError if there is none."""
        rows = self.db.load("features", target=target, bc=bc).filter((F.col("slice_id") == slice_id) & (F.col("trace_id") == trace_id))
        return self._one(rows, "feature", (target, bc, slice_id, trace_id))

    def imported_traces(self, target: str = "*") -> DataFrame:
        """Traces of JSON documents as the long table."""
        return long_traces(self.db.traces(target))

    def features(self, group: str, where: str | None = None, one_per_slice: bool = False, package: str | None = None, bc: str | None = None, function: str | None = None, slice_id: int | None = None) -> DataFrame:
        """The features of one extractor, a row for each trace (for causality: each trace and function)."""
        f = self._chosen(self.db.load("features"), package, bc, function, slice_id).filter(F.col(group).isNotNull())
        if group in ("before", "after"):
            words = self.db.load("words").select("target", "func", (F.col("rank") - 1).alias("_at"))
            f = f.select(*KEY, F.posexplode(group).alias("_at", "_f")).join(words, ["target", "_at"]).select(*KEY, "func", "_f.*")
        else:
            f = f.select(*KEY, f"{group}.*")
        f = filters.datapoints(f, where=where)
        return occurrence.one_per_slice(f) if one_per_slice else f

    def labels(self, function: str, part: str | None = None) -> DataFrame:
        """Labels of imported traces and of those given here."""
        imported = self.db.traces(function).select(*KEY, "labels")
        if "labels" in self.db.versions.latest().tables:
            imported = imported.unionByName(self.db.load("labels", target=function))
        return imported.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels")).filter(labels.has(F.col("labels"), part))

    def alarms(self, path: str, by_slice: bool = False) -> DataFrame:
        return evaluate.brief(self.db.alarms(path)) if by_slice else self.db.alarms(path)

    # action

    def label(self, chosen: DataFrame, label: str, erase: bool = False) -> int:
        """Give the chosen traces (by key) a label, or take it away, in place; a reader sees all of it or nothing. The number of the version."""
        if "labels" not in self.db.versions.latest().tables:
            traces = self.db.load("traces").select(*KEY).distinct()
            self.db.save(traces.withColumn("labels", F.array().cast("array<string>")), "labels")
        return self.db.relabel(chosen, label, erase)

    def remove(self, target: str, bc: str | None = None) -> int:
        """Drop slices, traces, features and labels of a target, or of it in a file, in one version."""
        tables = [t for t in self.db.versions.latest().tables if t != "words"] if bc is not None else []
        return self.db.remove(*tables, target=target, bc=bc)

    # learn

    def points(self, function: str, groups: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
        """key, dp_id and x of a target's datapoints, and what each place of x means; groups: extractors, or all that the target has."""
        f = self.db.load("features", target=function)
        names = list(groups or [c for c in f.columns if c not in KEY])
        sizes = {n: int(f.agg(F.coalesce(F.max(F.size(n)), F.lit(0))).first()[0]) for n in names if hasattr(f.schema[n].dataType, "elementType")}
        rows, said = vectors.encode_structs(f, names, sizes)
        rows = graph.written(vectors.numbered(rows).withColumn("x", F.col("x").cast("array<double>")), "points")
        return rows, said

    def truth(self, points: DataFrame, label: str | None = None, spec: str | None = None) -> DataFrame:
        """dp_id, is_alarm: points whose trace has the label, or that don't meet the specification (a SQL expression over the structs of features)."""
        if spec is not None:
            marked = checkers.matches(self.db.load("features"), spec).select(*KEY, "is_alarm")
        else:
            function = points.select("target").first()
            marked = self.labels(function["target"] if function else "*", label).select(*KEY, F.lit(True).alias("is_alarm"))
        return points.join(marked, KEY, "left").select("dp_id", F.coalesce("is_alarm", F.lit(False)).alias("is_alarm"))

    def learn(self, function: str, learner: str = "kde", label: str | None = None, spec: str | None = None, groups: Sequence[str] | None = None, amount: int = 50, counts: Sequence[int] = (10, 50), exp: str | None = None, seed: list[tuple[int, bool]] = (), **options) -> DataFrame:
        """Run a learner on a target's datapoints and write what it finds under learning/<exp>: alarms, names of features, vectors, model.

        Returns key, dp_id, rank, score and, where the truth is known (by label or spec), is_alarm. Learners that ask (kde, random) take ``amount`` answers from the truth; svc learns from the truth of half of the points.
        counts: for how many of the first by rank hits are counted, in the experiment's model file.
        """
        points, said = self.points(function, groups)
        known = label is not None or spec is not None
        truth = graph.written(self.truth(points, label, spec), "truth") if known else None
        if learner in UNSUPERVISED:
            found = UNSUPERVISED[learner](points, **options).filter("score < 0")
            order = ["score", "dp_id"]
        elif learner in SUPERVISED or learner in ACTIVE:
            if truth is None:
                raise ValueError(f"{learner} needs a label or a specification")
            if learner in SUPERVISED:
                half = truth.filter(F.xxhash64("dp_id") % 2 == 0)
                found, order = SUPERVISED[learner](points, half, **options).filter("pred < 0").select("dp_id", F.col("pred").cast("double").alias("score")), ["score", "dp_id"]
            elif learner == "kde":
                folder = graph.shared_folder(self.spark, "feedback")
                answer = lambda i: truth.filter(F.col("dp_id") == i).first()["is_alarm"]
                found, order = state.ask(points, answer, amount, list(seed), folder, **options).select("dp_id", F.col("attempt").cast("double").alias("score")), ["score"]
            else:
                found, order = learn.random_order(points, **options).orderBy("score", "dp_id").limit(amount), ["score", "dp_id"]
        else:
            raise ValueError(f"no learner {learner}")
        ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(*order))) if learner in ACTIVE else vectors.with_ranks(found, order)
        out = ranked.join(points.select(*KEY, "dp_id"), "dp_id").select(*KEY, "dp_id", "rank", "score")
        out = graph.written(out if truth is None else out.join(truth, "dp_id").select(*KEY, "dp_id", "rank", "score", "is_alarm"), "found")
        hits = {} if truth is None else {r["count"]: r["hits"] for r in evaluate.at_counts(out, list(counts)).collect()}
        exp = exp or f"{function}-{learner}"
        self.db.save_learning(exp, said, points, {"learner": learner, "amount": amount, "options": {k: v for k, v in options.items() if isinstance(v, int | float | str)}, "hits": hits})
        self.db.save_alarms(out.withColumn("alarms", F.lit(label or spec or "")), exp)
        return out

    def learn_active(self, points: DataFrame, oracle: Callable[[int], bool], amount: int, seed: list[tuple[int, bool]] = (), bandwidth: float = 1.0) -> DataFrame:
        """The questions asked and answers given, with the running counts of the curve."""
        asked = state.ask(points, oracle, amount, list(seed), graph.shared_folder(self.spark, "feedback"), bandwidth)
        return asked.join(evaluate.curve(asked), "attempt").orderBy("attempt")

    def learn_unsupervised(self, points: DataFrame, score: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
        """Alarms of a learner, lowest score first."""
        return vectors.ranked_alarms(score(points).filter("score < 0"), most, ascending=True)
