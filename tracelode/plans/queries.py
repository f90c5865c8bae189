"""A query for each operator, on relations derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values as v
from ..operators import checkers, dataflow, evaluate, extractors, features, filters, graph, labels, learn, legacy, occurrence, symbolic, vectors, walks
from ..sources import relations as rel
from ..sources.relations import KEY
from ..streaming import feedback as stream
from ..streaming import state

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# Packages and occurrences.


@query
def packages_status(s: SparkSession, d: str) -> DataFrame:
    return occurrence.package_status(rel.packages(s, d))


@query
def packages_bc_files(s: SparkSession, d: str) -> DataFrame:
    return occurrence.package_files(rel.packages(s, d), full=True)


@query
def packages_build_kind(s: SparkSession, d: str) -> DataFrame:
    n = rel.table(s, d, "nation")
    source = F.when(F.col("n_nationkey") % 4 == 0, "debian").otherwise("github")
    files = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("configure"), F.lit("Makefile"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("makefile"))).otherwise(F.array(F.lit("README")))
    return n.select(F.col("n_name").alias("name"), occurrence.build_kind(source, files).alias("build_type"))


@query
def packages_library_names(s: SparkSession, d: str) -> DataFrame:
    p = rel.table(s, d, "pages").select("page_id", F.regexp_replace("url", r"^https?://", "").alias("path")).withColumn("name", occurrence.library_name(F.col("path")))
    return occurrence.deduplicated_names(p, "name", "page_id").select("page_id", "name", "lib")


@query
def packages_upsert(s: SparkSession, d: str) -> DataFrame:
    n = rel.table(s, d, "nation")
    old = n.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("old").alias("state"))
    new = n.filter("n_nationkey >= 10").select(F.col("n_nationkey").alias("id"), F.lit(None).cast("string").alias("name"), F.lit("new").alias("state"))
    return occurrence.upsert(old, new, "id")


@query
def occ_top(s: SparkSession, d: str) -> DataFrame:
    return occurrence.top(rel.occurrences(s, d), threshold=100, skip=0, limit=20)


@query
def occ_page(s: SparkSession, d: str) -> DataFrame:
    return occurrence.top(rel.occurrences(s, d), skip=5)


@query
def occ_function_total(s: SparkSession, d: str) -> DataFrame:
    return occurrence.function_total(rel.occurrences(s, d), name="Brand#11")


@query
def occ_regex_total(s: SparkSession, d: str) -> DataFrame:
    return occurrence.function_total(rel.occurrences(s, d), regex=r"Brand#[12]\d")


@query
def occ_of_package(s: SparkSession, d: str) -> DataFrame:
    files = rel.table(s, d, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("nation_"), "n_nationkey").alias("bc"))
    return rel.occurrences(s, d).join(files, "bc", "left_semi")


@query
def occ_intersection(s: SparkSession, d: str) -> DataFrame:
    return occurrence.intersection(rel.occurrences(s, d), ["nation_1", "nation_2", "nation_3"])


@query
def occ_call_sites(s: SparkSession, d: str) -> DataFrame:
    edges = rel.call_edges(s, d)
    functions = edges.select(F.col("caller").alias("func")).unionAll(edges.select(F.col("callee").alias("func"))).distinct()
    return occurrence.call_sites(functions, edges)


@query
def occ_entries_depth1(s: SparkSession, d: str) -> DataFrame:
    return occurrence.entries_total(rel.call_edges(s, d))


@query
def bc_substring_lookup(s: SparkSession, d: str) -> DataFrame:
    return occurrence.find_file(rel.occurrences(s, d), s.createDataFrame([("_1",), ("_2",), ("zzz",)], "part string"))


@query
def count_slices(s: SparkSession, d: str) -> DataFrame:
    return occurrence.slice_counts(rel.trace_instrs(s, d))


@query
def count_traces(s: SparkSession, d: str) -> DataFrame:
    return occurrence.traces_of_slices(rel.trace_instrs(s, d), F.col("is_target"))


@query
def one_per_slice(s: SparkSession, d: str) -> DataFrame:
    return occurrence.one_per_slice(rel.trace_instrs(s, d).select(*KEY).distinct())


# Filters and scalars.


@query
def filter_target_regex(s: SparkSession, d: str) -> DataFrame:
    p = rel.table(s, d, "part").select("p_partkey", F.concat("p_brand", F.lit("."), "p_type").alias("name"))
    return p.filter(filters.target_filter(F.col("name"), include=r"#[1-3]", exclude=r"2$", regex=True) & filters.anchored_filter(F.col("name"), include="Brand"))


@query
def filter_names(s: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ["llvm.dbg.value", "__asan_load", "printk_once", "kmalloc", "a asm b", "%5", "(x)"])), (F.col("event_id") % 7).cast("int") + 1)
    e = rel.table(s, d, "events").select("event_id", name.alias("name"))
    n = F.col("name")
    return e.select("event_id", "name", filters.not_intrinsic(n).alias("plain"), filters.dummy(n).alias("dummy"), filters.legacy_dummy(n).alias("legacy"), filters.sanitizer(n).alias("sanitizer"), filters.causal_name(n).alias("causal"), v.simple_name(n).alias("simple"))


@query
def filter_size_guard(s: SparkSession, d: str) -> DataFrame:
    o = rel.table(s, d, "orders").groupBy("o_custkey").agg(F.sum(F.length("o_orderpriority")).alias("blocks"), F.count_if(F.col("o_orderstatus") == "O").alias("n"))
    return o.select("o_custkey", filters.size_guard(F.col("blocks"), F.col("n"), 15).alias("kept"))


@query
def filter_datapoints(s: SparkSession, d: str) -> DataFrame:
    return filters.datapoints(features.shape(rel.trace_instrs(s, d)), ["pkg0", "pkg1"], where="n_before >= 3 and slice_id % 5 = 0")


@query
def filter_min_frequency(s: SparkSession, d: str) -> DataFrame:
    return filters.min_frequency(rel.call_edges(s, d), 4)


@query
def filter_applicable(s: SparkSession, d: str) -> DataFrame:
    p = rel.table(s, d, "part")
    kinds = F.transform(F.sequence(F.lit(1), F.greatest(F.col("p_size") % 4, F.lit(1))), lambda i: F.when(i % 2 == 0, "*").otherwise("int"))
    n = F.col("p_size") % 4
    out = p.select("p_partkey", F.explode(filters.applicable(F.when(F.col("p_size") % 3 == 0, "void").otherwise("int"), n, kinds)).alias("extractor"))
    return out


@query
def filter_has_context(s: SparkSession, d: str) -> DataFrame:
    return filters.has_context(rel.trace_instrs(s, d), KEY)


@query
def func_signature(s: SparkSession, d: str) -> DataFrame:
    p = rel.table(s, d, "part")
    kinds = F.split(F.lower("p_type"), " ")
    ret = F.when(F.col("p_size") % 3 == 0, "void").when(F.col("p_size") % 3 == 1, "*").otherwise("int")
    return p.select("p_partkey", v.signature(ret, F.col("p_brand"), kinds).alias("signature"), filters.pointer_only(ret, kinds).alias("pointer"))


@query
def location_split(s: SparkSession, d: str) -> DataFrame:
    p = rel.trace_instrs(s, d)
    at = v.location(F.col("loc"))
    return p.select(*KEY, "idx", at["path"].alias("path"), at["line"].alias("line"), at["col"].alias("col"), v.context(F.col("loc")).alias("context"))


@query
def value_functions(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    values = ['{"Int":0}', '"Null"', '{"Int":-7}', '{"Sym":3}', '{"AllocOf":{"Sym":1}}', '{"GEP":{"indices":[],"loc":{"Glob":"g"}}}', '{"Alloc":4}']
    x = F.element_at(F.array(*map(F.lit, values)), (k % 7).cast("int") + 1)
    e = rel.table(s, d, "events").select("event_id", x.alias("x"))
    c = F.col("x")
    return e.select("event_id", v.is_zero(c).alias("zero"), v.number_of(c).alias("number"), v.inner(c).alias("inner"), F.size(v.candidates(c, 3)).alias("n_candidates"), v.kind_of(c).alias("kind"), v.encode_bool(F.when(c.startswith('"'), F.lit(None).cast("boolean")).otherwise(v.is_zero(c))).alias("code"))


# Labels.


def _label_rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.explode_outer("labels").alias("label"))


@query
def label_add(s: SparkSession, d: str) -> DataFrame:
    lab = rel.labels(s, d)
    return _label_rows(labels.relabel(lab, ["doc_id"], lab.filter("doc_id % 3 = 0"), "seen"))


@query
def label_erase(s: SparkSession, d: str) -> DataFrame:
    lab = rel.labels(s, d)
    return _label_rows(labels.relabel(lab, ["doc_id"], lab.filter("doc_id % 2 = 0"), "argrel-alarm", erase_it=True))


@query
def label_match(s: SparkSession, d: str) -> DataFrame:
    return rel.labels(s, d).select("doc_id", labels.has(F.col("labels")).alias("any"), labels.has(F.col("labels"), "ret").alias("ret"))


@query
def alarms_of(s: SparkSession, d: str) -> DataFrame:
    return rel.labels(s, d).select("doc_id", F.explode(labels.alarms(F.col("labels"))).alias("alarm"))


@query
def label_id_sets(s: SparkSession, d: str) -> DataFrame:
    out = labels.id_sets(rel.trace_instrs(s, d).filter("is_target"))
    return out.select("target", "bc", "slice_id", F.explode("traces").alias("trace_id"))


# Traces and features.


@query
def trace_shape(s: SparkSession, d: str) -> DataFrame:
    return features.shape(rel.trace_instrs(s, d))


@query
def feat_control_flow(s: SparkSession, d: str) -> DataFrame:
    return features.control_flow(rel.trace_instrs(s, d))


@query
def feat_ret(s: SparkSession, d: str) -> DataFrame:
    return features.ret(rel.trace_instrs(s, d))


@query
def feat_ret_check(s: SparkSession, d: str) -> DataFrame:
    return features.ret_check(rel.trace_instrs(s, d))


@query
def feat_arg_pre_0(s: SparkSession, d: str) -> DataFrame:
    return features.arg_pre(rel.trace_instrs(s, d), 0)


@query
def feat_arg_post_0(s: SparkSession, d: str) -> DataFrame:
    return features.arg_post(rel.trace_instrs(s, d), 0)


@query
def causality_dictionary(s: SparkSession, d: str) -> DataFrame:
    return features.dictionary(rel.trace_instrs(s, d)).select("target", "func", F.round("weight", 6).alias("weight"))


def _words(s: SparkSession, d: str, k: int = 5) -> DataFrame:
    return features.top_functions(features.dictionary(rel.trace_instrs(s, d)), k)


@query
def causality_topk(s: SparkSession, d: str) -> DataFrame:
    return _words(s, d).select("target", "func", "rank")


@query
def feat_before(s: SparkSession, d: str) -> DataFrame:
    return features.causality(rel.trace_instrs(s, d), _words(s, d), after=False)


@query
def feat_after(s: SparkSession, d: str) -> DataFrame:
    return features.causality(rel.trace_instrs(s, d), _words(s, d), after=True)


@query
def unify_features(s: SparkSession, d: str) -> DataFrame:
    ti = rel.trace_instrs(s, d)
    hits = ti.filter("func is not null").groupBy(*KEY, "func").agg(F.lit(True).alias("invoked"))
    return features.unify(ti.filter("is_target").select(*KEY), _words(s, d), hits)


def _encoded(s: SparkSession, d: str) -> DataFrame:
    ti = rel.trace_instrs(s, d)
    wide = vectors.prefixed(features.control_flow(ti), "control_flow").join(vectors.prefixed(features.ret(ti), "ret"), KEY).join(vectors.prefixed(features.arg_pre(ti), "arg_pre"), KEY)
    return vectors.numbered(vectors.encode(wide, ["control_flow", "ret", "arg_pre"]))


@query
def encode_vector(s: SparkSession, d: str) -> DataFrame:
    return _encoded(s, d).select("dp_id", F.posexplode("x").alias("position", "value"))


@query
def encode_masked(s: SparkSession, d: str) -> DataFrame:
    return vectors.masked(_encoded(s, d), [i % 2 == 0 for i in range(13)]).select("dp_id", F.posexplode("x").alias("position", "value"))


# Checkers.


@query
def checker_stats(s: SparkSession, d: str) -> DataFrame:
    return checkers.stats(checkers.retval_results(rel.trace_instrs(s, d)))


@query
def checker_scores(s: SparkSession, d: str) -> DataFrame:
    return checkers.scores(checkers.retval_results(rel.trace_instrs(s, d))).withColumn("score", F.round("score", 6))


@query
def checker_bugs(s: SparkSession, d: str) -> DataFrame:
    return checkers.bugs(checkers.scores(checkers.retval_results(rel.trace_instrs(s, d))), F.col("result") != "NoCheck", 0.9).withColumn("score", F.round("score", 6))


@query
def checker_argval_0(s: SparkSession, d: str) -> DataFrame:
    return checkers.argval_results(rel.trace_instrs(s, d), 0)


@query
def checker_causality(s: SparkSession, d: str) -> DataFrame:
    return checkers.causality_results(_words(s, d), features.causality(rel.trace_instrs(s, d), _words(s, d), after=True))


@query
def checker_branches(s: SparkSession, d: str) -> DataFrame:
    return checkers.branch_results(rel.trace_instrs(s, d))


@query
def fopen_rule(s: SparkSession, d: str) -> DataFrame:
    return checkers.fopen_rule(rel.trace_instrs(s, d), "f1", "f2", F.col("target").startswith("purch"))


@query
def filter_opens_file(s: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ["fopen", "my_fopen64", "open", "a\nfopen", "freopen"])), (F.col("event_id") % 5).cast("int") + 1)
    return rel.table(s, d, "events").select("event_id", filters.opens_file(name).alias("opens"))


@query
def count_all_groupings(s: SparkSession, d: str) -> DataFrame:
    return occurrence.slice_totals(rel.trace_instrs(s, d), "kg")


@query
def function_types(s: SparkSession, d: str) -> DataFrame:
    return occurrence.function_types(rel.table(s, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("func"), F.col("p_type").alias("type")))


@query
def input_kinds(s: SparkSession, d: str) -> DataFrame:
    n = rel.table(s, d, "nation")
    name = F.concat("n_name", F.element_at(F.array(*map(F.lit, [".json", ".bc", "", "/src"])), (F.col("n_nationkey") % 4).cast("int") + 1))
    return n.select(F.col("n_nationkey").cast("long").alias("id"), name.alias("name"), occurrence.input_kind(name, name.endswith("/src")).alias("kind"), occurrence.build_state(F.col("n_nationkey") % 3, F.col("n_regionkey") % 2).alias("state"))


@query
def alarms_of_points(s: SparkSession, d: str) -> DataFrame:
    shape = features.shape(rel.trace_instrs(s, d))
    alarms = shape.filter("n_before > n_after").select("bc", "slice_id", "trace_id", (F.col("n_after") - F.col("n_before")).cast("double").alias("score"))
    return occurrence.alarms_of_points(alarms, vectors.numbered(rel.trace_instrs(s, d).select(*KEY).distinct())).select("dp_id", "target", "bc", "slice_id", "trace_id", "score")


@query
def feature_fields(s: SparkSession, d: str) -> DataFrame:
    doc = F.concat(F.lit('{"ret":{"k":'), F.get_json_object("props", "$.k"), F.lit(',"none":null},"x.y":1}'))
    e = rel.table(s, d, "events").select("event_id", doc.alias("doc"))
    g = v.grouped(F.col("doc"), ["ret", "arg"])
    return e.select("event_id", v.field(F.col("doc"), "ret.k").cast("long").alias("k"), v.has_field(F.col("doc"), "ret.none").alias("has_none"), v.has_field(F.col("doc"), "arg.k").alias("has_arg"), g["ret"].isNotNull().alias("in_group"), g["arg"].isNull().alias("not_in_group"))


@query
def legacy_metadata(s: SparkSession, d: str) -> DataFrame:
    out = dataflow.legacy_metadata(rel.trace_instrs(s, d))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_nodes", "avg_edges")})


@query
def batch_counts(s: SparkSession, d: str) -> DataFrame:
    slices = rel.trace_instrs(s, d).select(F.col("bc").alias("target"), "slice_id").distinct()
    return graph.num_elements(graph.batches(slices, 7))


@query
def slice_reduce_structs(s: SparkSession, d: str) -> DataFrame:
    """Functions use a struct for each residue of their number modulo 7."""
    e = rel.call_edges(s, d)
    members = _members(s, d)
    names = e.select(F.col("caller").alias("func")).unionAll(e.select("callee")).distinct()
    types = names.select("func", F.concat(F.lit("void (%struct.s"), F.regexp_extract("func", r"(\d+)$", 1).cast("long") % 7, F.lit("*, [4 x i8])")).alias("type"))
    return graph.reduced(graph.related_by_structs(members, types), e, 2, F.col("related")).select("target", "entry", "func")


@query
def spec_match(s: SparkSession, d: str) -> DataFrame:
    return checkers.matches(features.ret_check(rel.trace_instrs(s, d)), "checked or br_eq_zero").select(*KEY, "is_alarm")


@query
def arg_relation(s: SparkSession, d: str) -> DataFrame:
    ti = rel.trace_instrs(s, d)
    more = F.when(F.col("is_target"), F.array(F.get("args", F.lit(0)), F.concat(F.lit('{"Sym":'), F.col("k") % 5, F.lit("}")), F.concat(F.lit('{"Call":{"args":[{"Sym":'), F.col("k") % 3, F.lit('}],"func":"g","id":'), F.col("k") % 4, F.lit("}}"))))
    return dataflow.argument_relations(ti.withColumn("args", more))


# Order-dependent joins.


@query
def icmp_branch_asof(s: SparkSession, d: str) -> DataFrame:
    return dataflow.branch_comparisons(rel.trace_instrs(s, d))


@query
def reaching_def(s: SparkSession, d: str) -> DataFrame:
    return dataflow.reaching_definitions(rel.trace_instrs(s, d))


@query
def global_use_chain(s: SparkSession, d: str) -> DataFrame:
    return dataflow.use_chains(rel.trace_instrs(s, d), F.col("mem"))


@query
def syntactic_use(s: SparkSession, d: str) -> DataFrame:
    ti = rel.trace_instrs(s, d)
    return dataflow.syntactic_uses(ti.filter("op = 'CondBr'").select(*KEY, "idx", F.col("cond").alias("operand")), ti.filter("op = 'ICmp'").select(*KEY, "idx", "res"))


@query
def control_edges(s: SparkSession, d: str) -> DataFrame:
    return dataflow.control_edges(rel.trace_instrs(s, d))


@query
def dugraph_reduce(s: SparkSession, d: str) -> DataFrame:
    ti = rel.trace_instrs(s, d)
    edges = dataflow.reaching_definitions(ti).select(*KEY, F.col("def_idx").alias("src"), F.col("idx").alias("dst")).unionAll(dataflow.use_chains(ti, F.coalesce("mem", F.get("args", F.lit(0)))).select(*KEY, F.col("prev_idx").alias("src"), F.col("idx").alias("dst")))
    nodes = ti.select(*KEY, F.col("idx").alias("id"), "is_target", (F.col("op") == "CondBr").alias("keep"))
    return dataflow.reduce_dugraph(edges, nodes)


@query
def dugraph_relinked(s: SparkSession, d: str) -> DataFrame:
    return dataflow.relinked(rel.trace_instrs(s, d).filter("op in ('Call', 'CondBr')").select(*KEY, F.col("idx").alias("id")))


@query
def block_trace_dedupe(s: SparkSession, d: str) -> DataFrame:
    return graph.distinct_sequences(rel.trace_instrs(s, d), KEY, "idx", "op")


@query
def whole_slice_band(s: SparkSession, d: str) -> DataFrame:
    points = vectors.numbered(rel.trace_instrs(s, d).select(*KEY).distinct()).select("dp_id", "bc", "slice_id")
    return dataflow.whole_slices(points, points.groupBy("bc", "slice_id").agg(F.min("dp_id").alias("dp_id")).select("dp_id"))


@query
def exec_metadata(s: SparkSession, d: str) -> DataFrame:
    return dataflow.execution_metadata(rel.trace_instrs(s, d))


@query
def capped_traces(s: SparkSession, d: str) -> DataFrame:
    return dataflow.capped(rel.trace_instrs(s, d).select(*KEY).distinct(), ["target", "bc", "slice_id"], ["trace_id"], 3)


@query
def batch_offsets(s: SparkSession, d: str) -> DataFrame:
    slices = rel.trace_instrs(s, d).select(F.col("bc").alias("target"), "slice_id").distinct()
    return graph.batches(slices, 7)


# Call graphs.


N_TARGETS = 20


def _targets(edges: DataFrame) -> DataFrame:
    """The functions asked about: the parts up to N_TARGETS."""
    number = F.regexp_extract("callee", r"^part_(\d+)$", 1).try_cast("long")
    return edges.filter(number <= N_TARGETS).select(F.col("callee").alias("target")).distinct()


@query
def target_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.target_edges(rel.call_edges(s, d), F.col("callee").rlike("^part_[0-9]$"))


@query
def entries_bounded(s: SparkSession, d: str) -> DataFrame:
    e = rel.call_edges(s, d)
    return graph.entries(e, _targets(e), 2)


@query
def slices_of_edges(s: SparkSession, d: str) -> DataFrame:
    e = rel.call_edges(s, d)
    return graph.numbered_slices(graph.edge_entries(e, _targets(e), 1))


def _members(s: SparkSession, d: str, targets: DataFrame | None = None) -> DataFrame:
    e = rel.call_edges(s, d)
    return graph.reachable(e, graph.entries(e, _targets(e) if targets is None else targets, 1), 2)


@query
def slice_functions(s: SparkSession, d: str) -> DataFrame:
    return _members(s, d)


@query
def slice_reduce(s: SparkSession, d: str) -> DataFrame:
    return graph.reduced(_members(s, d), rel.call_edges(s, d), 2, F.col("func").endswith("7"))


@query
def simple_paths(s: SparkSession, d: str) -> DataFrame:
    e = rel.call_edges(s, d)
    stops = F.array(*map(F.lit, ("part_1", "part_2", "part_3")))
    ends = e.filter("caller like 'nation%'").select(F.col("caller").alias("start")).distinct().withColumn("stop", F.explode(stops))
    return graph.simple_paths(e, ends, 3).select("start", "stop", F.array_join("path", ">").alias("path"))


@query
def function_traces(s: SparkSession, d: str) -> DataFrame:
    e = rel.call_edges(s, d)
    targets = graph.written(_targets(e), "targets")
    slices = graph.edge_entries(e, targets, 1)
    return graph.function_traces(e, slices, _members(s, d, targets), 2, 50).select("start", "stop", F.array_join("path", ">").alias("path")).distinct()


@query
def cartesian_choices(s: SparkSession, d: str) -> DataFrame:
    n = rel.table(s, d, "nation").filter("n_regionkey < 3")
    parts = n.groupBy(F.lit("k").alias("key"), F.col("n_regionkey").alias("pos")).agg(F.sort_array(F.collect_list("n_name")).alias("options"))
    return graph.choices(parts, ["key"], "pos", "options").select("key", F.array_join("choice", "|").alias("choice"))


@query
def merged_clusters(s: SparkSession, d: str) -> DataFrame:
    links = rel.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_regionkey") + 100).cast("long").alias("b"))
    return graph.merged_clusters(links)


@query
def dot_export(s: SparkSession, d: str) -> DataFrame:
    ti = rel.trace_instrs(s, d).filter("slice_id = 1 and trace_id = 0")
    return graph.dot(ti.select(F.col("idx").alias("id"), F.col("op").alias("label"), "is_target"), dataflow.control_edges(ti).select("src", "dst", F.lit("cf").alias("kind")))


# Vectors, scores and evaluation.


def _labeled(s: SparkSession, d: str) -> DataFrame:
    return rel.vectors(s, d).filter("label in (0, 1)").select("dp_id", "x", (F.col("label") == 0).alias("is_alarm"))


@query
def kde_score(s: SparkSession, d: str) -> DataFrame:
    out = vectors.kde_scores(rel.vectors(s, d), _labeled(s, d))
    return out.select("dp_id", *[(F.round(F.col(x), 6) + 0.0).alias(x) for x in ("positive", "negative", "score")])


@query
def kde_log_score(s: SparkSession, d: str) -> DataFrame:
    return vectors.log_density(rel.vectors(s, d), _labeled(s, d)).select("dp_id", (F.round("score", 6) + 0.0).alias("score"))


@query
def kde_alarms(s: SparkSession, d: str) -> DataFrame:
    scores = vectors.kde_scores(rel.vectors(s, d), _labeled(s, d)).select("dp_id", F.round("score", 6).alias("score"))
    return vectors.ranked_alarms(scores, 25).select("dp_id")


@query
def pairwise_mean_distance(s: SparkSession, d: str) -> DataFrame:
    return vectors.mean_distance(rel.vectors(s, d)).select(F.round("mean_distance", 6).alias("mean_distance"), "n_pairs")


def _representatives(points: DataFrame) -> DataFrame:
    """One point of each cluster: as many rows as there are labels."""
    return points.groupBy("label").agg(F.min("dp_id").alias("dp_id"), F.min_by("x", "dp_id").alias("x"))


@query
def rbf_kernel(s: SparkSession, d: str) -> DataFrame:
    p = rel.vectors(s, d)
    return vectors.kernel_matrix(_representatives(p), p).select("i", "j", F.round("k", 6).alias("k"))


@query
def linear_kernel(s: SparkSession, d: str) -> DataFrame:
    p = rel.vectors(s, d)
    return vectors.kernel_matrix(_representatives(p), p, linear=True).select("i", "j", (F.round("k", 6) + 0.0).alias("k"))


@query
def nearest_neighbour(s: SparkSession, d: str) -> DataFrame:
    p = rel.vectors(s, d)
    return vectors.nearest(p, p).select("dp_id", "other", F.round("distance", 6).alias("distance"))


@query
def cluster_entropy(s: SparkSession, d: str) -> DataFrame:
    return vectors.entropy(rel.vectors(s, d), "label").select(F.round("entropy", 6).alias("entropy"))


@query
def unlabeled_pool(s: SparkSession, d: str) -> DataFrame:
    return vectors.pool(rel.vectors(s, d), _labeled(s, d)).select("dp_id", "label")


@query
def mark_first_bug(s: SparkSession, d: str) -> DataFrame:
    t = rel.trace_instrs(s, d).select(*KEY).distinct()
    return t.filter(vectors.mark_first(t, "kg1", 4))


@query
def auc_curve(s: SparkSession, d: str) -> DataFrame:
    return evaluate.curve(rel.feedback(s, d))


@query
def auc_value(s: SparkSession, d: str) -> DataFrame:
    return evaluate.auc(rel.feedback(s, d)).withColumn("auc", F.round("auc", 6))


def _predictions(s: SparkSession, d: str) -> DataFrame:
    return rel.table(s, d, "labels").select(F.when(F.col("quality") == 0, -1).otherwise(1).alias("pred"), (F.col("toxic") == 1).alias("is_alarm"))


@query
def confusion(s: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_predictions(s, d))


@query
def accuracy(s: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy(_predictions(s, d)).select(F.round("accuracy", 6).alias("accuracy"))


@query
def alarms_brief(s: SparkSession, d: str) -> DataFrame:
    scored = features.shape(rel.trace_instrs(s, d)).select("bc", "slice_id", (F.col("n_before") - F.col("n_after")).cast("double").alias("score"))
    return evaluate.brief(scored).withColumn("score_avg", F.round("score_avg", 6) + 0.0)


@query
def feedback_steps(s: SparkSession, d: str) -> DataFrame:
    e = rel.table(s, d, "events").select("user_id", F.col("event_id").alias("attempt"), F.col("ts").cast("timestamp").alias("ts"))
    return evaluate.steps(e, ("user_id",)).withColumn("mean_seconds", F.round("mean_seconds", 3))


@query
def feedback_stream_scores(s: SparkSession, d: str) -> DataFrame:
    """Labels in two batches; the sums must give what the batch query gives."""
    p, lab = rel.vectors(s, d), _labeled(s, d)
    parts = [stream.contribution(p, lab.filter(f"dp_id % 2 = {i}").select("dp_id", "is_alarm"), 1.0) for i in (0, 1)]
    return stream.scores(stream.merge(stream.merge(None, parts[0]), parts[1])).select("dp_id", (F.round("score", 6) + 0.0).alias("score"))


@query
def feedback_state_scores(s: SparkSession, d: str) -> DataFrame:
    """The labels as a stream of two micro-batches into keyed state, and the scores read from the state store."""
    folder = graph.shared_folder(s, "feedback")
    _labeled(s, d).select("dp_id", "is_alarm").repartition(2).write.parquet(f"{folder}/labels")
    feed = s.readStream.schema("dp_id long, is_alarm boolean").option("maxFilesPerTrigger", 1).parquet(f"{folder}/labels")
    state.follow(feed, rel.vectors(s, d), f"{folder}/loop").awaitTermination()
    return state.scores(s, f"{folder}/loop").select("dp_id", *[(F.round(F.col(x), 6) + 0.0).alias(x) for x in ("positive", "negative", "score")])


@query
def kde_leave_in(s: SparkSession, d: str) -> DataFrame:
    return vectors.leave_in_scores(rel.vectors(s, d), _labeled(s, d), 0.3, 0.4).select("dp_id", (F.round("score", 5) + 0.0).alias("score"))


@query
def kde_leave_one_out(s: SparkSession, d: str) -> DataFrame:
    return vectors.leave_one_out_scores(rel.vectors(s, d), _labeled(s, d), 0.3, 0.4).select("dp_id", (F.round("score", 9) + 0.0).alias("score"))


@query
def kde_bandwidths(s: SparkSession, d: str) -> DataFrame:
    return vectors.bandwidths(rel.vectors(s, d), [0.3, 0.4, 1.0, 3.0]).select("bandwidth", F.round("fitness", 3).alias("fitness"))


@query
def legacy_context_columns(s: SparkSession, d: str) -> DataFrame:
    return legacy.context_columns(rel.trace_instrs(s, d))


@query
def legacy_dictionary(s: SparkSession, d: str) -> DataFrame:
    return legacy.weighted_dictionary(rel.trace_instrs(s, d)).select("target", "func", F.round("weight", 6).alias("weight"))


@query
def legacy_result_table(s: SparkSession, d: str) -> DataFrame:
    return legacy.result_table(checkers.stats(checkers.retval_results(rel.trace_instrs(s, d))))


@query
def legacy_duplicates(s: SparkSession, d: str) -> DataFrame:
    t = rel.trace_instrs(s, d).groupBy("slice_id", "trace_id").agg(F.collect_set("op").alias("vertices"))
    return legacy.is_duplicate(t.withColumnRenamed("slice_id", "slice")).select("slice", "trace_id", "is_duplicate")


@query
def phi_values(s: SparkSession, d: str) -> DataFrame:
    e = rel.table(s, d, "events").select("event_id", F.array(F.struct(F.lit("b0").alias("block"), F.col("user_id").cast("string").alias("value")), F.struct(F.lit("b1").alias("block"), F.col("event_type").alias("value"))).alias("incoming"), F.concat(F.lit("b"), F.col("event_id") % 3).alias("prev_block"))
    return dataflow.phi_values(e).select("event_id", "value")


# Extractors and checkers that plug into one pass.


def _with_arguments(s: SparkSession, d: str) -> DataFrame:
    """Traces whose target has three arguments."""
    more = F.array(F.concat(F.lit('{"Sym":'), F.col("k") % 7, F.lit("}")), F.concat(F.lit('{"Sym":'), F.col("k") % 3, F.lit("}")))
    return rel.trace_instrs(s, d).withColumn("args", F.when(F.col("is_target"), F.concat("args", more)).otherwise(F.col("args")))


@query
def extract_all(s: SparkSession, d: str) -> DataFrame:
    """All features of each trace from one pass, a row for each extractor, function (for causality) and feature."""
    found_words = graph.written(_words(s, d), "extractor-words")
    members = extractors.standard(5, arguments=3, words=found_words)
    out = extractors.run(_with_arguments(s, d), members)
    words = found_words.groupBy("target").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "func"))), lambda x: x["func"]).alias("_words"))
    out = out.join(words, "target", "left")

    def cell(extractor: str, func: Column, feature: str, value: Column) -> Column:
        return F.struct(F.lit(extractor).alias("extractor"), func.alias("func"), F.lit(feature).alias("feature"), value.alias("value"))

    def cells(e: extractors.Extractor) -> list[Column]:
        kind = out.schema[e.name].dataType
        if e.parts == 1:
            return [F.array(cell(e.name, F.lit(None).cast("string"), f, F.col(f"{e.name}.{f}"))) for f in kind.names]
        return [F.transform(e.name, lambda x, j: F.array(*[cell(e.name, F.get("_words", j), f, x[f]) for f in kind.elementType.names])).alias(e.name)]

    found = [F.flatten(x) if e.parts > 1 else x for e in members for x in cells(e)]
    return out.select(*KEY, F.explode(F.concat(*found)).alias("_f")).select(*KEY, "_f.*")


@query
def checker_all(s: SparkSession, d: str) -> DataFrame:
    """Results of all checkers from one pass, with how rare each is."""
    ti = _with_arguments(s, d)
    types = ti.select("target").distinct().select("target", F.lit("int").alias("returns"), F.array(F.lit("*"), F.lit("int"), F.lit("*")).alias("kinds"))
    return checkers.scored(checkers.run(ti, checkers.standard(), types)).withColumn("score", F.round("score", 6))


@query
def checker_flagged(s: SparkSession, d: str) -> DataFrame:
    members = checkers.standard(3)
    return checkers.flagged(checkers.scored(checkers.run(_with_arguments(s, d), members)), members, 0.2).select(*KEY, "checker", "result")


# Walks over the data flow of traces and over blocks.


@query
def def_use_edges(s: SparkSession, d: str) -> DataFrame:
    return walks.def_use_edges(rel.trace_instrs(s, d))


def _argument_types(s: SparkSession, d: str) -> DataFrame:
    """The target and two of the functions use a struct in common."""
    names = rel.trace_instrs(s, d).filter("func is not null").select("func").distinct()
    return names.select("func", F.when(F.col("func").isin("purchase", "f1", "f4"), "void (%struct.cart*)").otherwise("void (%struct.other*, i32)").alias("type"))


@query
def dictionary_after(s: SparkSession, d: str) -> DataFrame:
    ti = rel.trace_instrs(s, d)
    return walks.causal_dictionary(ti, walks.def_use_edges(ti), _argument_types(s, d)).withColumn("weight", F.round("weight", 6))


@query
def dictionary_before(s: SparkSession, d: str) -> DataFrame:
    ti = rel.trace_instrs(s, d)
    return walks.causal_dictionary(ti, walks.def_use_edges(ti), _argument_types(s, d), forward=False).withColumn("weight", F.round("weight", 6))


def _reduced_traces(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ti = rel.trace_instrs(s, d)
    has = F.max("is_target").over(Window.partitionBy(*KEY))
    own = ti.withColumn("_has", has).filter("_has")
    nodes = own.select(*KEY, F.col("idx").alias("id"), "is_target", (F.col("op") == "CondBr").alias("is_control"), (F.coalesce(F.col("func"), F.lit("")) == "f3").alias("is_related"))
    return walks.kept_nodes(nodes, walks.def_use_edges(own)), dataflow.control_edges(own)


@query
def dugraph_kept(s: SparkSession, d: str) -> DataFrame:
    return _reduced_traces(s, d)[0]


@query
def dugraph_spliced(s: SparkSession, d: str) -> DataFrame:
    return walks.spliced(*_reduced_traces(s, d))


def _block_edges(s: SparkSession, d: str) -> DataFrame:
    """A function for each region, a block for it, its nations, customers, orders and the parts ordered."""
    n, cu, o, li = (rel.table(s, d, t) for t in ("nation", "customer", "orders", "lineitem"))
    name = lambda prefix, col: F.concat(F.lit(prefix), F.lpad(F.col(col).cast("string"), 8, "0"))
    nation = n.select("n_nationkey", name("region", "n_regionkey").alias("func"))
    customer = cu.join(nation, cu["c_nationkey"] == nation["n_nationkey"])
    order = o.join(customer.select("c_custkey", "func"), o["o_custkey"] == F.col("c_custkey"))
    part = li.join(order.select("o_orderkey", "func"), li["l_orderkey"] == F.col("o_orderkey"))
    edge = lambda df, a, b: df.select("func", a.alias("src"), b.alias("dst"))
    return (
        edge(nation, F.col("func"), name("nation", "n_nationkey")).unionAll(edge(customer, name("nation", "n_nationkey"), name("customer", "c_custkey")))
        .unionAll(edge(order, name("customer", "o_custkey"), name("order", "o_orderkey"))).unionAll(edge(part, name("order", "l_orderkey"), name("part", "l_partkey")))
    )


@query
def block_paths(s: SparkSession, d: str) -> DataFrame:
    """The first two paths from the entry to each part."""
    edges = graph.written(_block_edges(s, d), "edges")
    ends = edges.filter("dst like 'part%'").select("func", F.col("func").alias("start"), F.col("dst").alias("stop")).distinct()
    return walks.block_paths(edges, ends, 2, kept=True).select("func", "stop", F.array_join("path", ">").alias("path"))


def _options(s: SparkSession, d: str) -> DataFrame:
    """For each customer its orders as parts, the lines of each as options."""
    o, li = rel.table(s, d, "orders"), rel.table(s, d, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("string"))).alias("options"))
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"]).select("o_custkey", "o_orderkey", "options")


@query
def choices_page(s: SparkSession, d: str) -> DataFrame:
    """Ways 1000 to 1004 of the product of each customer's orders, most of which have more than can be built."""
    return walks.numbered_choices(_options(s, d), ["o_custkey"], "o_orderkey", "options", first=1000, most=5).select("o_custkey", "number", F.array_join("choice", "").alias("choice"))


@query
def mask_fitness(s: SparkSession, d: str) -> DataFrame:
    """The entropy of the vectors without each of their places, all in one job."""
    points = _encoded(s, d).select("dp_id", F.col("x").cast("array<double>").alias("x"))
    return learn.mask_entropies(points, [[j != i for j in range(13)] for i in range(13)]).select("mask", F.round("entropy", 6).alias("entropy"))


@query
def outcome_counters(s: SparkSession, d: str) -> DataFrame:
    """Counters of two halves of the traces, added up by target and file."""
    found = dataflow.trace_outcomes(rel.trace_instrs(s, d), most=12)
    return dataflow.merged_counts([dataflow.outcome_counts(found.filter(F.col("slice_id") % 2 == i)) for i in (0, 1)])


@query
def mdc_entropy(s: SparkSession, d: str) -> DataFrame:
    return vectors.neighbour_cluster_entropy(rel.vectors(s, d)).select(F.round("entropy", 6).alias("entropy"), "n_clusters", "n_points")


# Learners and the trace producer: no SQL says what they compute.


@query
def isolation_forest(s: SparkSession, d: str) -> DataFrame:
    return learn.isolation_forest(rel.vectors(s, d))


@query
def one_class(s: SparkSession, d: str) -> DataFrame:
    return learn.one_class(rel.vectors(s, d))


@query
def ssad(s: SparkSession, d: str) -> DataFrame:
    return learn.ssad(rel.vectors(s, d), _labeled(s, d).select("dp_id", F.when(F.col("is_alarm"), -1).otherwise(1).alias("y")))


@query
def svc_rbf(s: SparkSession, d: str) -> DataFrame:
    return learn.svc(rel.vectors(s, d), _labeled(s, d))


@query
def dual_one_class(s: SparkSession, d: str) -> DataFrame:
    return learn.dual_one_class(rel.vectors(s, d), _labeled(s, d))


@query
def uncertainty(s: SparkSession, d: str) -> DataFrame:
    return learn.uncertain(rel.vectors(s, d), _labeled(s, d))


@query
def gmm_entropy(s: SparkSession, d: str) -> DataFrame:
    return learn.gmm_entropy(rel.vectors(s, d))


@query
def mcmc_mask(s: SparkSession, d: str) -> DataFrame:
    mask, fitness = learn.mcmc_mask(_encoded(s, d).select("dp_id", F.col("x").cast("array<double>").alias("x")))
    return s.createDataFrame([(i, on, fitness) for i, on in enumerate(mask)], "position int, kept boolean, fitness double")


@query
def random_baseline(s: SparkSession, d: str) -> DataFrame:
    return learn.random_order(rel.vectors(s, d))


def _program(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A small function for each nation: it allocates, may check the result, and uses it."""
    n = rel.table(s, d, "nation").select(F.concat(F.lit("pkg"), F.col("n_regionkey")).alias("bc"), F.concat(F.lit("fn_"), F.col("n_nationkey")).alias("func"), F.col("n_nationkey").alias("k"))
    code = [
        ("b0", 0, "call", "p", '[{"func":"malloc"},40]', None), ("b0", 1, "icmp", "c", '["EQ",{"reg":"p"},null]', 0), ("b0", 2, "br", None, '[{"reg":"c"},"b1","b2"]', 0), ("b0", 1, "br", None, '["b2"]', 1),
        ("b1", 0, "ret", None, "[]", None), ("b2", 0, "store", None, '[{"reg":"p"},{"arg":0}]', None), ("b2", 1, "call", None, '[{"func":"free"},{"reg":"p"}]', None), ("b2", 2, "ret", None, '[{"reg":"p"}]', None),
    ]
    ops = s.createDataFrame([(b, p, op, dst, a, when) for b, p, op, dst, a, when in code], "block string, pos int, op string, dst string, a string, when int")
    ir = n.join(F.broadcast(ops), F.col("when").isNull() | (F.col("when") == F.col("k") % 2)).select("bc", "func", "block", "pos", "op", "dst", "a", F.concat("func", F.lit(".c:"), F.substring("block", 2, 1), F.lit(":"), "pos").alias("loc"))
    slices = n.select(F.lit("malloc").alias("target"), "bc", F.col("k").cast("long").alias("slice_id"), F.col("func").alias("entry"), F.array("func").alias("functions"))
    return slices, ir


@query
def symexec_traces(s: SparkSession, d: str) -> DataFrame:
    return symbolic.execute(*_program(s, d)).drop("args")


@query
def symexec_features(s: SparkSession, d: str) -> DataFrame:
    return features.ret_check(symbolic.execute(*_program(s, d)))
