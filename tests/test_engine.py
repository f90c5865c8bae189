"""Operators on small hand-built traces, programs and files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators import checkers, features, filters, graph, learn, occurrence, symbolic, vectors
from tracelode.sources import catalog

COLUMNS = "target string, bc string, slice_id long, trace_id long, idx int, is_target boolean, loc string, op string, func string, args array<string>, pred string, op0 string, op1 string, cond string, br string, beg_loop boolean, end_loop boolean, mem string, val string, res string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
R, ZERO, C = '{"Call":{"id":0}}', '"Null"', '{"ICmp":{"id":1}}'


def trace(spark, *rows, trace_id=0, slice_id=0):
    data = []
    for i, r in enumerate(rows):
        base = dict.fromkeys(NAMES) | {"target": "malloc", "bc": "a", "slice_id": slice_id, "trace_id": trace_id, "idx": i, "is_target": False, "beg_loop": False, "end_loop": False}
        data.append(tuple((base | r)[n] for n in NAMES))
    return spark.createDataFrame(data, COLUMNS)


TARGET = {"op": "Call", "func": "malloc", "args": ['{"Int":40}'], "res": R, "is_target": True}


def one(df):
    (row,) = df.collect()
    return row.asDict()


def test_ret_checked_on_null(spark):
    t = trace(spark, TARGET, {"op": "ICmp", "pred": "EQ", "op0": R, "op1": ZERO, "res": C}, {"op": "CondBr", "cond": C, "br": "Else"}, {"op": "Ret", "op0": R})
    got = one(features.ret_check(t))
    assert got["checked"] and got["compared_with_zero"] and not got["br_eq_zero"] and got["br_neq_zero"] and got["slice_checked"]
    r = one(features.ret(t))
    assert r["returned"] and r["used"] and not r["derefed"] and not r["indir_returned"]


def test_last_branch_decides(spark):
    check = [{"op": "ICmp", "pred": "NE", "op0": R, "op1": ZERO, "res": C}, {"op": "CondBr", "cond": C, "br": "Then"}]
    again = [{"op": "ICmp", "pred": "EQ", "op0": R, "op1": ZERO, "res": C}, {"op": "CondBr", "cond": C, "br": "Then"}]
    got = one(features.ret_check(trace(spark, TARGET, *check, *again)))
    assert got["br_eq_zero"] and not got["br_neq_zero"]


def test_deref_through_child_and_indirect_return(spark):
    child, place = '{"GEP":{"indices":[],"loc":"x"}}', '{"Alloc":3}'
    t = trace(spark, TARGET, {"op": "GEP", "mem": R, "res": child}, {"op": "Load", "mem": child, "res": "1"}, {"op": "Store", "mem": place, "val": R}, {"op": "Ret", "op0": place})
    r = one(features.ret(t))
    assert r["derefed"] and r["stored"] and r["indir_returned"] and not r["returned"]


def test_argument_before_call(spark):
    a = '{"Arg":0}'
    t = trace(spark, {"op": "ICmp", "pred": "NE", "op0": a, "op1": ZERO, "res": C}, {"op": "CondBr", "cond": C, "br": "Then"}, TARGET | {"args": [a]})
    pre = one(features.arg_pre(t))
    assert pre["checked"] and pre["arg_check_not_zero"] and not pre["arg_check_is_zero"] and pre["is_arg"]
    assert one(features.arg_pre(trace(spark, TARGET)))["is_constant"]
    assert features.arg_pre(trace(spark, TARGET), 1).count() == 0


def test_argument_unwraps_allocation(spark):
    a = '{"AllocOf":{"Sym":1}}'
    t = trace(spark, TARGET | {"args": [a]}, {"op": "Load", "mem": '{"Sym":1}', "res": "1"}, {"op": "Ret", "op0": a})
    post = one(features.arg_post(t))
    assert post["derefed"] and post["returned"]


def test_control_flow_and_dictionary(spark):
    loop = {"op": "CondBr", "cond": C, "br": "Then", "beg_loop": True}
    close = {"op": "Call", "func": "free", "args": [R], "res": None}
    t = trace(spark, loop, TARGET, close, close).unionAll(trace(spark, TARGET, {"op": "Call", "func": "__asan_x", "args": []}, trace_id=1))
    cf = {r["trace_id"]: r.asDict() for r in features.control_flow(t).collect()}
    assert cf[0]["target_in_a_loop"] and cf[0]["has_loop"] and not cf[1]["has_loop"]
    words = features.dictionary(t)
    assert {r["func"]: r["weight"] for r in words.collect()} == {"malloc": 1.0, "free": 0.5}
    got = {(r["trace_id"], r["func"]): r for r in features.causality(t, words, after=True).collect()}
    assert got[0, "free"]["invoked_more_than_once"] and got[0, "free"]["share_return"] and not got[1, "free"]["invoked"]


def test_majority_checker(spark):
    traces = [trace(spark, TARGET, {"op": "ICmp", "pred": "EQ", "op0": R, "op1": ZERO, "res": C}, trace_id=i) for i in range(4)]
    t = traces[0]
    for x in [*traces[1:], trace(spark, TARGET, trace_id=9)]:
        t = t.unionAll(x)
    scored = checkers.scores(checkers.retval_results(t))
    assert [r["trace_id"] for r in checkers.bugs(scored, F.col("result") == "NoCheck", 0.7).collect()] == [9]


def test_filters(spark):
    df = spark.createDataFrame([("kmalloc.1",), ("kfree",), ("llvm.dbg.value",)], "n string")
    n = F.col("n")
    assert [r.n for r in df.filter(filters.target_filter(n, "k", "free", regex=True)).collect()] == ["kmalloc.1"]
    assert [r.n for r in df.filter(filters.target_filter(n, "kfree")).collect()] == ["kfree"]
    assert df.filter(filters.not_intrinsic(n)).count() == 2
    guard = spark.createDataFrame([(1999, 2), (2000, 2), (5, 0)], "b int, n int").select(filters.size_guard(F.col("b"), F.col("n")).alias("k"))
    assert [r.k for r in guard.collect()] == [True, False, False]


def test_paths_and_slices(spark):
    e = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", "a", "c"), ("4", "c", "a"), ("5", "b", "t"), ("6", "c", "t")], "edge_id string, caller string, callee string")
    ends = spark.createDataFrame([("a", "t")], "start string, stop string")
    assert sorted(">".join(r.path) for r in graph.simple_paths(e, ends, 4).collect()) == ["a>b>c>t", "a>b>t", "a>c>t"]
    targets = spark.createDataFrame([("t",)], "target string")
    assert sorted(r.entry for r in graph.entries(e, targets, 1).collect()) == ["a", "b"]
    got = graph.reachable(e, spark.createDataFrame([("t", "a")], "target string, entry string"), 1)
    assert sorted(r.func for r in got.collect()) == ["a", "b", "c"]


def program(spark, rows):
    return spark.createDataFrame([("a", f, b, p, op, dst, json.dumps(a), f"{f}.c:{p}:1") for f, b, p, op, dst, a in rows], "bc string, func string, block string, pos int, op string, dst string, a string, loc string")


def test_symbolic_execution_drops_impossible_paths(spark):
    ir = program(spark, [
        ("main", "b0", 0, "call", "p", [{"func": "lock"}, {"glob": "m"}]), ("main", "b0", 1, "icmp", "c", ["EQ", {"reg": "p"}, 0]), ("main", "b0", 2, "br", None, [{"reg": "c"}, "b1", "b2"]),
        ("main", "b1", 0, "icmp", "d", ["NE", {"reg": "p"}, 0]), ("main", "b1", 1, "br", None, [{"reg": "d"}, "b3", "b4"]), ("main", "b2", 0, "icmp", "d", ["NE", {"reg": "p"}, 0]), ("main", "b2", 1, "br", None, [{"reg": "d"}, "b3", "b4"]),
        ("main", "b3", 0, "ret", None, []), ("main", "b4", 0, "call", "q", [{"func": "helper"}, {"reg": "p"}]), ("main", "b4", 1, "ret", None, [{"reg": "q"}]),
        ("helper", "b0", 0, "store", None, [{"glob": "g"}, {"arg": 0}]), ("helper", "b0", 1, "load", "x", [{"glob": "g"}]), ("helper", "b0", 2, "ret", None, [{"reg": "x"}]),
    ])
    slices = spark.createDataFrame([("lock", "a", 0, "main", ["main", "helper"])], "target string, bc string, slice_id long, entry string, functions array<string>")
    got = symbolic.execute(slices, ir)
    assert got.select("trace_id").distinct().count() == 2
    assert symbolic.execute(slices, ir, check=False).select("trace_id").distinct().count() == 4
    returned = [r for r in got.filter("op = 'Ret' and op0 is not null").collect() if '"lock"' in r.op0]
    assert returned, "the helper returns what was stored, the result of the call"


def test_satisfiable():
    x = {"Sym": 1}
    assert symbolic.satisfiable([("SGT", x, {"Int": 3}, True), ("SLT", x, {"Int": 5}, True)])
    assert not symbolic.satisfiable([("SGT", x, {"Int": 3}, True), ("SLT", x, {"Int": 5}, True), ("NE", x, {"Int": 4}, True)])
    assert not symbolic.satisfiable([("EQ", x, "Null", True), ("EQ", x, {"Int": 0}, False)])
    assert symbolic.satisfiable([("EQ", x, {"Sym": 2}, True), ("FOO", x, {"Int": 2}, True)])
    assert not symbolic.satisfiable([("EQ", {"Int": 1}, {"Int": 2}, True)])


def test_learners(spark):
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(0, 1, 4).tolist()) for i in range(200)] + [(200, [9.0] * 4)]
    p = spark.createDataFrame(data, "dp_id long, x array<double>")
    for out in (learn.isolation_forest(p), learn.one_class(p, nu=0.1)):
        assert out.orderBy("score").first()["dp_id"] == 200
    lab = spark.createDataFrame([(200, -1), (1, 1)], "dp_id long, y int")
    assert learn.ssad(p, lab).count() == 201
    mask, fitness = learn.mcmc_mask(p, rounds=10, fixed=(0,))
    assert mask[0] and fitness > 0


def test_workspace(spark, tmp_path):
    root = tmp_path / "db"
    for path, doc in {
        "packages/p/index.json": {"name": "p", "build": {"result": "success", "libs": ["x"]}}, "analysis/occurrences/x.bc.json": {"void f(*)": 3, "int g()": 1},
        "analysis/slices/f/x.bc/0.json": {"entry": "main", "caller": "main", "callee": "f", "instr": "a.c:1:2", "functions": ["main"]},
        "analysis/traces/f/x.bc/0/0.json": {"instrs": [{"loc": "a.c:1:2", "sem": {"Call": {"func": {"Func": "f"}, "args": [{"Int": 4}]}}, "res": {"Sym": 0}}], "target": 0, "statically_checked": False},
        "analysis/features/f/x.bc/0/0.json": {"ret": {"used": True}, "after": {}},
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(json.dumps(doc))
    with pytest.raises(FileNotFoundError):
        catalog.Workspace(spark, str(root))
    db = catalog.Workspace.init(spark, str(root))
    assert db.packages().first()["fetched"] is False
    assert {(r.bc, r.func, r.n) for r in db.occurrences().collect()} == {("x.bc", "void f(*)", 3), ("x.bc", "int g()", 1)}
    (row,) = catalog.long_traces(db.datapoints("f")).collect()
    assert (row.target, row.bc, row.func, row.args, row.res, row.is_target) == ("f", "x.bc", "f", ['{"Int":4}'], '{"Sym":0}', True)
    db.save(db.slices("f"), "slices")
    assert db.load("slices").count() == 1
    db.remove("slices", target="f")
    alarms = spark.createDataFrame([("x", 1, 2, 0.5, "a,b")], "bc string, slice_id long, trace_id long, score double, alarms string")
    db.save_alarms(alarms, "e")
    assert db.alarms(f"{root}/learning/e/alarms.csv").first()["alarms"] == "a,b"


def test_names(spark):
    df = spark.createDataFrame([("a/b/c/lib.so", "debian", ["x"]), ("z/y", "github", ["Makefile"])], "path string, src string, files array<string>")
    got = df.select(occurrence.library_name(F.col("path")).alias("n"), occurrence.build_kind(F.col("src"), F.col("files")).alias("b")).collect()
    assert [(r.n, r.b) for r in got] == [("a_b", "dpkg"), ("", "makeonly")]


def test_engine_from_program_to_features(spark, tmp_path):
    from tracelode.api import Engine

    root = tmp_path / "db"
    root.mkdir()
    engine = Engine.init(spark, str(root))
    ir = program(spark, [
        ("main", "b0", 0, "call", "p", [{"func": "lock"}, {"glob": "m"}]), ("main", "b0", 1, "icmp", "c", ["EQ", {"reg": "p"}, 0]), ("main", "b0", 2, "br", None, [{"reg": "c"}, "b1", "b2"]),
        ("main", "b1", 0, "ret", None, []), ("main", "b2", 0, "call", "q", [{"func": "helper"}, {"reg": "p"}]), ("main", "b2", 1, "ret", None, [{"reg": "q"}]), ("helper", "b0", 0, "ret", None, [{"arg": 0}]),
    ])
    edges = spark.createDataFrame([("a", "main.c:0:1", "main", "lock"), ("a", "main.c:0:2", "main", "helper"), ("a", "x", "main", "llvm.dbg.value")], "bc string, edge_id string, caller string, callee string")
    engine.analyze(ir, edges, include="lock")
    assert engine.slices("lock").first()["functions"] == ["helper", "main"]
    assert engine.num_traces().first()["n_traces"] == engine.num_traces(function="lock", where="ret_check.checked").first()["n_traces"] == 2
    assert {(r.bc, r.n_slices) for r in engine.num_slices(function="lock").collect()} == {("a", 1), ("Total", 1)}
    checks = engine.features("ret_check").orderBy("trace_id").collect()
    assert all(r.checked and r.slice_checked for r in checks) and {r.br_eq_zero for r in checks} == {True, False}
    assert any(r.returned for r in engine.features("ret").collect())
    assert engine.features("arg_0_pre", where="is_global", one_per_slice=True).count() == 1
    assert {r.func for r in engine.features("after").collect()} == {"lock", "helper"}
    for what in (engine.trace, engine.feature):
        assert what("lock", "a", 0, 1).count() > 0
        with pytest.raises(KeyError, match="lock/a/0/7"):
            what("lock", "a", 0, 7)
    # Labels in place, and a learner that is held against them.
    chosen = engine.feature("lock", "a", 0, 1)
    before = engine.db.versions.latest()
    engine.label(chosen, "bug-alarm")
    assert [(r.trace_id, r.labels) for r in engine.labels("lock", "alarm").collect()] == [(1, ["bug-alarm"])]
    assert "labels" not in before.tables and before.read("features").count() == 2
    found = engine.learn("lock", "kde", label="bug", amount=2, counts=[1, 2], exp="e").orderBy("rank").collect()
    assert [r.rank for r in found] == [1, 2] and sum(r.is_alarm for r in found) == 1
    said, saved = engine.db.load_learning("e")
    assert said["model"]["hits"]["2"] == 1 and len(said["unified"]) == len(saved.first()["x"])
    assert engine.learn("lock", "one-class", spec="ret.returned", nu=0.5).columns[-1] == "is_alarm"
    assert engine.learn("lock", "svc", spec="ret.returned").count() <= 2
    with pytest.raises(ValueError, match="needs a label"):
        engine.learn("lock", "kde")
    engine.label(chosen, "bug-alarm", erase=True)
    assert engine.labels("lock", "alarm").count() == 0
    engine.remove("lock")
    assert engine.num_traces().first()["n_traces"] == 0 and engine.db.load("features").count() == engine.db.load("labels").count() == 0
    asked = engine.learn_active(spark.createDataFrame([(i, [float(i)]) for i in range(4)], "dp_id long, x array<double>"), lambda i: i == 1, 2, [(0, True)])
    assert [(r.tp, r.fp) for r in asked.collect()] == [(1, 1), (2, 1), (2, 2)]


def test_slices_by_file_types_and_entry(spark, tmp_path):
    """Files don't mix, ids count by target and file, structs decide what stays, and entries are chosen by their file."""
    from tracelode.api import Engine

    engine = Engine.init(spark, str(tmp_path))
    edges = spark.createDataFrame(
        [("a", "1", "main", "lock"), ("a", "2", "main", "uses"), ("a", "3", "main", "other"), ("b", "1", "go", "lock"), ("b", "2", "go", "lock"), ("b", "3", "top", "go"), ("b", "4", "low", "go")], "bc string, edge_id string, caller string, callee string"
    )
    engine.slice(edges, include="lock")
    rows = lambda: {(r.bc, r.slice_id, r.entry, tuple(r.functions)) for r in engine.slices("lock").collect()}
    assert rows() == {("a", 0, "main", ("main", "other", "uses"))} | {("b", i, e, ("go", e) if e == "low" or e == "top" else (e,)) for i, e in enumerate(["low", "top", "low", "top"])}
    types = spark.createDataFrame([("lock", "void (%struct.m*)"), ("uses", "i32 (%struct.m*)"), ("other", "void (%struct.n*)")], "func string, type string")
    files = spark.createDataFrame([("b", "low", "drivers/x.c"), ("b", "top", "fs/y.c")], "bc string, func string, file string")
    engine.slice(edges, include="lock", types=types, files=files, entry_file="^drivers")
    assert rows() == {("a", 0, "main", ("main", "uses")), ("b", 0, "low", ("low",)), ("b", 1, "low", ("low",))}
    path = engine.find_occurrences(spark.createDataFrame([("a", "lock", "void", ["*"]), ("b", "lock", "void", ["*"]), ("a", "uses", "int", ["int"])], "bc string, func string, returns string, kinds array<string>"), edges, pointer=True)
    assert {r.file: json.loads(r.value) for r in spark.read.text(path).collect()} == {"a_ptr": {"lock": 1}, "b_ptr": {"lock": 2}}


def test_clusters_of_long_chains(spark, tmp_path):
    """A chain of more than 20 links is one cluster, and too few rounds are an error."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    links = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201), (300, 300)], "a long, b long")
    got = {r.node: r.cluster for r in graph.merged_clusters(links).collect()}
    assert got == {**dict.fromkeys(range(71), 0), 200: 200, 201: 200, 300: 300}
    with pytest.raises(RuntimeError, match="settle"):
        graph.merged_clusters(links, rounds=1)


def test_learners_take_all_rows(spark):
    """The mask's fitness counts rows beyond any sample."""
    rows = spark.range(5000).select(F.col("id").alias("dp_id"), F.array(F.col("id").cast("double"), F.lit(0.0)).alias("x"))
    _, fitness = learn.mcmc_mask(rows, rounds=0)
    assert fitness == pytest.approx(np.log(5000) / 2)


def test_argument_after_call_follows_places(spark):
    """What the argument is stored to is tracked, with its allocation; of a GEP its location; and values later in turn profit."""
    a, place = '{"Sym":1}', '{"Sym":7}'
    gep = '{"GEP":{"indices":[1],"loc":{"Sym":7}}}'
    after = lambda mem, out, arg=a: one(features.arg_post(trace(spark, TARGET | {"args": [arg]}, {"op": "Store", "mem": mem, "val": arg}, {"op": "Ret", "op0": out})))
    assert after(place, place)["indir_returned"] and after(place, '{"AllocOf":{"Sym":7}}')["indir_returned"]
    assert after(gep, place)["indir_returned"] and not after(gep, gep)["indir_returned"]
    assert not after('{"Load":1}', '{"Load":1}')["indir_returned"] and not after(place, '{"Sym":8}')["indir_returned"]
    assert not after(a, place)["indir_returned"] and after(a, place)["derefed"] and not after(place, place)["derefed"]
    assert one(features.arg_post(trace(spark, TARGET | {"args": [a]}, {"op": "Ret", "op0": '{"Bin":["Add",{"Sym":1},2]}'})))["indir_returned"]
    # A store of the argument through a child pointer is no dereference.
    child = {"op": "GEP", "mem": a, "res": '{"Sym":9}'}
    got = one(features.arg_post(trace(spark, TARGET | {"args": [a]}, child, {"op": "Store", "mem": '{"Sym":9}', "val": a})))
    assert not got["derefed"]
    assert one(features.arg_post(trace(spark, TARGET | {"args": [a]}, child, {"op": "Store", "mem": '{"Sym":9}', "val": '{"Int":1}'})))["derefed"]
    # Two values: the allocation stands for its inner value as well.
    both = '{"AllocOf":{"Sym":1}}'
    assert one(features.arg_post(trace(spark, TARGET | {"args": [both]}, {"op": "Store", "mem": place, "val": both}, {"op": "Ret", "op0": place})))["indir_returned"]


def test_file_rule(spark):
    check = lambda pred: {"op": "ICmp", "pred": pred, "op0": R, "op1": ZERO, "res": C}
    way = lambda br: {"op": "CondBr", "cond": C, "br": br}
    call = lambda f: {"op": "Call", "func": f, "args": [R]}
    def verdict(*rows):
        opened = lambda name: trace(spark, TARGET, *rows).withColumn("target", F.lit(name))
        return one(checkers.fopen_rule(opened("my_fopen64").unionAll(opened("malloc"))))["verdict"]  # no verdict on what opens no file

    assert verdict() == verdict(call("fclose")) == "Alarm"
    assert verdict(check("EQ"), way("Then")) == "Ok" and verdict(check("EQ"), way("Then"), call("fclose")) == "Alarm"
    assert verdict(check("NE"), way("Else"), call("fputs")) == "Alarm" and verdict(check("NE"), way("Else")) == "Ok"
    assert verdict(check("EQ"), way("Else")) == "Alarm" and verdict(check("EQ"), way("Else"), call("fputs"), call("fclose")) == "Ok"
    assert verdict(check("EQ"), {"op": "Load", "mem": R}, way("Else"), call("fclose")) == "Alarm"


def test_blocks_are_numbered(spark):
    """Block b10 comes after b2: the entry is b1, and a branch from b10 back to b2 is a loop's end."""
    code = [("b1", "br", ["b2"]), ("b2", "call", [{"func": "malloc"}, 1]), ("b2", "icmp", ["EQ", {"arg": 0}, 0]), ("b2", "br", [{"reg": "c"}, "b10", "b11"]), ("b10", "br", ["b2"]), ("b11", "ret", [])]
    pos, rows = {}, []
    for b, op, args in code:
        pos[b] = pos.get(b, -1) + 1
        rows.append(("x", "f", b, pos[b], op, "c" if op == "icmp" else None, json.dumps(args), "l"))
    ir = spark.createDataFrame(rows, "bc string, func string, block string, pos int, op string, dst string, a string, loc string")
    slices = spark.createDataFrame([("malloc", "x", 0, "f", ["f"])], "target string, bc string, slice_id long, entry string, functions array<string>")
    for limits in (symbolic.Limits(), symbolic.Limits(seed=3)):
        got = symbolic.execute(slices, ir, limits, check=False).collect()
        assert got and any(r.end_loop for r in got)
        assert {r.idx: r.op for r in got if r.trace_id == 0}[0] in ("Br", "UncondBr", "Call")


def test_small_sinks_and_fields(spark, tmp_path):
    from tracelode.functions import values as v
    from tracelode.sources.catalog import Workspace

    cat = Workspace.init(spark, str(tmp_path))
    occ = spark.createDataFrame([("a.bc", "f", 2), ("a.bc", "g", 1), ("b.bc", "f", 5)], "bc string, func string, n long")
    path = cat.save_occurrences(occ, "lib", pointer=True)
    assert {r.file: json.loads(r.value) for r in spark.read.text(path).collect()} == {"a.bc_lib_ptr": {"f": 2, "g": 1}, "b.bc_lib_ptr": {"f": 5}}
    assert [tuple(r) for r in spark.read.option("header", True).csv(cat.save_occurrence_list(occ, "all")).collect()] == [("f", "7"), ("g", "1")]
    cat.save_learning("e", ["x", "y"], spark.range(3), {"bandwidth": 1.5}, [True, False], 0.25)
    said, vectors_ = cat.load_learning("e")
    assert said == {"unified": ["x", "y"], "model": {"bandwidth": 1.5}, "mask": [True, False], "fitness": 0.25} and vectors_.count() == 3
    assert cat.slice_counts().count() == 0
    doc = spark.createDataFrame([('{"a":{"b":null,"c":2}}',), (None,)], "d string")
    got = doc.select(v.field(F.col("d"), "a.c").alias("c"), v.has_field(F.col("d"), "a.b").alias("b"), v.has_field(F.col("d"), "z.b").alias("z")).collect()
    assert [tuple(r) for r in got] == [("2", True, False), (None, False, False)]
    t = spark.createDataFrame([("void (%struct.dev*, [4 x %struct.a.b])",), (None,)], "t string")
    assert [r[0] for r in t.select(graph.struct_names(F.col("t"))).collect()] == [["dev", "a.b"], None]


def test_running_sums_by_ranges(spark):
    from tracelode.operators import evaluate

    rows = spark.createDataFrame([(i * 7 % 50, i % 3 == 0) for i in range(50)], "attempt int, is_alarm boolean")
    got = {r.attempt: r.tp for r in evaluate.running(rows, "attempt", {"tp": F.col("is_alarm").cast("int")}, width=8).collect()}
    hits = {i * 7 % 50: i % 3 == 0 for i in range(50)}
    assert got == {a: sum(hits[b] for b in range(a + 1)) for a in range(50)}
    none = rows.limit(0)
    assert evaluate.auc(none).first().auc == 0.0 and evaluate.curve(none).count() == 1


def test_learners_without_points(spark):
    none = spark.createDataFrame([], "dp_id long, x array<double>")
    lab, y = spark.createDataFrame([], "dp_id long, is_alarm boolean"), spark.createDataFrame([], "dp_id long, y int")
    for df in (learn.one_class(none), learn.ssad(none, y), learn.svc(none, lab), learn.dual_one_class(none, lab), learn.uncertain(none, lab), learn.isolation_forest(none), vectors.nearest(none, none), vectors.kde_scores(none, spark.createDataFrame([], "dp_id long, x array<double>, is_alarm boolean"))):
        assert df.count() == 0
    assert learn.gmm_entropy(none).first().entropy is None and learn.mcmc_mask(none) == ([], 0.0)
    assert vectors.mean_distance(none).first().n_pairs == 0
    some = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "dp_id long, x array<double>")
    assert learn.isolation_forest(some).count() == learn.random_features(some).count() == 3
    assert {r.pred for r in learn.svc(some, spark.createDataFrame([(1, True)], "dp_id long, is_alarm boolean")).collect()} == {-1}
    assert [(r.dp_id, r.other) for r in vectors.nearest(some, some).orderBy("dp_id").collect()] == [(1, 2), (2, 1)]
