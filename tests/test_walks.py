"""Walks, reductions, block paths and products against plain versions on small graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import walks
from tracelode.sources.relations import KEY

EDGE = "func string, src string, dst string"


def edges_of(spark, graphs):
    return spark.createDataFrame([(f, a, b) for f, e in graphs.items() for a, b in e], EDGE)


def depths(edges, start):
    found, front, d = {start: 0}, {start}, 0
    while front:
        d += 1
        front = {b for a, b in edges if a in front} - set(found)
        found |= dict.fromkeys(front, d)
    return found


def random_graphs(seed, n_graphs=4, nodes=12, edges=18):
    rng = random.Random(seed)
    name = lambda: f"n{rng.randrange(nodes):02d}"
    return {f"f{i}": list({(name(), name()) for _ in range(edges)}) for i in range(n_graphs)}


def test_reach_both_ways(spark):
    graphs = random_graphs(0)
    starts = spark.createDataFrame([(f, "n00", s) for f in graphs for s in ("a", "b")] + [("f0", "lonely", "a"), ("f1", None, "a")], "func string, id string, who string")
    for forward in (True, False):
        got = walks.reach(edges_of(spark, graphs), starts, ["func"], forward, carry=["who"]).collect()
        want = {(f, s, i, d) for f, e in graphs.items() for s in "ab" for i, d in depths([(a, b) if forward else (b, a) for a, b in e], "n00").items()} | {("f0", "a", "lonely", 0)}
        assert {(r.func, r.who, r.id, r.depth) for r in got} == want and len(got) == len(want)
    with pytest.raises(RuntimeError, match="longer"):
        walks.reach(spark.createDataFrame([("f", str(i), str(i + 1)) for i in range(9)], EDGE), spark.createDataFrame([("f", "0")], "func string, id string"), ["func"], rounds=3)


@pytest.mark.parametrize("seed", range(3))
def test_splicing_keeps_reachability_and_order(spark, seed):
    rng = random.Random(seed)
    graphs = random_graphs(seed, 2, 14, 22) | {"chain": [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)], "loop": [("n00", "x"), ("x", "y"), ("y", "x"), ("y", "n01")]}
    kept = {f: {n for e in es for n in e if n.startswith("n") and rng.random() < (0.1 if f == "chain" else 0.5)} | {"n00"} for f, es in graphs.items()}
    df = spark.createDataFrame([(f, n) for f, ns in kept.items() for n in ns], "func string, id string")
    got = {(r.func, r.src, r.dst) for r in walks.spliced(df, edges_of(spark, graphs), ["func"]).collect()}
    want = set()
    for f, es in graphs.items():
        for u in kept[f]:
            seen, front = set(), {b for a, b in es if a == u}
            while front:
                seen |= front
                front = {b for a, b in es if a in front and a not in kept[f]} - seen
            want |= {(f, u, x) for x in seen if x in kept[f]}
    assert got == want


def test_reduction_of_a_trace(spark):
    key = {"target": "t", "bc": "a", "slice_id": 0, "trace_id": 0}
    node = lambda i, **k: (*key.values(), i, k.get("t", False), k.get("c", False), k.get("r", False))
    nodes = spark.createDataFrame([node(0), node(1), node(2, t=True), node(3), node(4), node(5, c=True), node(6), node(7, r=True), node(8), node(9)], ", ".join(f"{k} {'string' if k in ('target', 'bc') else 'long'}" for k in KEY) + ", id int, is_target boolean, is_control boolean, is_related boolean")
    du = spark.createDataFrame([(*key.values(), a, b) for a, b in [(0, 2), (2, 3), (4, 5), (1, 1), (7, 8), (0, 6)]], ", ".join(f"{k} {'string' if k in ('target', 'bc') else 'long'}" for k in KEY) + ", src int, dst int")
    got = walks.kept_nodes(nodes, du)
    assert sorted(r.id for r in got.collect()) == [0, 2, 3, 4, 5, 6, 7, 8]  # 1 and 9 go
    cf = spark.createDataFrame([(*key.values(), i, i + 1) for i in range(9)], du.schema)
    assert sorted((r.src, r.dst) for r in walks.spliced(got, cf).collect()) == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8)]


def simple_paths(edges, start, stop):
    out, todo = [], [[start]]
    while todo:
        p = todo.pop()
        if p[-1] == stop:
            out.append(p)
            continue
        todo += [[*p, b] for a, b in edges if a == p[-1] and b not in p]
    return sorted(out, key=lambda p: (len(p), p))


@pytest.mark.parametrize("seed", range(4))
def test_first_block_paths(spark, seed):
    graphs = random_graphs(seed, 3, 9, 24)
    ends = [(f, "n00", f"n{i:02d}") for f in graphs for i in (0, 3, 7)] + [("f0", "n00", "nowhere"), ("f9", "n00", "n01")]
    got = walks.block_paths(edges_of(spark, graphs), spark.createDataFrame(ends, "func string, start string, stop string"), 3)
    want = [(f, a, b, tuple(p)) for f, a, b in ends for p in simple_paths(graphs.get(f, []), a, b)[:3] if len(p) > 1 or a == b]
    assert sorted((r.func, r.start, r.stop, tuple(r.path)) for r in got.collect()) == sorted(want)


def test_a_function_with_2_to_the_30_paths_yields_its_first_50(spark):
    diamonds = [e for i in range(30) for e in ((f"{i:02d}", f"{i:02d}a"), (f"{i:02d}", f"{i:02d}b"), (f"{i:02d}a", f"{i + 1:02d}"), (f"{i:02d}b", f"{i + 1:02d}"))]
    got = walks.block_paths(edges_of(spark, {"f": diamonds}), spark.createDataFrame([("f", "00", "30")], "func string, start string, stop string"), 50).collect()
    sides = ["".join(x[-1] for x in r.path if x[-1] in "ab") for r in got]
    assert sorted(sides) == ["".join(p) for p in itertools.islice(itertools.product("ab", repeat=30), 50)]


def test_block_graph_and_traces(spark):
    blocks = spark.createDataFrame([("f", "b0", ["b1", "b2"]), ("f", "b1", ["b3"]), ("f", "b2", ["b3"]), ("f", "b3", []), ("g", "c0", ["c1"]), ("g", "c1", None)], "func string, block string, next array<string>")
    edges = walks.block_graph(blocks)
    assert edges.count() == 5
    paths = walks.block_paths(edges, spark.createDataFrame([("f", "b0", "b3"), ("g", "c0", "c1")], "func string, start string, stop string"), 50)
    calls = spark.createDataFrame([("t", 0, "f", "b3"), ("t", 1, "g", "c1"), ("t", 2, "f", "b3"), ("u", 0, "h", "x")], "trace string, pos int, func string, block string")
    got = walks.block_traces(calls, paths).orderBy("number").collect()
    a, b, c = ["b0", "b1", "b3"], ["b0", "b2", "b3"], ["c0", "c1"]
    assert [(r.trace, r.number, r.blocks) for r in got] == [("t", i, list(w)) for i, w in enumerate(itertools.product([a, b], [c], [a, b]))]


def test_any_page_of_a_product(spark):
    sizes = {"k": [3, 1, 4, 2], "one": [5], "none": [2, 0, 3]}
    rows = [(k, i, [f"{k}{i}{j}" for j in range(n)] if n else None) for k, ns in sizes.items() for i, n in enumerate(ns)]
    parts = spark.createDataFrame(rows, "key string, pos int, options array<string>")
    want = {k: list(itertools.product(*[[f"{k}{i}{j}" for j in range(n)] for i, n in enumerate(ns)])) for k, ns in sizes.items()}
    got = walks.numbered_choices(parts, ["key"], "pos", "options").collect()
    assert sorted((r.key, r.number, tuple(r.choice)) for r in got) == sorted((k, i, c) for k, w in want.items() for i, c in enumerate(w))
    page = walks.numbered_choices(parts, ["key"], "pos", "options", first=7, most=6).collect()
    assert sorted((r.key, r.number, tuple(r.choice)) for r in page) == sorted((k, i, c) for k, w in want.items() for i, c in enumerate(w) if 7 <= i < 13)
    big = spark.createDataFrame([("k", i, [str(j) for j in range(10)]) for i in range(9)] + [("huge", i, [str(j) for j in range(1000)]) for i in range(40)], "key string, pos int, options array<string>")
    got = walks.numbered_choices(big, ["key"], "pos", "options", first=123_456_789, most=2).collect()
    assert sorted((r.key, r.number, "".join(r.choice[-9:])) for r in got) == [("huge", 123_456_789, "000000123456789"[-15:]), ("huge", 123_456_790, "000000123456790"[-15:]), ("k", 123_456_789, "123456789"), ("k", 123_456_790, "123456790")]


def test_walk_from_the_target_and_its_dictionary(spark):
    from test_engine import TARGET, trace

    r, s, p = '{"Call":{"id":0}}', '{"Sym":1}', '{"Alloc":9}'
    t = trace(
        spark,
        {"op": "Call", "func": "before", "args": [], "res": '{"Int":40}'}, TARGET, {"op": "Call", "func": "use", "args": [r], "res": s}, {"op": "Store", "mem": p, "val": s}, {"op": "Load", "mem": p, "res": '{"Sym":2}'},
        {"op": "Call", "func": "far", "args": ['{"Sym":2}']}, {"op": "Call", "func": "aside", "args": ['{"Sym":7}']}, {"op": "Call", "func": "%reg", "args": [r]}, {"op": "Call", "func": "malloc", "args": [r]},
    )
    edges = walks.def_use_edges(t)
    assert {(e.src, e.dst) for e in edges.collect()} == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (1, 7), (1, 8)}
    assert {c.func for c in walks.reachable_calls(t, edges).collect()} == {"use", "far", "%reg", "malloc"}
    types = spark.createDataFrame([("malloc", "%struct.s* (i64)"), ("use", "void (%struct.s*)"), ("far", "void (%struct.q*)")], "func string, type string")
    both = trace(spark, TARGET, {"op": "Ret"}, trace_id=1).unionByName(t)
    weights = lambda df: {x.func: x.weight for x in df.collect()}
    assert weights(walks.causal_dictionary(both, edges, types)) == {"use": (1 + 2 + 1) / 2, "far": 0.5, "malloc": (1 + 10 + 2 + 1) / 2}
    assert weights(walks.causal_dictionary(both, edges, None, forward=False)) == {"before": (1 + 2) / 2}


def test_walks_of_nothing(spark):
    edges, none = spark.createDataFrame([], EDGE), spark.createDataFrame([], "func string, id string")
    assert walks.reach(edges, none, ["func"]).count() == 0 and walks.spliced(none, edges, ["func"]).count() == 0
    assert walks.block_paths(edges, spark.createDataFrame([], "func string, start string, stop string"), 3).count() == 0
    assert walks.numbered_choices(spark.createDataFrame([], "key string, pos int, options array<string>"), ["key"], "pos", "options").filter(F.col("number") >= 0).count() == 0


def test_block_paths_follow_only_edges_to_their_stop(spark, monkeypatch):
    """A hub with many blocks after it: the search for a stop gets the edges that lead to it, not all of the hub's."""
    rows = [("f", "hub", f"b{i:03d}") for i in range(60)] + [("f", f"b{i:03d}", f"s{i:03d}") for i in range(60)]
    edges = spark.createDataFrame(rows, "func string, src string, dst string")
    ends = edges.filter("dst like 's%'").selectExpr("func", "'hub' as start", "dst as stop")
    seen, search = [], walks._paths_within
    monkeypatch.setattr(walks, "_paths_within", lambda step, *rest: seen.append(step) or search(step, *rest))
    found = {(r.stop, tuple(r.path)) for r in walks.block_paths(edges, ends, 2).collect()}
    assert found == {(f"s{i:03d}", ("hub", f"b{i:03d}", f"s{i:03d}")) for i in range(60)}
    assert {r["n"] for r in seen[0].groupBy("stop").agg(F.count("*").alias("n")).collect()} == {2}
