"""Call-graph walks against plain versions, and edges that stay where they are while a small frontier travels."""

import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import graph


@pytest.fixture
def many_edges(spark, tmp_path):
    """Edges far above the size that Spark broadcasts, of which few have to do with the target."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    far = spark.range(60000).select(F.concat(F.lit("e"), "id").alias("edge_id"), F.sha1(F.col("id").cast("string")).alias("caller"), F.sha1((F.col("id") + 1).cast("string")).alias("callee"))
    near = spark.createDataFrame([("n1", "b", "t"), ("n2", "a", "b"), ("n3", "a", "b"), ("n4", "b", "c"), ("n5", "c", "d")], "edge_id string, caller string, callee string")
    far.unionAll(near).write.parquet(str(tmp_path / "edges"))
    yield spark.read.parquet(str(tmp_path / "edges"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_frontiers_go_to_the_edges(spark, many_edges):
    targets = spark.createDataFrame([("t",)], "target string")
    for found in (graph.entries(many_edges, targets, 1), graph.edge_entries(many_edges, targets, 1)):
        assert "LeftSemi, BuildRight" in plan(found)
        assert {r.entry for r in found.collect()} == {"a"}
    ends = spark.createDataFrame([("a", "d")], "start string, stop string")
    paths = graph.simple_paths(many_edges, ends, 3)
    assert "LeftSemi, BuildRight" in plan(paths) and [r.path for r in paths.collect()] == [["a", "b", "c", "d"]]
    members = graph.reachable(many_edges, spark.createDataFrame([("t", "a")], "target string, entry string"), 2)
    assert "SortMergeJoin" not in plan(members) and sorted(r.func for r in members.collect()) == ["a", "b", "c"]
    kept = graph.reduced(members, many_edges, 1, F.col("func") == "c")
    assert "SortMergeJoin" not in plan(kept) and sorted(r.func for r in kept.collect()) == ["b", "c"]
    types = many_edges.select(F.col("caller").alias("func")).distinct().select("func", F.lit("void (%struct.x*)").alias("type"))
    related = graph.related_by_structs(members.withColumn("target", F.lit("b")), types)
    assert "SortMergeJoin" not in plan(related) and {r.func: r.related for r in related.collect()} == {"a": True, "b": True, "c": True}


def test_walks_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(f"e{i}", f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for i in range(45)]
    step = {(a, b) for _, a, b in edges}
    e = spark.createDataFrame(edges, "edge_id string, caller string, callee string")
    targets = spark.createDataFrame([("n1",), ("n2",), ("none",)], "target string")
    up = lambda f: {a for a, b in step if b == f} or {f}
    rise = lambda f, n: {f} if n == 0 else {y for x in up(f) for y in rise(x, n - 1)}
    for depth in (0, 1, 2):
        got = [tuple(r) for r in graph.entries(e, targets, depth).select("target", "entry").collect()]
        assert sorted(got) == sorted({(t, x) for t in ("n1", "n2") for a, b in step if b == t for x in rise(a, depth)})
        calls = [tuple(r) for r in graph.edge_entries(e, targets, depth).select("target", "edge_id", "entry").collect()]
        assert sorted(calls) == sorted((b, i, x) for i, a, b in edges if b in ("n1", "n2") for x in rise(a, depth))
    starts = spark.createDataFrame([("n1", "n3"), ("n2", "n4"), ("n2", "n4")], "target string, entry string")
    want = set()
    for t, s in (("n1", "n3"), ("n2", "n4")):
        level = {s}
        for _ in range(3):
            want |= {(t, s, f) for f in level}
            level = {b for a, b in step if a in level and b != t}
    members = graph.reachable(e, starts, 2)
    assert sorted(tuple(r) for r in members.collect()) == sorted(want)
    related = lambda f: int(f[1:]) % 5 == 0
    leads = lambda f, n: related_in(f) or (n > 0 and any(leads(b, n - 1) for a, b in step if a == f))
    kept = set()
    for t, s, f in want:
        related_in = lambda x, t=t, s=s: (t, s, x) in want and related(x)
        if leads(f, 2):
            kept.add((t, s, f))
    got = graph.reduced(members, e, 2, F.substring("func", 2, 9).cast("int") % 5 == 0).select("target", "entry", "func").collect()
    assert sorted(tuple(r) for r in got) == sorted(kept)
