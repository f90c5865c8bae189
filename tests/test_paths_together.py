"""First block paths of many ends of a start, searched together."""

import pytest
from pyspark.sql import functions as F
from test_walks import edges_of, random_graphs, simple_paths

from tracelode.operators import walks

ENDS = "func string, start string, stop string"


def as_rows(df):
    return sorted((r.func, r.start, r.stop, tuple(r.path)) for r in df.collect())


@pytest.mark.parametrize("seed,backward", [(0, False), (1, False), (2, True)])
def test_together_as_one_by_one(spark, monkeypatch, seed, backward):
    """Blocks at several depths, repeated edges, a start as its own stop; functions with loops go on one by one."""
    graphs = {f: g if backward and f == "f1" else [(a, b) for a, b in g if a < b] for f, g in random_graphs(seed, 2, 8, 26).items()}
    ends = [(f, a, f"n{i:02d}") for f in graphs for a in ("n00", "n01") for i in range(8)] + [("f9", "n00", "n01")]
    edges, todo = edges_of(spark, graphs), spark.createDataFrame(ends, ENDS)
    one_by_one, search = [], walks._paths_within
    monkeypatch.setattr(walks, "TOGETHER", 0)
    monkeypatch.setattr(walks, "_paths_within", lambda step, ends, *rest: one_by_one.append(ends) or search(step, ends, *rest))
    want = sorted((f, a, b, tuple(p)) for f, a, b in ends for p in simple_paths(sorted(set(graphs.get(f, []))), a, b)[:3] if len(p) > 1 or a == b)
    assert as_rows(walks.block_paths(edges.unionAll(edges.limit(9)), todo, 3)) == want
    assert {r.func for e in one_by_one for r in e.collect()} <= ({"f1"} if backward else set())


def test_ends_of_a_start_share_the_search(spark, monkeypatch):
    """Three hundred stops behind one block: nothing is searched for each of them."""
    rows = [("f", "in", f"a{i}") for i in range(4)] + [("f", f"a{i}", "hub") for i in range(4)] + [("f", "hub", f"s{i:03d}") for i in range(300)]
    edges = spark.createDataFrame(rows, "func string, src string, dst string")
    ends = edges.filter("dst like 's%'").selectExpr("func", "'in' as start", "dst as stop")
    monkeypatch.setattr(walks, "_paths_within", None)
    monkeypatch.setattr(walks, "reach", None)
    got = walks.block_paths(edges, ends, 2)
    assert got.count() == 600 and {(r.path[1], r.path[2]) for r in got.select("path").collect()} == {("a0", "hub"), ("a1", "hub")}
    assert got.groupBy("stop").agg(F.count("*").alias("n")).filter("n != 2").count() == 0
