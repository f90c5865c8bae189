"""Versioned tables: snapshots, copies on write, conflicts, and what is opened; documents by key."""

import json

import pytest
from pyspark.sql import functions as F

from tracelode.sources.catalog import Workspace
from tracelode.sources.versions import Conflict, Versions


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(t, b, i) for t in ("f", "g/h", None) for b in ("a=b", "") for i in range(3)], "target string, bc string, n int")


def content(df):
    return sorted(((r.target, r.bc, r.n) for r in df.collect()), key=str)


def test_a_reader_sees_one_version(spark, rows, tmp_path):
    store = Versions(spark, str(tmp_path / "t"))
    assert store.latest().number == 0
    first = store.commit({"x": rows, "y": rows.limit(0)}, ["target", "bc"])
    assert content(store.latest().read("x")) == content(rows) and store.latest().read("y").columns == ["target", "bc", "n"]
    chosen = rows.filter("target = 'f' and bc = 'a=b' and n = 1")
    old = first.read("x")
    second = store.update("x", chosen, lambda now, keys: now.withColumn("n", F.when(F.col("n") == 1, 100).otherwise(F.col("n"))))
    assert content(old) == content(rows)  # read after the change, and still what it was
    assert sorted(r.n for r in second.read("x", target="f", bc="a=b").collect()) == [0, 2, 100]
    kept = lambda s: {p: f for p, f in s.tables["x"]["partitions"].items() if "=f/" not in p}
    assert kept(first) == kept(second) and len(kept(first)) == 4  # only one partition was written
    assert content(store.at(1).read("x")) == content(rows)
    files = {f.split("/data/")[1].split("/")[0] for f in second.read("x", target="g/h").inputFiles()}
    assert files == {second.tables["x"]["partitions"]["_target=g%2Fh/_bc=a%3Db"][0]}
    assert content(second.read("x", target=None)) == content(rows.filter("target is null"))
    assert second.read("x", bc="nowhere").count() == 0


def test_writers_and_what_is_left_behind(spark, rows, tmp_path):
    store = Versions(spark, str(tmp_path / "t"))
    before = store.commit({"x": rows, "y": rows}, ["target", "bc"])
    store.commit({"x": rows.filter("n = 0")}, ["target", "bc"], append=True)
    with pytest.raises(Conflict):
        store.commit({"x": rows}, ["target", "bc"], before=before)
    assert store.latest().number == 2 and store.latest().read("x").count() == 24
    store.drop(["x", "y", "unknown"], target="f")
    assert {r.target for r in store.latest().read("y").collect()} == {"g/h", None}
    store.update("x", rows.filter("target = 'g/h'"), lambda now, keys: now.filter("false"))
    assert {r.target for r in store.latest().read("x").collect()} == {None}
    assert store.update("x", rows.filter("false"), lambda now, keys: now).number == 4
    with pytest.raises(ValueError, match="other partitions"):
        store.update("y", rows.filter("target = 'g/h'"), lambda now, keys: now.withColumn("target", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="other columns"):
        store.commit({"x": rows.withColumn("m", F.lit(1))}, ["target", "bc"], append=True)
    with pytest.raises(KeyError):
        store.latest().read("z")
    with pytest.raises(KeyError):
        store.latest().read("x", n=1)
    gone = store.vacuum(keep=1)
    assert gone and store.latest().read("x").count() == 8 and store.latest().read("y").count() == 12
    with pytest.raises(KeyError):
        store.at(1)


def test_batches_continue_the_ids(spark, tmp_path):
    db = Workspace.init(spark, str(tmp_path))
    batch = lambda *r: spark.createDataFrame(list(r), "batch int, local_id int, callee string")
    db.append_batches("s", batch((0, 0, "f"), (1, 0, "f"), (1, 1, "g")))
    db.append_batches("s", batch((0, 0, "f"), (0, 1, "h")))
    assert sorted((r.callee, r.slice_id) for r in db.load("s").collect()) == [("f", 0), ("f", 1), ("f", 2), ("g", 0), ("h", 0)]


def test_documents_by_key(spark, tmp_path):
    db = Workspace.init(spark, str(tmp_path))
    for bc in ("x.bc", "y.bc"):
        for s in range(3):
            docs = {f"slices/f/{bc}/{s}": {"entry": "main", "caller": "main", "callee": "f", "instr": "a.c:1:2", "functions": []}}
            docs |= {f"traces/f/{bc}/{s}/{t}": {"instrs": [{"loc": "l", "sem": {"Call": {"func": {"Func": "f"}, "args": []}}}], "target": 0, "statically_checked": False} for t in range(2)}
            docs |= {f"features/f/{bc}/{s}/0": {"ret": {"used": s == 1}}}
            for path, doc in docs.items():
                file = tmp_path / "analysis" / f"{path}.json"
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_text(json.dumps(doc))
    one = db.find_traces("f", "x.bc", 1, 1)
    assert len(one.inputFiles()) == 1 and one.first()["trace_id"] == 1 and one.first()["target_idx"] == 0
    assert len(db.find_slices("f", slice_id=range(1, 3)).inputFiles()) == 4 and db.find_slices("f", "y.bc").count() == 3
    assert json.loads(db.find_features("f", "x.bc", 1, 0).first()["doc"]) == {"ret": {"used": True}}
    points = db.find_datapoints("f", "x.bc", range(0, 2))
    assert sorted((r.slice_id, r.trace_id) for r in points.collect()) == [(0, 0), (1, 0)] and points.first()["entry"] == "main"
    assert db.find_traces("f", "x.bc", range(7, 9)).count() == 0
    with pytest.raises(KeyError, match="no function g"):
        db.find_slices("g")
    with pytest.raises(KeyError, match="f/x.bc/9"):
        db.find_slices("f", "x.bc", 9)
