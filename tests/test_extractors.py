"""Extractors fused into one pass against the operators that find the same one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import extractors as x
from tracelode.operators import features
from tracelode.sources.relations import KEY

COLUMNS = "target string, bc string, slice_id long, trace_id long, idx int, is_target boolean, loc string, op string, func string, args array<string>, pred string, op0 string, op1 string, cond string, br string, beg_loop boolean, end_loop boolean, mem string, val string, res string, t int, value string, start int"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
VALUES = ['{"Sym":1}', '{"Sym":2}', '{"Arg":0}', '{"Glob":"g"}', '{"Alloc":3}', '{"AllocOf":{"Sym":1}}', '{"AllocOf":{"AllocOf":{"Arg":0}}}', '{"GEP":{"indices":[],"loc":{"Sym":1}}}', '{"Int":0}', '"Null"', '{"Int":4}']
CONDS = ['{"ICmp":1}', '{"ICmp":2}']


def traces(spark, seed, n=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.randrange(1, 22)
        at = rng.randrange(size) if i % 9 else -1
        for k in range(size):
            op = "Call" if k == at else rng.choice(["Call", "ICmp", "ICmp", "CondBr", "CondBr", "Load", "Store", "Store", "GEP", "Bin", "Ret"])
            row = dict.fromkeys(NAMES) | {"target": f"t{i % 2}", "bc": "a", "slice_id": i % 5, "trace_id": i, "idx": k, "is_target": k == at, "op": op, "beg_loop": rng.random() < 0.1, "end_loop": rng.random() < 0.1, "value": "theirs", "start": 9, "t": 7}
            val = lambda: rng.choice(VALUES)
            if op == "Call":
                row |= {"func": f"t{i % 2}" if k == at else rng.choice("fgh"), "args": [val() for _ in range(rng.randrange(4))], "res": rng.choice([None, *VALUES[:3]])}
            elif op == "ICmp":
                row |= {"pred": rng.choice(["EQ", "NE", "SLT"]), "op0": val(), "op1": val(), "res": rng.choice(CONDS)}
            elif op == "CondBr":
                row |= {"cond": rng.choice(CONDS), "br": rng.choice(["Then", "Else"])}
            elif op in ("Load", "GEP"):
                row |= {"mem": val(), "res": val()}
            elif op == "Store":
                row |= {"mem": val(), "val": val()}
            else:
                row |= {"op0": val(), "op1": val() if op == "Bin" else None}
            rows.append(tuple(row[c] for c in NAMES))
    return spark.createDataFrame(rows, COLUMNS)


def rows_of(df, names):
    return {tuple(r[k] for k in KEY): tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("seed", range(1))
def test_fused_extractors_find_what_the_single_ones_find(spark, seed):
    ti = traces(spark, seed).cache()
    long = ti.drop("t", "value", "start")
    fused = x.run(ti, x.standard(2, arguments=3)).cache()
    single = {"control_flow": features.control_flow(long), "ret": features.ret(long), "ret_check": features.ret_check(long)}
    single |= {f"arg_{i}_{w}": f(long, i) for i in range(3) for w, f in (("pre", features.arg_pre), ("post", features.arg_post))}
    for name, df in single.items():
        names = [c for c in df.columns if c not in KEY]
        got = rows_of(fused.filter(F.col(name).isNotNull()).select(*KEY, f"{name}.*"), names)
        assert got == rows_of(df, names), name
    words = features.top_functions(features.dictionary(long), 2)
    for name, after in (("before", False), ("after", True)):
        df = features.causality(long, words, after).join(words.select("target", "func", "rank"), ["target", "func"])
        names = [c for c in df.columns if c not in [*KEY, "func", "rank"]]
        want = {(*[r[k] for k in KEY], r["rank"] - 1): tuple(r[n] for n in names) for r in df.collect()}
        got = {(*[r[k] for k in KEY], r["pos"]): tuple(r["col"][n] for n in names) for r in fused.select(*KEY, F.posexplode(name)).collect()}
        assert got == want, name
    assert fused.count() == ti.filter("is_target").count()


def test_one_shuffle_of_the_instructions(spark):
    ti = traces(spark, 3)
    ti.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/long")
    plan = x.run(spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/long"), x.standard(2, arguments=2))._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("FileScan parquet") - plan.count("top_2") // max(1, plan.count("top_2")) <= 2  # the traces, and what was gathered before
    by_trace = [line for line in plan.splitlines() if "Exchange hashpartitioning(target" in line and "trace_id" in line]
    assert len(by_trace) == 1


def test_types_and_an_extractor_of_ones_own(spark):
    class Calls(x.Extractor):
        name = "calls"

        def relevant(self):
            return F.col("op") == "Call"

        def sum(self):
            return {"n_calls": F.when(F.col("op") == "Call", 1)}

        def last(self):
            return {"last_func": F.col("func")}

        def output(self, found):
            return {"n_calls": found["n_calls"], "ends_with_f": found["last_func"] == "f"}

    ti = traces(spark, 5)
    types = spark.createDataFrame([("t0", "void", 1), ("t1", "int", 0)], "target string, returns string, n_args int")
    got = x.run(ti, [x.Result(), x.ArgumentBefore(0), Calls()], types).collect()
    calls = {tuple(r[k] for k in KEY): (r["n"], r["f"]) for r in features.with_target(ti.drop("t", "value", "start")).groupBy(*KEY).agg(F.count_if(F.col("op") == "Call").alias("n"), F.max_by(F.when(F.col("op") == "Call", F.col("func")), F.when(F.col("op") == "Call", F.col("idx"))).alias("f")).collect()}
    assert got
    for r in got:
        assert (r["ret"] is None) == (r["target"] == "t0")
        assert r["arg_0_pre"] is None or r["target"] == "t0"
        n, f = calls[tuple(r[k] for k in KEY)]
        assert (r["calls"]["n_calls"], r["calls"]["ends_with_f"]) == (n, f == "f")
    with pytest.raises(ValueError, match="names"):
        x.run(ti, [x.Result(), x.Result()])


def test_no_traces(spark):
    out = x.run(traces(spark, 1).filter("idx < 0"), x.standard(2, arguments=1))
    assert out.count() == 0 and out.columns[:4] == KEY
