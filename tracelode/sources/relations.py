"""The engine's relations derived from star-schema tables, so that every operator has data to run on.

Each is deterministic and uses whole-number arithmetic only. Values of a trace are canonical JSON strings, as in
traces read from files. ``KEY`` names a trace: target, package file, slice and trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["target", "bc", "slice_id", "trace_id"]
SLICE = ["target", "bc", "slice_id"]
EVENTS_A_TASK = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bc, func, n: call sites of a function (part brand) in a package file (supplier nation)."""
    li, su, pa = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    joined = li.select("l_suppkey", "l_partkey").join(su, li["l_suppkey"] == su["s_suppkey"]).join(pa, li["l_partkey"] == pa["p_partkey"])
    return joined.groupBy(F.concat(F.lit("nation_"), F.col("s_nationkey")).alias("bc"), F.col("p_brand").alias("func")).agg(F.count("*").alias("n"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One package for each region: name, fetched, build_result and libs (its nations, by key)."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    libs = n.groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("libs"))
    state = F.when(F.col("r_regionkey") % 3 == 0, "success").when(F.col("r_regionkey") % 3 == 1, "nobc").otherwise("notbuilt")
    return r.join(libs, r["r_regionkey"] == libs["n_regionkey"]).select(F.col("r_name").alias("name"), (F.col("r_regionkey") % 2 == 0).alias("fetched"), state.alias("build_result"), "libs")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layered call graph region > nation > customer > order > part, of all rows: edge_id, caller, callee."""
    n, cu, o, li = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders", "lineitem"))
    name = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    part = li.select(F.concat(F.lit("p"), F.col("l_orderkey"), F.lit("_"), F.col("l_linenumber")).alias("edge_id"), name("order_", "l_orderkey").alias("caller"), name("part_", "l_partkey").alias("callee"))
    order = o.select(name("o", "o_orderkey").alias("edge_id"), name("customer_", "o_custkey").alias("caller"), name("order_", "o_orderkey").alias("callee"))
    customer = cu.select(name("c", "c_custkey").alias("edge_id"), name("nation_", "c_nationkey").alias("caller"), name("customer_", "c_custkey").alias("callee"))
    nation = n.select(name("n", "n_nationkey").alias("edge_id"), name("region_", "n_regionkey").alias("caller"), name("nation_", "n_nationkey").alias("callee"))
    return part.unionAll(order).unionAll(customer).unionAll(nation)


def _value(kind: str, number: Column) -> Column:
    return F.concat(F.lit(f'{{"{kind}":'), number.cast("string"), F.lit("}"))


def trace_instrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each instruction of a trace: a user's events of one week; the first purchase is the target.

    Traces are dealt to a task for each EVENTS_A_TASK events, so what a task sorts by trace doesn't grow with the table.
    """
    e = table(spark, sf_dir, "events")
    tasks = max(1, -(-e.count() // EVENTS_A_TASK))
    e = e.select("event_id", "user_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = e.withColumn("week", F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("long")).repartition(tasks, "user_id", "week")
    w = Window.partitionBy("user_id", "week")
    order = w.orderBy("ts", "event_id")
    e = e.withColumn("idx", (F.row_number().over(order) - 1).cast("int")).withColumn("last", F.count("*").over(w) - 1)
    e = e.withColumn("t", F.min(F.when(F.col("event_type") == "purchase", F.col("idx"))).over(w))
    k, kind = F.col("k"), F.col("event_type")
    op = F.when(kind == "purchase", "Call").when(F.col("idx") == F.col("last"), "Ret").when((k % 11 == 0) & (kind != "signup"), "Store")
    op = op.when(kind == "signup", "Call").when(kind == "error", "CondBr").when(kind == "click", "ICmp").when(k % 13 == 0, "GEP").when(k % 17 == 0, "Bin").otherwise("Load")
    e = e.withColumn("op", op)
    sym = lambda n: _value("Sym", k % n)
    is_ = lambda *ops: F.col("op").isin(*ops)
    return e.select(
        F.lit("purchase").alias("target"), F.concat(F.lit("pkg"), F.col("user_id") % 3).alias("bc"), F.col("user_id").cast("long").alias("slice_id"), F.col("week").alias("trace_id"), "idx",
        F.coalesce(F.col("idx") == F.col("t"), F.lit(False)).alias("is_target"), F.concat(F.lit("src/u"), F.col("user_id"), F.lit(".c:"), k, F.lit(":"), F.col("idx")).alias("loc"), "op",
        F.when(is_("Call"), F.when(kind == "purchase", "purchase").otherwise(F.concat(F.lit("f"), k % 7))).alias("func"),
        F.when(is_("Call"), F.array(sym(10))).alias("args"),
        F.when(is_("ICmp"), F.when(k % 2 == 0, "EQ").otherwise("NE")).alias("pred"),
        F.when(is_("ICmp", "Bin", "Ret"), sym(10)).alias("op0"),
        F.when(is_("ICmp"), F.when(k % 4 == 0, F.lit('{"Int":0}')).otherwise(sym(7))).when(is_("Bin"), sym(7)).alias("op1"),
        F.when(is_("CondBr"), _value("ICmp", k % 3)).alias("cond"),
        F.when(is_("CondBr"), F.when(k % 2 == 0, "Then").otherwise("Else")).alias("br"),
        (is_("CondBr") & (k % 5 == 0)).alias("beg_loop"), (is_("Load") & (k % 9 == 0)).alias("end_loop"),
        F.when(is_("Store", "Load", "GEP"), sym(10)).alias("mem"), F.when(is_("Store"), sym(5)).alias("val"),
        F.when(is_("ICmp"), _value("ICmp", k % 3)).when(is_("Call", "GEP", "Bin", "Load"), sym(5)).alias("res"), "k",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dp_id, label and x (array of double)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dp_id"), "label", F.col("embedding").cast("array<double>").alias("x"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and labels: what quality and toxicity say of a datapoint."""
    found = F.filter(F.array(F.when(F.col("quality") == 0, "retval-alarm"), F.when(F.col("toxic") == 1, "argrel-alarm")), lambda x: x.isNotNull())
    return table(spark, sf_dir, "labels").select("doc_id", found.alias("labels"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempt (from 1, by doc_id), dp_id and is_alarm; places are counted by ranges of doc_id, so no task orders all rows."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic", F.floor(F.col("doc_id") / (1 << 16)).alias("_range"))
    before = lab.groupBy("_range").agg(F.count("*").alias("_n"))
    before = before.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("doc_id"))
    return lab.join(before, "_range").select((place + F.col("_before")).cast("int").alias("attempt"), F.col("doc_id").alias("dp_id"), (F.col("toxic") == 1).alias("is_alarm"))
