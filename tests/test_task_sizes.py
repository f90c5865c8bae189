"""What one task holds of traces and edges doesn't grow with the tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelode.operators import walks
from tracelode.sources import relations as rel
from tracelode.sources.relations import KEY


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_traces_are_dealt_by_the_number_of_events(spark, tmp_path):
    """Eight times the events, eight times the tasks, also behind AQE, which would put small partitions together."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    n = events.count()
    copies = events.crossJoin(spark.range(8).withColumnRenamed("id", "copy")).withColumn("user_id", F.col("user_id") + 10**6 * F.col("copy")).withColumn("event_id", F.col("event_id") + 10**7 * F.col("copy")).drop("copy")
    copies.write.parquet(str(tmp_path / "events.parquet"))
    old, rel.EVENTS_A_TASK = rel.EVENTS_A_TASK, n // 4
    try:
        got = rel.trace_instrs(spark, str(tmp_path))
        edges = walks.def_use_edges(got)
        assert got.count() == 8 * n and most_in_a_task(got) < n // 2
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1  # uses, results and places are found in one pass
    finally:
        rel.EVENTS_A_TASK = old


def test_one_sort_finds_values_and_places(spark, small):
    """The edges against the two windows, of values and of places, that they are defined by."""
    ti = rel.trace_instrs(spark, small).cache()
    used = F.array_distinct(F.filter(F.concat(F.array("op0", "op1", "cond", "mem", "val"), F.coalesce("args", F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    uses, gives = ti.select(*KEY, "idx", F.explode(used).alias("v")), ti.select(*KEY, F.col("idx").alias("src"), F.col("res").alias("v"))
    by_value = uses.join(gives, [*KEY, "v"]).filter("src < idx").groupBy(*KEY, "idx", "v").agg(F.max("src").alias("src"))
    before = Window.partitionBy(*KEY, "mem").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    by_place = ti.filter("op in ('Load', 'Store')").withColumn("src", F.max(F.when(F.col("op") == "Store", F.col("idx"))).over(before)).filter("op = 'Load' and mem is not null and src is not null")
    want = by_value.select(*KEY, "src", "idx").union(by_place.select(*KEY, "src", "idx")).distinct().collect()
    got = walks.def_use_edges(ti).select(*KEY, "src", "dst").collect()
    assert len(want) > 50 and sorted(map(tuple, got)) == sorted(map(tuple, want))
