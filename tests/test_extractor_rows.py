"""Extractors share their running aggregates, and a row goes on only for subjects to which it can matter."""

from pyspark.sql import functions as F

from tracelode.operators import extractors
from tracelode.sources import relations as rel


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_running_aggregates_are_shared(spark, small):
    """As many windows of sets as one extractor has, however many extractors there are."""
    ti = rel.trace_instrs(spark, small)
    plan = plan_of(extractors.run(ti, [extractors.Result(), extractors.ResultCheck(), *[extractors.ArgumentAfter(i) for i in range(4)]]))
    assert 0 < plan.count("collect_set(") <= 3


class Everything(extractors.Causality):
    """As before: all relevant rows go on for all subjects."""

    def needs(self, value, at, start):
        return F.lit(True)


def test_rows_that_can_not_matter_are_dropped_and_change_nothing(spark, small):
    ti = rel.trace_instrs(spark, small).cache()
    for after in (False, True):
        few, all_ = (kind(after, 3) for kind in (extractors.Causality, Everything))
        got, want = (extractors.run(ti, [e]).orderBy(*rel.KEY).collect() for e in (few, all_))
        assert len(got) > 10 and got == want
    value, at, start = F.lit('{"Sym":1}'), F.lit(1), F.lit(0)
    kept = ti.filter(few.needs(value, at, start)).filter("op = 'ICmp'")
    assert 0 < kept.count() < ti.filter("op = 'ICmp'").count() and kept.filter(~(F.col("op0") == value) & ~(F.col("op1") == value)).count() == 0


def test_own_aggregates_still_work(spark, small):
    """An extractor may bring a running aggregate of its own beside the shared ones."""

    class Loads(extractors.Extractor):
        name = "loads"

        def running(self):
            return {"before": F.count(F.when(F.col("op") == "Load", 1))}

        def any(self):
            return {"two": F.col("loads_before") >= 2}

    ti = rel.trace_instrs(spark, small)
    got = extractors.run(ti, [Loads(), extractors.Result()])
    want = ti.join(ti.filter("is_target").groupBy(*rel.KEY).agg(F.max("idx").alias("t")), rel.KEY).filter("idx >= t").groupBy(*rel.KEY).agg((F.count_if((F.col("op") == "Load") & (F.col("idx") > F.col("t"))) > 0).alias("any"))
    assert got.count() == want.count() and got.filter("loads.two").count() <= want.filter("any").count()
