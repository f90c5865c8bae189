"""The feedback loop: keyed state, restarts, whole slices, and what a label that comes again does."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tracelode.operators import vectors
from tracelode.streaming import feedback, state

LABELS = "dp_id long, is_alarm boolean"


@pytest.fixture
def points(spark):
    return spark.createDataFrame([(i, [float(i % 7), i / 10]) for i in range(40)] + [(90, None)], "dp_id long, x array<double>")


def feed_of(spark, folder, *batches):
    for rows in batches:
        spark.createDataFrame(rows, LABELS).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(LABELS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def scores_of(df):
    return {r.dp_id: r.score for r in df.collect()}


def wanted(spark, points, rows):
    labels = spark.createDataFrame(rows, LABELS)
    return {i: s for i, s in scores_of(vectors.kde_scores(points, labels.join(points, "dp_id"))).items() if i != 90}


BATCHES = [(0, True), (5, False)], [(1, True), (20, False), (5, True), (77, True), (None, True), (3, None)], [(1, True), (33, False)]
COUNTED = [(0, True), (5, False), (1, True), (20, False), (33, False)]


def test_state_gives_the_batch_scores_and_counts_a_label_once(spark, points, tmp_path):
    state.follow(feed_of(spark, tmp_path / "in", *BATCHES), points, str(tmp_path / "loop"), best=3, size=7).awaitTermination()
    want = wanted(spark, points, COUNTED)
    assert scores_of(state.scores(spark, str(tmp_path / "loop"))) == pytest.approx(want)
    ask = [r.dp_id for r in state.to_ask(spark, str(tmp_path / "loop"), 3).collect()]
    assert ask == sorted(set(want) - {i for i, _ in COUNTED}, key=lambda i: (-round(want[i], 12), i))[:3]
    # A later run of the same loop goes on from the state.
    state.follow(feed_of(spark, tmp_path / "in", [(7, True)]), points, str(tmp_path / "loop"), best=3, size=7).awaitTermination()
    assert scores_of(state.scores(spark, str(tmp_path / "loop"))) == pytest.approx(wanted(spark, points, [*COUNTED, (7, True)]))


def test_a_batch_that_failed_counts_once(spark, points, tmp_path, monkeypatch):
    feed, write, calls = feed_of(spark, tmp_path / "in", *BATCHES), DataFrameWriter.parquet, []

    def failing(self, path, *args, **kwargs):
        calls.append(path)
        write(self, path, *args, **kwargs)
        if len(calls) == 2:
            raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", failing)
        with pytest.raises(StreamingQueryException):
            state.follow(feed, points, str(tmp_path / "loop"), size=10).awaitTermination()
    assert len(calls) == 2
    state.follow(feed, points, str(tmp_path / "loop"), size=10).awaitTermination()
    assert scores_of(state.scores(spark, str(tmp_path / "loop"))) == pytest.approx(wanted(spark, points, COUNTED))


def test_loop_asks_the_best_open_point(spark, points, tmp_path):
    few = points.filter("dp_id < 6")
    asked = state.ask(few, lambda i: i < 2, 3, [(0, True)], str(tmp_path), size=2).orderBy("attempt").collect()
    assert [r.dp_id for r in asked][:2] == [0, 1] and len(asked) == 4
    labels, want = [(0, True)], []
    for _ in range(3):
        s = wanted(spark, few, labels)
        best = min(set(s) - {i for i, _ in labels}, key=lambda i: (-s[i], i))
        want.append(best)
        labels.append((best, best < 2))
    assert [r.dp_id for r in asked][1:] == want
    asked = state.ask(few, lambda i: None if i == 0 else True, 3, [], str(tmp_path / "b"))
    assert asked.count() == 0


def test_a_marked_slice_is_labelled_as_a_whole(spark):
    points = spark.createDataFrame([(i, "a" if i % 2 else "b", i // 100) for i in range(300)], "dp_id long, bc string, slice_id long")
    labels = spark.createDataFrame([(149, True, True), (3, False, False), (900, True, True)], "dp_id long, is_alarm boolean, whole_slice boolean")
    got = {(r.dp_id, r.is_alarm) for r in state.whole_slices(labels, points).collect()}
    assert got == {(3, False)} | {(i, True) for i in range(100, 199) if i % 2 and 99 <= i < 199}


def test_batches_add_up_in_any_order(spark, points):
    labels = spark.createDataFrame(COUNTED, LABELS)
    parts = [feedback.contribution(points.filter("x is not null"), labels.filter(F.col("is_alarm") == flag), 1.0) for flag in (False, True)]
    assert scores_of(feedback.scores(feedback.merge(parts[0], parts[1]))) == pytest.approx(wanted(spark, points, COUNTED))


def test_loop_without_labels_or_points(spark, points, tmp_path):
    state.follow(feed_of(spark, tmp_path / "in", []), points, str(tmp_path / "loop")).awaitTermination()
    empty = points.filter("dp_id < 0")
    state.follow(feed_of(spark, tmp_path / "in2", [(1, True)]), empty, str(tmp_path / "loop2")).awaitTermination()
    assert state.ask(empty, lambda i: True, 2, [], str(tmp_path / "c")).count() == 0


@pytest.mark.parametrize("flags", ["alarm", "clean"])
def test_kernel_scores_with_one_kind_of_label(spark, points, flags):
    labels = points.filter("dp_id in (3, 8)").withColumn("is_alarm", F.lit(flags == "alarm"))
    for score in (vectors.leave_in_scores, vectors.leave_one_out_scores, vectors.kde_scores):
        out = score(points, labels)
        assert out.count() == out.select("dp_id").count() >= 40
        assert all(r.score == r.score for r in out.collect())
