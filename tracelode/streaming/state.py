"""The feedback loop with keyed state: a state store holds two sums of kernels for each datapoint, a range of datapoints for each key.

Points are dealt by hash into ranges of about RANGE points and enter the state once, with the first micro-batch. A label joins its point, goes to every range, and
adds its kernels to that range's sums, so a micro-batch reads and writes state and nothing else: no version of all points is rewritten, and a
batch that is run again after a failure starts from the state before it, so that each label counts once. A label for a point that has one already changes nothing.

Each range answers a micro-batch with its best points that are still open; the best of all ranges is what to ask next. The scores of all
points are read from the state store itself (``scores``).

Defined cases: points without vector, and labels without value or whose point is unknown, take no part. Of several labels of a point in one micro-batch one counts: an alarm if any
of them is. A range without labels has scores of 0. Repeated points count each. Without points the stream has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Points of one key, and so of one value in the state store.
RANGE = 2048
BEST = "range int, dp_id long, score double, n long, m long"
_SUMS = "ids binary, pos binary, neg binary, labelled binary, n long, m long"


def _mean(total: np.ndarray, n: int) -> np.ndarray:
    return total / n if n else np.zeros(len(total))


def _range_of_points(bandwidth: float, best: int) -> StatefulProcessor:
    """State of one range: its points (``points``, written once) and their sums (``sums``, written at every label).

    The class stands in here with all that it uses, so that it travels by value: the process on the driver that prepares the query has only Spark's own packages.
    """

    def mean(total: np.ndarray, n: int) -> np.ndarray:
        return total / n if n else np.zeros(len(total))

    def kernels(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        scale, out = 1 / (bandwidth * np.sqrt(2 * np.pi)), np.empty((len(y), len(x)))
        for i, row in enumerate(y):
            d = x - row
            out[i] = np.exp(-np.einsum("ij,ij->i", d, d) / (2 * bandwidth**2)) * scale
        return out

    class RangeOfPoints(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.points = handle.getValueState("points", "x binary, dim int")
            self.sums = handle.getValueState("sums", sums_schema)

        def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
            new = initialState.sort_values("dp_id", kind="stable")
            x, none = np.stack(new["x"].to_numpy()).astype("<f8"), np.zeros(len(new), "<f8").tobytes()
            if self.points.exists():  # a range can arrive in several parts
                held, sums = self.points.get(), self.sums.get()
                self.points.update((held[0] + x.tobytes(), x.shape[1]))
                self.sums.update((sums[0] + new["dp_id"].to_numpy("<i8").tobytes(), sums[1] + none, sums[2] + none, *sums[3:]))
                return
            self.points.update((x.tobytes(), x.shape[1]))
            self.sums.update((new["dp_id"].to_numpy("<i8").tobytes(), none, none, b"", 0, 0))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            if not self.points.exists():
                return
            flat, dim = self.points.get()
            x = np.frombuffer(flat, "<f8").reshape(-1, dim)
            ids, pos, neg, labelled, n, m = self.sums.get()
            ids, pos, neg, labelled = np.frombuffer(ids, "<i8"), np.frombuffer(pos, "<f8").copy(), np.frombuffer(neg, "<f8").copy(), np.frombuffer(labelled, "<i8")
            new = pd.concat(list(rows))
            new = new[~new["label"].isin(labelled)].sort_values("is_alarm", ascending=False).drop_duplicates("label")
            if len(new):
                alarm = new["is_alarm"].to_numpy(bool)
                for at in range(0, len(new), 256):
                    near = kernels(np.stack(new["x"].to_numpy()[at : at + 256]).astype(float), x)
                    pos += near[alarm[at : at + 256]].sum(axis=0)
                    neg += near[~alarm[at : at + 256]].sum(axis=0)
                n, m = n + int(alarm.sum()), m + int((~alarm).sum())
                labelled = np.concatenate([labelled, new["label"].to_numpy("<i8")])
                self.sums.update((ids.tobytes(), pos.tobytes(), neg.tobytes(), labelled.astype("<i8").tobytes(), n, m))
            score, is_open = mean(pos, n) - mean(neg, m), ~np.isin(ids, labelled)
            ids, score = ids[is_open], score[is_open]
            first = np.lexsort((ids, -score))[:best]
            yield pd.DataFrame({"range": int(key[0]), "dp_id": ids[first], "score": score[first], "n": n, "m": m})

        def close(self) -> None:
            pass

    sums_schema = _SUMS
    return RangeOfPoints()


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs; the caller's own setting comes back afterwards."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def whole_slices(feedback: DataFrame, points: DataFrame, width: int = 50) -> DataFrame:
    """Labels with those marked whole_slice given to all points of their slice whose numbers lie from ``width`` below to below ``width`` above; points: dp_id, bc, slice_id."""
    own = points.select("dp_id", F.col("bc").alias("_bc"), F.col("slice_id").alias("_slice"))
    marked = feedback.filter("whole_slice").select("dp_id", "is_alarm").join(own, "dp_id").withColumnRenamed("dp_id", "_chosen")
    near = (F.col("dp_id") >= F.col("_chosen") - width) & (F.col("dp_id") < F.col("_chosen") + width)
    spread = marked.join(own, ["_bc", "_slice"]).filter(near).select("dp_id", "is_alarm")
    return feedback.filter("not whole_slice").select("dp_id", "is_alarm").unionByName(spread)


def best_points(feedback: DataFrame, points: DataFrame, bandwidth: float = 1.0, best: int = 1, size: int = RANGE) -> DataFrame:
    """A stream of each range's ``best`` open points after each micro-batch of labels (dp_id, is_alarm); points: dp_id, x."""
    held = points.filter("dp_id is not null and x is not null").select(F.col("dp_id").cast("long").alias("dp_id"), F.col("x").cast("array<double>").alias("x"))
    n = max(1, -(-held.count() // size))
    dealt = held.withColumn("range", F.pmod(F.xxhash64("dp_id"), F.lit(n)).cast("int"))
    of_label = held.dropDuplicates(["dp_id"]).withColumnRenamed("dp_id", "label")
    labels = feedback.filter("is_alarm is not null").select(F.col("dp_id").cast("long").alias("label"), "is_alarm").join(of_label, "label")
    everywhere = labels.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return everywhere.groupBy("range").transformWithStateInPandas(statefulProcessor=_range_of_points(bandwidth, best), outputStructType=BEST, outputMode="Update", timeMode="None", initialState=dealt.groupBy("range"))


def follow(feedback: DataFrame, points: DataFrame, folder: str, bandwidth: float = 1.0, best: int = 1, size: int = RANGE, trigger: dict | None = None) -> StreamingQuery:
    """Start the loop over a stream of labels. ``folder`` gets the checkpoint with the state, and candidates/batch=<number> with what each micro-batch answers."""
    spark = points.sparkSession

    def answer(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/candidates/batch={batch}")

    with _rocksdb(spark):
        writer = best_points(feedback, points, bandwidth, best, size).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
        return writer.foreachBatch(answer).trigger(**(trigger or {"availableNow": True})).start()


def to_ask(spark: SparkSession, folder: str, amount: int = 1) -> DataFrame:
    """dp_id and score of the best open points after the last micro-batch; each range sent its own best, so this is exact for an ``amount`` up to ``best``."""
    rows = spark.read.parquet(f"{folder}/candidates")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == last).orderBy(F.desc("score"), "dp_id").limit(amount).select("dp_id", "score")


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """dp_id, positive, negative and score of all points, from the state of the last micro-batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                pos, neg = _mean(np.frombuffer(r.pos, "<f8"), r.n), _mean(np.frombuffer(r.neg, "<f8"), r.m)
                yield pd.DataFrame({"dp_id": np.frombuffer(r.ids, "<i8"), "positive": pos, "negative": neg, "score": pos - neg})

    with _rocksdb(spark):
        state = spark.read.format("statestore").option("stateVarName", "sums").load(f"{folder}/checkpoint")
        return state.select("value.*").mapInPandas(run, "dp_id long, positive double, negative double, score double")


def ask(points: DataFrame, oracle: Callable[[int], bool | None], amount: int, seed: list[tuple[int, bool]], folder: str, bandwidth: float = 1.0, size: int = RANGE) -> DataFrame:
    """attempt, dp_id, is_alarm: the loop itself, ``amount`` questions after the seeds, or fewer once the oracle answers None or no point is open.

    One streaming query runs throughout; each answer is a file of its feed. Only the best point of each step reaches the driver. Without seeds the first question is the least dp_id.
    """
    spark, kind = points.sparkSession, "attempt int, dp_id long, is_alarm boolean"
    asked = [(i + 1, int(dp), bool(hit)) for i, (dp, hit) in enumerate(seed)]
    say = lambda rows: spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{folder}/answers")
    say(asked)
    feed = spark.readStream.schema(kind).parquet(f"{folder}/answers").select("dp_id", "is_alarm")
    state = f"{folder}/{uuid.uuid4().hex}"
    loop = follow(feed, points, state, bandwidth, 1, size, {"processingTime": "0 seconds"})
    try:
        for _ in range(amount):
            loop.processAllAvailable()
            best = to_ask(spark, state).first() if asked else points.filter("x is not null").agg(F.min("dp_id").alias("dp_id")).first()
            said = oracle(best["dp_id"]) if best is not None and best["dp_id"] is not None else None
            if said is None:
                break
            asked.append((len(asked) + 1, int(best["dp_id"]), bool(said)))
            say(asked[-1:])
    finally:
        loop.stop()
    return spark.createDataFrame(asked, kind)
