"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its distinct lower-case words and the prefixes of the longer ones, which carry what
inflected forms share; each falls into one of 2^HASH_BITS slots by CRC-32. The score is
sigmoid(b + sum w_i + sum over pairs of <v_i, v_j>) over the slots present, so a pair can weigh more than its
parts: the pairwise sum is computed as half of |sum v_i|^2 - sum |v_i|^2.

The machine is fitted on the driver, on a bounded sample: at most MAX_ROWS labelled rows of each class, those
least by hash of doc_id. A slot gets weights if a class prefers it at a z score of MIN_Z, or if it is one of two words that
together tell the class better than either alone: of the sample's rows with both within WINDOW words of each other, at least
MIN_PAIR_ROWS, the share of label 1 differs from that of the rows with either one, both by a signed root of the deviance of
MIN_PAIR_Z or more and in the same direction (the MAX_PAIRS strongest pairs). All other slots weigh zero, which keeps the noise
of thousands of ordinary terms out of long documents. Executors reduce the sample's texts to slots, and
counts for each slot and pair are summed before anything reaches the driver; only the slots that pass are sent on. Scoring
covers every whole text, and there a pair counts at any distance; the weights it needs are of bounded size.

Defined cases: null or empty text scores sigmoid(b); a row without terms, with a share EMPTY of the weight,
teaches that such a text isn't toxic. Label rows with null doc_id or
toxic are ignored, and repeated ones count as 1 if any is 1. Without labels of both classes every score is the rate of
label 1 (0 without labels). Repeated rows each get a row. An empty table gives an empty table. Columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

HASH_BITS = 22
PREFIXES = (4, 5, 6)
MAX_ROWS = 6000
MIN_Z = 4.0
MAX_SLOTS = 8192
WINDOW = 5
MIN_PAIR_ROWS = 8
MIN_PAIR_Z = 6.0
MAX_PAIRS = 1024
EMPTY = 0.05
WORD = re.compile(r"\w+")


@dataclass
class Machine:
    """b, and for the slots listed in ascending order w and v."""

    bias: float
    slots: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def margin(self, at: np.ndarray) -> float:
        """at: places in ``slots`` of the distinct slots present."""
        v = self.v[at]
        return self.bias + float(self.w[at].sum()) + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())


def slots(text: str) -> set[int]:
    """The slots of a text's terms."""
    mask, out = (1 << HASH_BITS) - 1, set()
    for word in set(WORD.findall(text.lower())):
        raw = word.encode()
        out.add(crc32(raw, 1) & mask)
        for n in PREFIXES:
            if len(word) > n:
                out.add(crc32(word[:n].encode(), 2) & mask)
    return out


def near_pairs(text: str) -> np.ndarray:
    """The distinct pairs of slots of words within WINDOW words of each other, the lesser slot in the upper bits."""
    mask = (1 << HASH_BITS) - 1
    words = WORD.findall(text.lower())
    known = {w: crc32(w.encode(), 1) & mask for w in set(words)}
    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    pairs = [np.zeros(0, np.int64)]
    for back in range(1, WINDOW + 1):
        a, b = at[:-back], at[back:]
        pairs.append((np.minimum(a, b) << HASH_BITS | np.maximum(a, b))[a != b])
    return np.unique(np.concatenate(pairs))


def _pair_counts(texts: DataFrame) -> DataFrame:
    """pair, c, c1: in how many rows of toxic and text words come near each other, and in how many of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        n = 0

        def counted() -> pa.RecordBatch:
            found, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            ones = np.concatenate([np.full(len(x), y) for x, y in held])
            c1 = np.bincount(place, ones, len(found)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(place, minlength=len(found)).astype(np.int64)), pa.array(c1)], names=["pair", "c", "c1"])

        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((near_pairs(text), toxic))
                n += len(held[-1][0])
                if n >= 1 << 20:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    return texts.select("toxic", "text").mapInArrow(run, "pair long, c long, c1 long").groupBy("pair").agg(F.sum("c").alias("c"), F.sum("c1").alias("c1"))


def _root_deviance(c: Column, c1: Column, rate: Column) -> Column:
    """How far c1 of c is from the rate, signed."""
    term = lambda n, share: F.when(n > 0, n * F.log(n / (c * share))).otherwise(0.0)
    return F.signum(c1 / c - rate) * F.sqrt(F.greatest(F.lit(0.0), 2 * (term(c1, rate) + term(c - c1, 1 - rate))))


def _telling_pairs(texts: DataFrame, counts: DataFrame, max_pairs: int) -> DataFrame:
    """lo, hi of the pairs that tell the class better than either of their words."""
    known = counts.select("slot", ((F.col("c1") + 0.5) / (F.col("c") + 1)).alias("rate"))
    pairs = _pair_counts(texts).filter(F.col("c") >= MIN_PAIR_ROWS)
    pairs = pairs.select("c", "c1", F.shiftright("pair", HASH_BITS).cast("int").alias("lo"), F.col("pair").bitwiseAND((1 << HASH_BITS) - 1).cast("int").alias("hi"))
    for side in ("lo", "hi"):
        pairs = pairs.join(known.select(F.col("slot").alias(side), F.col("rate").alias(f"rate_{side}")), side)
    by = [_root_deviance(F.col("c"), F.col("c1"), F.col(f"rate_{side}")) for side in ("lo", "hi")]
    pairs = pairs.select("lo", "hi", F.when(F.signum(by[0]) == F.signum(by[1]), F.least(F.abs(by[0]), F.abs(by[1]))).alias("z"))
    return pairs.filter(F.col("z") >= MIN_PAIR_Z).orderBy(F.col("z").desc(), "lo", "hi").limit(max_pairs).select("lo", "hi")


def score(m: Machine, text: str, place: dict[int, int]) -> float:
    """place: where each weighted slot is in ``m.slots``."""
    at = [place[s] for s in slots(text) & place.keys()]
    return 1 / (1 + float(np.exp(-np.clip(m.margin(np.array(sorted(at), np.int64)), -40, 40))))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows never learnt from: CRC-32 of doc_id as text leaves 1 modulo 3; a null doc_id isn't held out, and has no label."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, toxic, text of at most max_rows rows of each class, held-out rows excluded."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).filter(~held_out())
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    picked = known.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).unionAll(known.filter("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # At most 2 max_rows pairs of numbers.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), c.text_or_empty("text").alias("text")).join(F.broadcast(picked), "doc_id")


def _fit_machine(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, weight: np.ndarray, n_slots: int, k: int, steps: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the weighted logistic loss with L2 penalty; rows, cols: which row has which slot.

    A slot counts the more the more rows have it, so that of slots that come together the shared prefixes carry
    more than the single words, and a form not seen before is still told.
    """
    rng, n = np.random.default_rng(seed), len(y)
    size = np.bincount(cols, minlength=n_slots) / max(1, np.bincount(cols, minlength=n_slots).max(initial=1))
    size = size**0.3
    s = size[cols]
    theta = [np.zeros(1), np.zeros(n_slots), rng.normal(0, 0.02, (n_slots, k))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    penalty = (0.0, 2e-5, 5e-4)
    total = weight.sum()
    by_row = lambda x: np.bincount(rows, x, n)
    by_col = lambda x: np.bincount(cols, x, n_slots)
    for step in range(1, steps + 1):
        b, w, v = theta
        vs = v[cols] * s[:, None]
        sums = np.stack([by_row(vs[:, f]) for f in range(k)], axis=1)
        margin = b[0] + by_row(w[cols] * s) + 0.5 * (sums**2).sum(axis=1) - 0.5 * by_row((vs**2).sum(axis=1))
        err = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y) / total
        each = err[rows] * s
        grads = [np.array([err.sum()]), by_col(each), np.stack([by_col(each * (sums[rows, f] - vs[:, f])) for f in range(k)], axis=1)]
        for i, g in enumerate(grads):
            if i == 2 and 2 * step <= steps:  # pairs learn what the additive weights have missed
                continue
            g = g + penalty[i] * theta[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            theta[i] = theta[i] - 0.05 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return float(theta[0][0]), theta[1] * size, theta[2] * size[:, None]


def fit(docs: DataFrame, labels: DataFrame, k: int = 4, steps: int = 500, seed: int = 7, max_rows: int = MAX_ROWS, min_z: float = MIN_Z, max_slots: int = MAX_SLOTS, max_pairs: int = MAX_PAIRS) -> Machine:
    """max_rows: labelled rows of each class in the sample; max_slots: slots with weights, of those that a class prefers at min_z; max_pairs: pairs of words whose slots have weights beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(slots(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "text", "slots"])

    none = np.empty(0, np.int64)
    sample = c.written(_sample(docs, labels, max_rows).select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, text string, slots array<int>"), "toxicity-sample")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        rate = np.clip(n1 / max(1, n1 + n0), 1e-6, 1 - 1e-6)
        return Machine(float(np.log(rate / (1 - rate))), none, none.astype(float), np.empty((0, k)))
    counts = sample.select("toxic", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("toxic").alias("c1"), F.count("*").alias("c"))
    p = F.col("c") / (n1 + n0)
    z = (F.col("c1") / n1 - (F.col("c") - F.col("c1")) / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    chosen = counts.filter((F.col("c") < n1 + n0) & (F.abs(z) >= min_z)).orderBy(F.abs(z).desc(), "slot").limit(max_slots)
    paired = {x for r in _telling_pairs(sample, counts, max_pairs).collect() for x in r}
    at = np.array(sorted({r["slot"] for r in chosen.select("slot").collect()} | paired), np.int64)
    # Slots that pass, at most max_slots and those of max_pairs pairs, and for each row of the bounded sample which of them it has.
    kept = sample.select("doc_id", "toxic", F.array_intersect("slots", F.lit(at.tolist()).cast("array<int>") if len(at) else F.array().cast("array<int>")).alias("slots")).collect()
    kept.sort(key=lambda r: (r["doc_id"], r["slots"]))
    y = np.array([r["toxic"] for r in kept], float)
    sets = [r["slots"] for r in kept]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cols = np.searchsorted(at, np.array([x for s in sets for x in s], np.int64))
    weight = np.where(y == 1, min(n0 / n1, 4.0), 1.0)
    # A text without any of the terms isn't toxic: one more row says so, with EMPTY of the weight.
    y, weight = np.r_[y, 0.0], np.r_[weight, EMPTY * weight.sum()]
    b, w, v = _fit_machine(rows, cols, y, weight, len(at), k, steps, seed)
    return Machine(b, at, w, v)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, machine: Machine | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns to keep, doc_id being one, and held_out, score and predicted for each row of docs."""
    m = machine or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {s: i for i, s in enumerate(m.slots.tolist())}
        for b in c.then(batches):
            found = pa.array([score(m, t.as_py(), place) for t in b.column("_scored")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), found], names=[*keep, "score"])

    kept = [F.col(k).cast("long").alias(k) if k == "doc_id" else F.col(k) for k in keep]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("score", T.DoubleType())])
    scored = docs.select(*kept, c.text_or_empty("text").alias("_scored")).mapInArrow(run, schema)
    return scored.select(*keep, held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))
