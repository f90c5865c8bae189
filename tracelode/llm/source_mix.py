"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents are dealt into shards by a seeded hash and put in seeded order, which makes a shard
one stream of words. The mix is counted in blocks of BLOCK words. Blocks go to sources by highest quotients
target / (2 n + 1), then within a source to its shards in the same way by their words, so each shard gets an
integer quota. A shard's blocks are those that follow a seeded place in its stream, which is taken as a circle:
a quota of more than one round takes every word that often, and the rest once more from that place on.

Only sums reach the driver: one for each source and one for each shard, of which a source has at most
MAX_SHARDS. Every document is looked at once for its size; the sizes, a narrow table, are written to the
shared folder. Shards hold about SHARD_WORDS words, so a source with most of the rows is many shards.

Defined cases: null text has size 0 and takes nothing. The null source is a source, the last one. Documents of one
hash are ordered by doc_id and size, so repeated rows and reruns agree. Sources without words have target 0. An
empty table gives an empty table. Columns besides doc_id, text and source are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _common as c

BLOCK = 32
SHARD_WORDS = 100_000
MAX_SHARDS = 1 << 14
#: The weights are given by source, so there are no more sources than someone can list.
MAX_SOURCES = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, limit: float = 2.0) -> list[float]:
    """Parts of share * sum(sizes) by weight; what exceeds limit * size is shared again until nothing does."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > limit * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = limit * sizes[i]
        left -= sum(out[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return out


def apportion(votes: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Sainte-Laguë: seats to the highest quotients votes / (2 n + 1), ties to the earlier, none above its cap.

    Rounding by the average divisor gives nearly all seats; the heap settles the few that are over or missing.
    """
    seats, total = min(seats, sum(caps)), float(sum(votes))
    if not seats or not total:
        return [0] * len(votes)
    got = [min(cap, int(v * seats / total + 0.5)) for v, cap in zip(votes, caps, strict=True)]
    over = sum(got) - seats
    if over > 0:
        heap = [(v / (2 * n - 1), -i) for i, (v, n) in enumerate(zip(votes, got, strict=True)) if n]
        heapify(heap)
        for _ in range(over):
            _, i = heappop(heap)
            got[-i] -= 1
            if got[-i]:
                heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    elif over < 0:
        heap = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes, got, strict=True)) if n < caps[i]]
        heapify(heap)
        for _ in range(-over):
            _, i = heappop(heap)
            got[i] += 1
            if got[i] < caps[i]:
                heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def steps(n_blocks: int, rng: np.random.Generator) -> tuple[int, int]:
    """m and s: block i of a shard is the ((m i + s) mod n_blocks)-th to be taken, in an order that the seed chooses."""
    m, s = (int(x) for x in rng.integers(0, max(1, n_blocks), 2))
    while math.gcd(m, n_blocks) != 1:
        m += 1
    return m, s


def _ranges() -> Column:
    """Word ranges of a document's words _a to _b that lie in what is taken of the blocks of its shard.

    _r words are taken once more, block by block in the shard's order; _n: the shard's words, _m and _s: its steps.
    """
    a, b, n, r, size = F.col("_a"), F.col("_b"), F.col("_n"), F.col("_r"), F.lit(BLOCK).cast("long")
    n_blocks = F.ceil(n / size).cast("long")
    turn = lambda i: F.pmod(F.col("_m") * i + F.col("_s"), n_blocks)
    short = n_blocks * size - n  # by so much the last block is shorter
    width = lambda i: F.least(size, n - i * size)
    before = lambda i: turn(i) * size - F.when(turn(i) > turn(n_blocks - 1), short).otherwise(0)
    part = lambda i: F.greatest(F.lit(0).cast("long"), F.least(width(i), r - before(i)))  # noqa: E731  words taken of block i, its first ones
    low = lambda i: F.greatest(a, i * size)
    high = lambda i: F.least(b, i * size + part(i))
    some = lambda i: high(i) > low(i)
    first, last = F.floor(a / size).cast("long"), F.floor((b - 1) / size).cast("long")
    goes_on = lambda i: (i < last) & (part(i) == size) & some(i) & some(i + 1)  # noqa: E731  block i's words are followed by those of the next
    blocks = F.sequence(first, last)
    starts = F.transform(F.filter(blocks, lambda i: some(i) & ~((i > first) & goes_on(i - 1))), lambda i: low(i) - a)
    ends = F.transform(F.filter(blocks, lambda i: some(i) & ~goes_on(i)), lambda i: high(i) - a)
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    return F.when((r > 0) & (b > a), F.zip_with(starts, ends, lambda x, y: F.struct(x.alias("from"), y.alias("to")))).otherwise(none)


def source_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = 11, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and what it is made of: rounds (times the whole text is taken) and ranges (word ranges, from and to, that are taken once more).

    weights: for sources by code point, null last, repeated as needed. keep: columns of docs to pass on.
    """
    spark = docs.sparkSession
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(c.words(c.text_or_empty("text"))).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", c.text_or_empty("text")).alias("_key"), *[F.col(k).alias(f"_keep_{k}") for k in keep])
    sizes = c.written(sizes, "mix-sizes")
    sums = sizes.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums = sorted(((r["source"], r["n"]) for r in sums), key=lambda x: (x[0] is None, x[0] or ""))
    n_words = [n for _, n in sums]
    goal = targets(n_words, [weights[i % len(weights)] for i in range(len(sums))], share, limit)
    shards = [max(1, min(MAX_SHARDS, -(-n // SHARD_WORDS))) for n in n_words]
    of = T.StructType([T.StructField("source", T.StringType()), T.StructField("sid", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("shards", T.IntegerType())])
    sources = spark.createDataFrame([(s, i, n, goal[i], shards[i]) for i, (s, n) in enumerate(sums)], of).withColumnRenamed("source", "_source")
    # At most MAX_SOURCES rows.
    dealt = sizes.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("shard", F.pmod(F.col("_key"), F.col("shards")).cast("int"))
    cells = sorted((r["sid"], r["shard"], r["n"]) for r in dealt.groupBy("sid", "shard").agg(F.sum("size").alias("n")).collect())
    caps = [math.ceil(limit * n / BLOCK) for *_, n in cells]
    members: dict[int, list[int]] = {}
    for k, (sid, *_) in enumerate(cells):
        members.setdefault(sid, []).append(k)
    by_source = apportion(goal, round(share * sum(n_words) / BLOCK), [sum(caps[k] for k in members.get(i, ())) for i in range(len(sums))])
    quota = [0] * len(cells)
    for sid, ks in members.items():
        for k, q in zip(ks, apportion([cells[k][2] for k in ks], by_source[sid], [caps[k] for k in ks]), strict=True):
            quota[k] = q
    rng = np.random.default_rng(seed)
    rows = [(sid, shard, n, q, *steps(-(-n // BLOCK), rng)) for (sid, shard, n), q in zip(cells, quota, strict=True)]
    plan = spark.createDataFrame(rows, "sid int, shard int, _n long, _q long, _m long, _s long")
    order = Window.partitionBy("sid", "shard").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    df = dealt.join(plan, ["sid", "shard"]).withColumn("_b", F.sum("size").over(order)).withColumn("_a", F.col("_b") - F.col("size"))
    words = F.least(F.col("_q") * BLOCK, F.floor(F.col("_n") * limit))  # the last block of a full quota may be short
    some = F.nullif(F.col("_n"), F.lit(0).cast("long"))
    df = df.withColumn("rounds", F.coalesce(F.floor(words / some), F.lit(0)).cast("long")).withColumn("_r", words - F.col("rounds") * F.col("_n"))
    df = df.withColumn("ranges", _ranges())
    taken = F.col("rounds") * F.col("size") + F.aggregate("ranges", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    return df.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "rounds", "ranges", *[F.col(f"_keep_{k}").alias(k) for k in keep if k not in ("doc_id", "source")])


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def excerpt(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words from one number up to another of a text, with what stands between them; a line feed between ranges."""
    spans = [m.span() for m in WORD.finditer(text)]
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in sorted(ranges))


def mixed_documents(docs: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """The mix as documents with the given columns: each row as often as it is taken whole, and once more with the words that are taken beyond that. n_chars, if asked for, is that of the text."""
    df = source_mix(docs, keep=columns, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rounds, texts = part.column("_rounds").to_pylist(), part.column("text")
                ranges = part.column("_ranges").to_pylist()
                whole = pa.array(np.repeat(np.arange(part.num_rows), rounds), pa.int64())
                some = [i for i, r in enumerate(ranges) if r]
                cut = pa.array([excerpt(texts[i].as_py(), [(x["from"], x["to"]) for x in ranges[i]]) for i in some], pa.string())
                for index, text in ((whole, None), (pa.array(some, pa.int64()), cut)):
                    if len(index):
                        cols = {k: part.column(k).take(index) for k in columns}
                        if text is not None:
                            cols["text"] = text
                            if "n_chars" in cols:
                                cols["n_chars"] = pc.utf8_length(text).cast(cols["n_chars"].type)
                        yield pa.RecordBatch.from_pydict(cols)

    taken = df.filter("taken > 0").select(*columns, F.col("rounds").alias("_rounds"), F.col("ranges").alias("_ranges"))
    return taken.mapInArrow(run, taken.select(*columns).schema)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(c.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
