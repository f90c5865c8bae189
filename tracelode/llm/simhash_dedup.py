"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Two fingerprints that differ in at most ``max_bits`` = 4 bits differ in
at most 4 bytes, so they share at least 4 positional bytes: the guaranteed minimum. Joining the plain posting
lists (position, byte) would emit a pair for each shared byte, a number that grows with the square of the
input however few links there are. So posting lists are intersected first: ``COVER`` is a set of position triples
such that any 4 of the 8 positions contain one of them, and a pair with 4 shared bytes meets in the posting
list of at least one triple. There the shared bytes of a pair are tallied, pairs below the minimum fall out, and
the rest are verified bit by bit. No pair that links is lost.

Equal fingerprints are one node. Within a posting list only the edges of a spanning forest leave the task: a
vertex absorbs all that link to it, and what is absorbed is compared no more. The number of edges is thus at
most the number of postings, however dense a group is. Components come from alternating large-star and
small-star rounds, each written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and link like any other. component_id is the smallest
doc_id of the component; null doc_ids count only where there is no other. Repeated rows each
get a row. An empty table gives an empty table. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

SEED = 42
MIN_SHARED = 4
#: More than this many shingles are turned into bits at once.
CHUNK = 1 << 18


def shingles(text: str, width: int = 4) -> list[bytes]:
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= width:
        return [b" ".join(w)] if w else []
    joined, lengths = b" ".join(w), np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(w) - width + 1].tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: str, width: int = 4) -> int:
    """The SimHash of a text's shingles, unsigned; 0 for a text without words."""
    of = xxhash.xxh64_intdigest
    found = [of(s, SEED) for s in shingles(text, width)]
    if not found:
        return 0
    h, counts = np.array(found, np.uint64), np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        counts += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns to keep, doc_id being one, and fp (the fingerprint's 64 bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.then(batches):
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column("_marked")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(fps)], names=[*keep, "fp"])

    kept = [F.col(k).cast("long").alias(k) if k == "doc_id" else F.col(k) for k in keep]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("fp", T.LongType())])
    return docs.select(*kept, c.text_or_empty("text").alias("_marked")).mapInArrow(run, schema)


def cover(of: int = 8) -> list[tuple[int, ...]]:
    """Triples of positions such that any four positions contain one.

    Positions fall into three parts in turn; a triple is taken if it lies in one part, or if two of it lie in
    one part and the third in the next. Of any four positions two or more share a part, and three of them
    always have one of these forms. For 8 positions these are 20 triples, the least possible.
    """
    kinds = {(0, 0, 0), (1, 1, 1), (2, 2, 2), (0, 0, 1), (1, 1, 2), (0, 2, 2)}
    return [t for t in combinations(range(of), 3) if tuple(sorted(i % 3 for i in t)) in kinds]


COVER = cover()


def postings(nodes: DataFrame) -> DataFrame:
    """A row (key, fp) for each node and triple of positions; the key holds the triple and its bytes."""
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255).cast("long"))
    keys = [F.lit(k << 24).cast("long") + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(d) for k, (a, b, d) in enumerate(COVER)]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def _links(x: np.uint64, others: np.ndarray, max_bits: int) -> np.ndarray:
    """Where ``others`` link to ``x``: tally shared positional bytes, keep those at the minimum, verify the bits."""
    diff = others ^ x
    out = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= MIN_SHARED
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count(diff[at]) <= max_bits
    return out


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    edges, left = [], fps
    while len(left) > 1:
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            for x in queue.pop():
                hit = _links(x, left, max_bits)
                if hit.any():
                    got = left[hit]
                    edges.append((np.full(len(got), x), got))
                    queue.append(got)
                    left = left[~hit]
                if not len(left):
                    break
    return edges


def edges(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links (a, b) between nodes; every pair that links is connected through the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

        def done(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(k)) + 1
            start, end = np.r_[0, cut], np.r_[cut, len(k)]
            size = end - start
            two = start[size == 2]
            diff = f[two] ^ f[two + 1]
            two = two[(diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= MIN_SHARED]
            two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= max_bits]
            found = [(f[two], f[two + 1])]
            for i in np.flatnonzero(size > 2):
                found += forest(f[start[i] : end[i]], max_bits)
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys) and keys[0] != keys[-1]:  # the last run may go on in the next batch
                at = int(np.searchsorted(keys, keys[-1]))
                yield done(keys[:at], fps[:at])
                keys, fps = keys[at:], fps[at:]
        if len(keys):
            yield done(keys, fps)

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings(nodes).select("key", "fp").repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node and root, the least node of its component, for all nodes that have a link (links: a < b)."""
    now = None
    found, path = c.written_at(links, "links")
    for _ in range(max_rounds):
        both = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # Small star: each node and its lesser neighbours are linked to the least of these.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("b")).filter("m < b").select(F.col("m").alias("a"), "b").distinct()
        after, after_path = c.written_at(small, "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == now:
            break
        c.remove(links.sparkSession, path)
        found, now, path = after, state, after_path
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return found.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).unionAll(found.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _by_fingerprint(fps: DataFrame, max_bits: int) -> DataFrame:
    """fp and component_id of each distinct fingerprint."""
    nodes = c.written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    roots = components(edges(nodes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.min_by("fp", F.struct(F.col("first_doc").isNull(), "first_doc", "fp")).alias("best_fp"))
    least = c.written(least, "roots")  # so that the join has an exchange on either side, and a large component can be split
    return c.written(rooted.join(least, "root").select("fp", "component_id", "best_fp"), "components")


def simhash_components(docs: DataFrame, max_bits: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fp (long) and component_id for each row of docs."""
    fps = c.written(fingerprints(docs, width), "fingerprints")
    return fps.join(_by_fingerprint(fps, max_bits).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, max_bits: int = 4, width: int = 4, keep: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """One row of docs for each component, that of the smallest doc_id, with the columns to keep."""
    fps = c.written(fingerprints(docs, width, keep), "fingerprints")
    best = _by_fingerprint(fps.select("doc_id", "fp"), max_bits).filter("fp = best_fp").select("fp", F.col("component_id").alias("_best"))
    chosen = fps.join(best, (fps["fp"] == best["fp"]) & fps["doc_id"].eqNullSafe(best["_best"]), "left_semi")
    return chosen.dropDuplicates(["doc_id", "fp"]).select(*keep)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(c.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
