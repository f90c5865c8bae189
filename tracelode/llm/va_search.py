"""Exact top-k inner products by vector-approximation files.

Rows are dealt by hash into chunks, queries into blocks; a task meets one chunk with one block. A chunk's
approximation holds each component's cell, one of 2^BITS of equal width between the component's least and
greatest value in the chunk. The scan of the cells gives each row a bound on its score from below and above.
Rows whose upper bound is under the k-th lower bound fall out; of the rest the exact vectors are read in the order of
their upper bounds until the k-th best exact score is beyond the next bound. Cells are integers and their
middles half integers, so double arithmetic gives the bounds exactly. The k best of each chunk are then
ranked together.

Defined cases: rows whose vec_id is null, or whose vector is null, empty or holds null or non-finite components,
take no part. Vectors of different lengths are not compared. A query's own row is every row of its vec_id.
Ties go to the smaller vec_id. Repeated rows are candidates each, and one query. An empty table gives an empty table. A vector of LARGEST squared length or more raises ValueError. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as c

BITS = 5
CHUNK = 4096
QUERIES = 8192
#: Queries scored together within a task.
TOGETHER = 256
#: Squares of an integer vector's components sum to less, so that no score, bound or partial sum leaves what doubles hold exactly.
LARGEST = float(1 << 51)
#: Exact vectors read at a time.
STEP = 64


def integer_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, dim and v: floor(scale * x) of the components as little-endian 64-bit integers, of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, packed = [], []
            for x in b.column(1):
                v = np.floor(x.values.to_numpy() * float(scale))
                if not float(v @ v) < LARGEST:
                    raise ValueError(f"a vector's scores may not fit: the squares of its integer components sum to {float(v @ v):.3g}")
                v = v.astype("<i8")
                dims.append(len(v))
                packed.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "dim", "v"])

    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size(x) > 0) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).mapInArrow(run, "vec_id long, dim int, v binary")


class Approximation:
    """The cells of a chunk of integer vectors."""

    def __init__(self, vectors: np.ndarray, bits: int = BITS) -> None:
        self.low = vectors.min(axis=0)
        self.width = (vectors.max(axis=0) - self.low) // (1 << bits) + 1
        self.cells = ((vectors - self.low) // self.width).astype(np.uint8 if bits <= 8 else np.uint16)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and row the score of the cell's middle, and for each query how far the score can lie from it."""
        middle = self.low + self.cells.astype(np.float64) * self.width + (self.width - 1) / 2
        q = queries.astype(np.float64)
        return q @ middle.T, np.abs(q) @ ((self.width - 1) / 2)


def search_chunk(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, vec_ids and scores of the k best rows of a chunk for each query."""
    cells, out = Approximation(vectors), []
    for at in range(0, len(queries), TOGETHER):
        middle, slack = cells.bounds(queries[at : at + TOGETHER])
        for i in range(len(middle)):
            q, own, mid = queries[at + i], query_ids[at + i], middle[i]
            mid[ids == own] = -np.inf
            m = min(k, int((mid > -np.inf).sum()))
            if not m:
                continue
            floor = np.partition(mid, len(mid) - m)[len(mid) - m] - slack[i]
            near = np.flatnonzero(mid + slack[i] >= floor)
            near = near[np.argsort(-mid[near], kind="stable")]
            upper, score, done = mid[near] + slack[i], np.empty(0, np.int64), 0
            while done < len(near):
                score = np.concatenate([score, vectors[near[done : done + STEP]] @ q])
                done += STEP
                if len(score) >= m and done < len(near) and np.partition(score, len(score) - m)[len(score) - m] > upper[done]:
                    break
            found = near[: len(score)]
            best = np.lexsort((ids[found], -score))[:m]
            out.append((np.full(m, at + i), ids[found[best]], score[best]))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row for which is_query holds."""
    vectors = c.written(integer_vectors(rows, scale), "integer-vectors")
    queries = vectors.filter(is_query)
    n_chunks, n_blocks = max(1, -(-vectors.count() // CHUNK)), max(1, -(-queries.count() // QUERIES))
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("chunk", deal(n_chunks, 1)).withColumn("block", every(n_blocks))
    right = queries.distinct().withColumn("row", F.xxhash64("v")).withColumn("block", deal(n_blocks, 2)).withColumn("chunk", every(n_chunks))

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        matrix = lambda d: np.frombuffer(b"".join(d["v"]), "<i8").reshape(len(d), -1)
        none = pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(rows) or not len(asked):
            return none
        own = asked["vec_id"].to_numpy()
        at, ids, score = search_chunk(rows["vec_id"].to_numpy(), matrix(rows), own, matrix(asked), k)
        return pd.DataFrame({"query_id": own[at], "query_row": asked["row"].to_numpy()[at], "vec_id": ids, "score": score})

    keys = ["dim", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_va_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(c.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
