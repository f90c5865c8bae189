"""Centroid clustering (k-means by integers) with ball-tree filtering.

Each task packs the vectors that it holds into metric trees of at most TREE rows. A node is a run of rows and stores
its middle, its radius, the number of its rows, their integer sum and the sum of their squares; a leaf has LEAF rows at
most. A round walks every tree from its root with the centroids still in question: by the triangle inequality, a
centroid whose distance from the middle is more than twice the radius beyond the nearest one's can be nearest for
no row of the ball. A ball with one centroid left goes to it as a whole, by its count and sums; a leaf with more
is opened, and its rows are compared in integers. Bounds are in doubles with a margin for rounding; whatever lies
within the margin is opened, so ties always end at exact integers, where the smaller number wins.

Each round returns k rows from every task, summed by cluster in Spark as decimals: nothing but the k centroids
(k * dim integers) passes through the driver.

Defined cases: vectors that are null, hold null or non-finite components, or have another number of components than
``dim`` take no part. Rows with equal vec_ids are vectors each. Seeds are the k rows with the smallest hash of their
vec_id, those of equal hashes in the order of their components, rows without vec_id last; fewer rows than k give as
many centroids. An empty table gives an empty table. Components of ``largest(dim, tree)`` or more in size (2^22 with
the defaults, so 65536 before scaling) raise an error, since the sums of a tree might leave 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

TREE = 4096
LEAF = 16
#: Relative rounding of distances in doubles, with room to spare.
MARGIN = 1e-9


def largest(dim: int, tree: int) -> int:
    """Integer components are smaller than this in size: the squares of a whole tree, and squared distances, then stay within 64 bits."""
    return math.isqrt((1 << 62) // (max(16, tree) * dim))


@dataclass
class Tree:
    """The nodes of one tree: rows [start, end) of ``vectors`` each, the children of node i at left[i] and left[i] + 1 (0: a leaf)."""

    vectors: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    middle: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    squares: np.ndarray


def build(vectors: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """A tree over integer vectors, and the order in which it holds them."""
    order, spans, left = np.arange(len(vectors)), [(0, len(vectors))], [0]
    x, i = vectors.astype(float), 0
    while i < len(spans):
        a, b = spans[i]
        own = order[a:b]
        if b - a > leaf:
            # Two far rows give the direction of the cut, and the median of the projections halves the ball.
            one = x[own[np.argmax(((x[own] - x[own[0]]) ** 2).sum(axis=1))]]
            two = x[own[np.argmax(((x[own] - one) ** 2).sum(axis=1))]]
            along = x[own] @ (two - one)
            if along.max() > along.min():
                half = (b - a) // 2
                order[a:b] = own[np.argpartition(along, half)]
                left[i] = len(spans)
                spans += [(a, a + half), (a + half, b)]
                left += [0, 0]
        i += 1
    held, (start, end) = vectors[order], np.array(spans).T
    running = np.zeros((len(held) + 1, held.shape[1]), np.int64)
    np.cumsum(held, axis=0, out=running[1:])
    total, squares = running[end] - running[start], np.concatenate([[0], np.cumsum((held * held).sum(axis=1))])
    middle = total / (end - start)[:, None]
    radius = np.array([np.sqrt(((held[a:b] - m) ** 2).sum(axis=1).max()) for a, b, m in zip(start, end, middle, strict=True)])
    return Tree(held, start, end, np.array(left), middle, radius, total, squares[end] - squares[start]), order


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centroid of each row, the smaller one of equals, and the squared distance; exact."""
    d = np.stack([((vectors - m) ** 2).sum(axis=1) for m in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(d)), best]


def descend(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(node, cluster, candidates): balls that belong to one centroid as a whole, and leaves (cluster None) that must be opened for the candidates."""
    m = centroids.astype(float)
    stack = [(0, np.arange(len(m)))]
    while stack:
        i, live = stack.pop()
        d = np.sqrt(((m[live] - tree.middle[i]) ** 2).sum(axis=1))
        reach = (d.min() + 2 * tree.radius[i]) * (1 + MARGIN) + MARGIN
        live = live[d <= reach]
        if len(live) == 1:
            yield i, int(live[0]), live
        elif tree.left[i]:
            stack += [(tree.left[i], live), (tree.left[i] + 1, live)]
        else:
            yield i, None, live


def gathered(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], int]:
    """Rows, integer sums and summed squared distances of each cluster in a tree, and how many rows were compared one by one."""
    k = len(centroids)
    n, sums, inertia, opened = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64), [0] * k, 0
    for i, cluster, live in descend(tree, centroids):
        a, b = tree.start[i], tree.end[i]
        if cluster is not None:
            n[cluster] += b - a
            sums[cluster] += tree.total[i]
            m = centroids[cluster]
            # Python integers: the parts of this sum can be larger than the sum.
            inertia[cluster] += int(tree.squares[i]) - 2 * sum(int(p) * int(q) for p, q in zip(m, tree.total[i], strict=True)) + int(b - a) * sum(int(p) ** 2 for p in m)
            continue
        rows = tree.vectors[a:b]
        best, d = nearest(rows, centroids[live])
        opened += b - a
        for j in np.unique(best):
            own, at = best == j, live[j]
            n[at] += own.sum()
            sums[at] += rows[own].sum(axis=0)
            inertia[at] += sum(map(int, d[own]))
    return n, sums, inertia, int(opened)


def _pack(tree: Tree, ids: list) -> dict:
    flat = lambda a: np.ascontiguousarray(a).tobytes()
    return {"ids": ids, "vectors": flat(tree.vectors.astype("<i8")), "spans": flat(np.stack([tree.start, tree.end, tree.left], axis=1).astype("<i8")), "middle": flat(tree.middle), "radius": flat(tree.radius), "total": flat(tree.total.astype("<i8")), "squares": flat(tree.squares.astype("<i8"))}


def _unpack(row: dict, dim: int) -> Tree:
    of = lambda name, kind: np.frombuffer(row[name], kind)
    spans = of("spans", "<i8").reshape(-1, 3)
    return Tree(of("vectors", "<i8").reshape(-1, dim), spans[:, 0], spans[:, 1], spans[:, 2], of("middle", float).reshape(-1, dim), of("radius", float), of("total", "<i8").reshape(-1, dim), of("squares", "<i8"))


def kept_vectors(rows: DataFrame, dim: int, scale: int = 64, tree: int = TREE) -> DataFrame:
    """vec_id and v, the integer components (array of long), of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(e * float(scale)))
    most = largest(dim, tree) // scale
    beyond = F.exists(x, lambda e: F.abs(e) >= float(most))
    too_large = F.raise_error(F.lit(f"a component is too large: its size must be under {most}"))
    return rows.filter((F.size(x) == dim) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.when(beyond, too_large.cast("array<bigint>")).otherwise(v).alias("v"))


def trees(vectors: DataFrame, dim: int, size: int = TREE) -> DataFrame:
    """One row for each tree; every task packs the rows that it holds, a tree at a time."""
    names = {"ids": pa.list_(pa.int64()), "vectors": pa.binary(), "spans": pa.binary(), "middle": pa.binary(), "radius": pa.binary(), "total": pa.binary(), "squares": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []

        def packed() -> pa.RecordBatch:
            tree, order = build(np.concatenate(parts))
            row = _pack(tree, [ids[i] for i in order])
            return pa.RecordBatch.from_pydict({n: pa.array([row[n]], t) for n, t in names.items()})

        for b in batches:
            v = b.column(1).flatten().to_numpy().reshape(-1, dim)
            at = 0
            while at < len(v):
                n = min(len(v) - at, size - len(ids))
                ids += b.column(0).slice(at, n).to_pylist()
                parts.append(v[at : at + n])
                at += n
                if len(ids) == size:
                    yield packed()
                    ids, parts = [], []
        if ids:
            yield packed()

    return vectors.mapInArrow(run, "ids array<long>, " + ", ".join(f"{n} binary" for n in list(names)[1:]))


def seeds(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The components of the k rows with the smallest sha256 of ``seed:vec_id``; at most k rows reach the driver."""
    first = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [list(r["v"]) for r in first.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def one_round(forest: DataFrame, centroids: list[list[int]]) -> list[tuple[int, list[int], int]]:
    """(rows, sums, summed squared distances) of each cluster: k rows from each task, added up in Spark."""
    k, dim, m = len(centroids), len(centroids[0]), np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, inertia = [0] * k, [[0] * dim for _ in range(k)], [0] * k
        for row in c.rows_of(batches):
            got = gathered(_unpack(row, dim), m)
            for j in range(k):
                n[j] += int(got[0][j])
                sums[j] = [p + int(q) for p, q in zip(sums[j], got[1][j], strict=True)]
                inertia[j] += got[2][j]
        out = [(j, i, x) for j in range(k) if n[j] for i, x in enumerate([n[j], inertia[j], *sums[j]])]
        yield pa.RecordBatch.from_pydict({"cluster": pa.array([o[0] for o in out], pa.int32()), "i": pa.array([o[1] for o in out], pa.int32()), "x": pa.array([Decimal(o[2]) for o in out], pa.decimal128(38, 0))})

    found = {(r["cluster"], r["i"]): int(r["x"]) for r in forest.mapInArrow(run, "cluster int, i int, x decimal(38,0)").groupBy("cluster", "i").agg(F.sum("x").cast("decimal(38,0)").alias("x")).collect()}
    return [(found.get((j, 0), 0), [found.get((j, 2 + i), 0) for i in range(dim)], found.get((j, 1), 0)) for j in range(k)]


def assigned(forest: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and distance of every row: whole balls at once, leaves by comparison."""
    dim, m = len(centroids[0]), np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in c.rows_of(batches):
            tree = _unpack(row, dim)
            cluster, distance = np.empty(len(tree.vectors), np.int32), np.empty(len(tree.vectors), np.int64)
            for i, whole, live in descend(tree, m):
                own = slice(tree.start[i], tree.end[i])
                best, distance[own] = nearest(tree.vectors[own], m[live])
                cluster[own] = live[best] if whole is None else whole
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(row["ids"], pa.int64()), "cluster": pa.array(cluster), "distance": pa.array(distance)})

    return forest.mapInArrow(run, "vec_id long, cluster int, distance long")


def ball_tree_clusters(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, tree: int = TREE) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part, and the final centroids."""
    vectors = kept_vectors(rows, dim, scale, tree)
    forest = c.written(trees(vectors, dim, tree), "ball-trees")
    centroids = seeds(vectors, k, seed)
    if not centroids:
        empty = rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        return empty, []
    for _ in range(rounds):
        centroids = [[s // n for s in sums] if n else old for (n, sums, _), old in zip(one_round(forest, centroids), centroids, strict=True)]
    inertia = [x for _, _, x in one_round(forest, centroids)]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centroids]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1)
    out = assigned(forest, centroids).withColumns({"cluster_inertia": of(inertia, "long"), "inertia": F.lit(sum(inertia)).cast("long"), "centroid_sha256": of(digest, "string")})
    return out, centroids


def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree_clusters(c.table(spark, sf_dir, "embeddings"))[0]


def _round_sql(i: int) -> str:
    """Assignment against c{i} and the centroids c{i+1} after it."""
    return f"""
a{i} AS (SELECT r, arg_min(c, (d, c)) AS c FROM (SELECT v.r, c{i}.c, list_sum(list_transform(range(1, 65), lambda j: (v.v[j] - c{i}.m[j]) * (v.v[j] - c{i}.m[j])))::BIGINT AS d FROM v, c{i}) GROUP BY r),
s{i} AS (SELECT c, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, 65) t(j) GROUP BY c, j),
c{i + 1} AS (SELECT c, coalesce(n.m, c{i}.m) AS m FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM s{i} GROUP BY c) n USING (c)),"""


ORACLE = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INTEGER AS c, v AS m FROM v QUALIFY c < 16),
{"".join(_round_sql(i).replace(" AS (", " AS MATERIALIZED (") for i in range(3))}
d AS (SELECT v.r, v.vec_id, c3.c, list_sum(list_transform(range(1, 65), lambda j: (v.v[j] - c3.m[j]) * (v.v[j] - c3.m[j])))::BIGINT AS d FROM v, c3),
b AS (SELECT r, any_value(vec_id) AS vec_id, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM d GROUP BY r)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.m, ',')) AS centroid_sha256
FROM b JOIN c3 ON c3.c = b.cluster"""
