"""Feature vectors, kernels and scores over datapoints (dp_id, x)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values as v
from ..sources.relations import KEY
from . import graph

#: The columns of each group that enter a vector, in order.
GROUPS = {
    "control_flow": ["has_loop", "target_in_a_loop", "has_cond_br_after_target"],
    "before": ["invoked", "share_return", "share_argument", "checked"],
    "after": ["invoked", "share_return", "share_argument", "checked"],
    "ret": ["stored", "derefed", "returned", "indir_returned"],
    "ret_check": ["checked", "slice_checked", "br_eq_zero", "br_neq_zero", "compared_with_zero", "compared_with_non_const"],
    "arg_pre": ["checked", "compared_with_zero", "arg_check_is_zero", "arg_check_not_zero", "is_arg", "is_constant"],
    "arg_post": ["used_in_call", "used_in_check", "derefed", "returned", "indir_returned", "used"],
}


def numbered(points: DataFrame) -> DataFrame:
    """dp_id: a datapoint's place by file, slice and trace, by prefix sums over files."""
    w = Window.partitionBy("bc").orderBy("target", "slice_id", "trace_id")
    before = points.groupBy("bc").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("bc")) - F.col("_n")).drop("_n")
    return points.join(before, "bc").withColumn("dp_id", (F.row_number().over(w) - 1 + F.col("_before")).cast("long")).drop("_before")


def encode(features: DataFrame, groups: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """key and x (array of int): the columns of the groups in order, true 1, false 0, unknown -1; features: columns named group__column."""
    cols = [v.encode_bool(F.col(f"{g}__{x}")) for g in groups for x in GROUPS[g]]
    return features.select(*key, F.array(*cols).alias("x"))


def encode_structs(rows: DataFrame, names: Sequence[str], sizes: dict[str, int]) -> tuple[DataFrame, list[str]]:
    """key and x, the flags of the structs in columns ``names`` one after the other (true 1, false 0, unknown -1), and what each place means.

    An array of structs gives sizes[name] of them, those that aren't there unknown.
    """
    parts, said = [], []
    for n in names:
        kind = rows.schema[n].dataType
        several = hasattr(kind, "elementType")
        for j in range(sizes.get(n, 0) if several else 1):
            one = F.get(n, F.lit(j)) if several else F.col(n)
            for f in (kind.elementType if several else kind).names:
                parts.append(v.encode_bool(one[f]))
                said.append(f"{n}.{j}.{f}" if several else f"{n}.{f}")
    x = F.array(*parts) if parts else F.array().cast("array<int>")
    return rows.select(*KEY, x.alias("x")), said


def meanings(groups: Sequence[str]) -> list[str]:
    """What each place of a vector means."""
    return [f"{g}.{x}" for g in groups for x in GROUPS[g]]


def prefixed(df: DataFrame, group: str, key: Sequence[str] = KEY) -> DataFrame:
    return df.select(*key, *[F.col(x).alias(f"{group}__{x}") for x in df.columns if x not in key])


def masked(vectors: DataFrame, mask: Sequence[bool]) -> DataFrame:
    return vectors.withColumn("x", F.array(*[F.get("x", F.lit(i)) for i, m in enumerate(mask) if m]))


def kernel_matrix(a: DataFrame, b: DataFrame, param: float = 2.0, linear: bool = False) -> DataFrame:
    """i, j, k: the kernel of every row of a (dp_id, x) with every row of b, in blocks; its rows are as many as a's times b's, so a is a set chosen for the purpose (labelled points, representatives)."""

    def meet(right: pd.DataFrame, y: np.ndarray, left: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        k = x @ y.T if linear else np.exp(-distances2(x, y) / param)
        return pd.DataFrame({"i": np.repeat(left["dp_id"].to_numpy(), len(y)), "j": np.tile(right["dp_id"].to_numpy(), len(x)), "k": k.ravel()})

    return in_blocks(b.select("dp_id", "x"), a.select("dp_id", "x"), meet, "i long, j long, k double")


#: Points of one chunk, and of one block that it meets.
BLOCK = 2048
#: Chunks and blocks of one task, rows that it merges at once, and pairs that reach Python together.
CHUNKS, MERGED, TOGETHER = 16, 1 << 18, 8


def _packed(rows: DataFrame, n: int) -> DataFrame:
    """chunk, packed: the rows, dealt by hash of dp_id to n chunks, each of them an Arrow stream in one value, in which vectors take 4 bytes a place if that loses nothing. Written, so vectors go to disk once."""

    def pack(t: pa.Table) -> pa.Table:
        x = t["x"].combine_chunks()
        offsets, flat = x.offsets.to_numpy(), x.flatten().to_numpy(zero_copy_only=False)
        short = flat.astype(np.float32)
        held = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(short if np.array_equal(short, flat, equal_nan=True) else flat))
        held = t.drop_columns(["chunk", "x"]).combine_chunks().append_column("x", held)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, held.schema) as stream:
            stream.write_table(held)
        return pa.table({"chunk": pa.array([t["chunk"][0].as_py()], pa.int32()), "packed": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    dealt = rows.withColumn("x", F.col("x").cast("array<double>")).withColumn("chunk", F.pmod(F.xxhash64("dp_id"), F.lit(n)).cast("int"))
    return graph.written(dealt.groupBy("chunk").applyInArrow(pack, "chunk int, packed binary"), "chunks")


def _unpacked(packed: bytes) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows but for their vectors, and these as a matrix."""
    t = pa.ipc.open_stream(packed).read_all().combine_chunks()
    x = t["x"].combine_chunks()
    lengths = np.unique(np.diff(x.offsets.to_numpy()))
    if len(lengths) > 1:
        raise ValueError(f"vectors have different lengths: {lengths[:5].tolist()}")
    return t.drop_columns(["x"]).to_pandas(), x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)


def in_blocks(
    points: DataFrame, others: DataFrame, meet: Callable[[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, size: int = BLOCK, half: bool = False, merged: Callable[[pd.DataFrame], pd.DataFrame] | None = None
) -> DataFrame:
    """What ``meet`` makes of each chunk of points with each block of others, written; both are dealt by hash, about ``size`` rows to each.

    Points and others have dp_id and x, arrays of one length. Null vectors take no part. With ``half``, where both are the same rows, a chunk meets itself and of two chunks one meets the other;
    the chunk's rows have columns chunk and block, and rows of one dp_id are in one chunk.

    A chunk is one value, and a task reads CHUNKS of either side and streams the pairs, so vectors are written once and never copied for each block. What is made of the pairs of a task is
    put together by ``merged``, if there is one, so rows of a point are as many as tasks that it is in.
    """
    spark, chunks = points.sparkSession, lambda df: max(1, -(-df.count() // size))
    same, points, others = half or points is others, points.filter("x is not null"), others.filter("x is not null")
    n = chunks(points)
    m, left = n if same else chunks(others), _packed(points, n)
    right = (left if same else _packed(others, m)).toDF("block", "o_packed")
    # Enough tasks for all cores, and no more chunks in one than CHUNKS.
    cores = spark.sparkContext.defaultParallelism
    m_parts = min(m, max(-(-m // CHUNKS), math.isqrt(4 * cores - 1) + 1 if n > 1 else m))
    n_parts = min(n, max(-(-n // CHUNKS), -(-4 * cores // m_parts)))
    left, right = left.repartition(n_parts), right.repartition(m_parts).hint("shuffle_replicate_nl")
    pairs = left.join(right, F.col("chunk") <= F.col("block")) if half else left.crossJoin(right)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, a, x, found = None, None, None, []
        for batch in batches:
            for chunk, packed, block, o_packed in batch[["chunk", "packed", "block", "o_packed"]].itertuples(index=False):
                if chunk != at:
                    at, (a, x) = chunk, _unpacked(packed)
                found.append(meet(a.assign(chunk=chunk, block=block), x, *_unpacked(o_packed))[names])
                if merged is None:
                    yield found.pop()
                elif sum(map(len, found)) > MERGED:
                    found = [merged(pd.concat(found))[names]]
                    if len(found[0]) > MERGED // 2:
                        yield found.pop()
        if found:
            yield merged(pd.concat(found))[names]

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TOGETHER))
    try:
        return graph.written(pairs.mapInPandas(run, schema), "met")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def _sums(found: pd.DataFrame) -> pd.DataFrame:
    """Sums by dp_id."""
    return found.groupby("dp_id", as_index=False, dropna=False).sum()


#: Squared distances below this share of the squared lengths are taken from differences, as a product form would cancel.
CLOSE = 1e-3
#: Pairs whose differences are held at once.
PAIRS = 1 << 16


def exact_distances2(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the rows i of x from the rows j of y, from their differences, some pairs at a time."""
    out = np.empty(len(i))
    for k in range(0, len(i), PAIRS):
        d = x[i[k : k + PAIRS]] - y[j[k : k + PAIRS]]
        out[k : k + PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


def rough_distances2(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distances of all rows of x from all rows of y by one product of matrices, and the squared lengths of either side, all measured from y's mean; a distance may be off by about 1e-13 of the lengths."""
    middle = y.mean(axis=0)
    x, y = x - middle, y - middle
    a, b = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    out = x @ y.T
    out *= -2
    out += a[:, None]
    out += b
    return out, a, b


def _places(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true, in order; much faster than nonzero where that is little."""
    return np.divmod(np.flatnonzero(found), found.shape[1])


def _itself(chunk: pd.DataFrame) -> bool:
    """Whether a chunk meets itself (in_blocks with half)."""
    return chunk["chunk"].iloc[0] == chunk["block"].iloc[0]


def distances2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all rows of y; those of close rows, and all that aren't finite, are taken from differences."""
    out, a, b = rough_distances2(x, y)
    for k in range(0, len(x), 256):
        part = out[k : k + 256]
        i, j = _places(~(part > CLOSE * (a[k : k + 256, None] + b)))
        part[i, j] = exact_distances2(x, y, i + k, j)
    return out


def kde_sums(points: DataFrame, labeled: DataFrame, bandwidth: float = 1.0) -> DataFrame:
    """dp_id, pos and neg: sums of kernels over the labelled points (dp_id, x, is_alarm) of either kind, which the points meet in blocks. A point without vector has null sums."""
    scale = 1 / (bandwidth * math.sqrt(2 * math.pi))

    def meet(a: pd.DataFrame, x: np.ndarray, b: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        near, alarm = np.exp(-distances2(x, y) / (2 * bandwidth**2)) * scale, b["is_alarm"].to_numpy(bool)
        return pd.DataFrame({"dp_id": a["dp_id"], "p": near[:, alarm].sum(axis=1), "q": near[:, ~alarm].sum(axis=1)})

    found = in_blocks(points.select("dp_id", "x"), labeled.select("dp_id", "x", "is_alarm"), meet, "dp_id long, p double, q double", merged=_sums).groupBy("dp_id").agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    return points.select("dp_id").join(found, "dp_id", "left")


def kde_scores(points: DataFrame, labeled: DataFrame, bandwidth: float = 1.0) -> DataFrame:
    """dp_id, positive and negative (mean kernels over the labelled points of either kind) and score, their difference; labeled: dp_id, x, is_alarm."""
    n = labeled.filter("x is not null").agg(F.count_if("is_alarm").alias("p"), F.count_if(~F.col("is_alarm")).alias("q")).first()
    none = lambda c, k: F.coalesce(F.col(c) / k if k else F.lit(0.0), F.lit(0.0))
    out = kde_sums(points, labeled, bandwidth).select("dp_id", none("pos", n["p"]).alias("positive"), none("neg", n["q"]).alias("negative"))
    return out.withColumn("score", F.col("positive") - F.col("negative"))


def log_density(points: DataFrame, labeled: DataFrame, bandwidth: float = 1.0) -> DataFrame:
    """dp_id, score: log-density of the positives less that of the negatives."""
    tiny = F.lit(1e-300)
    return kde_scores(points, labeled, bandwidth).select("dp_id", (F.log(F.greatest("positive", tiny)) - F.log(F.greatest("negative", tiny))).alias("score"))


def ranked_alarms(scores: DataFrame, limit: int | None = None, ascending: bool = False) -> DataFrame:
    """Datapoints by score, ties to the lower dp_id."""
    out = scores.orderBy(F.col("score").asc() if ascending else F.col("score").desc(), "dp_id")
    return out if limit is None else out.limit(limit)


def with_ranks(scores: DataFrame, order: Sequence[str], parts: int = 64) -> DataFrame:
    """rank, from 1, in order: rows are dealt by ranges of the first column of the order, ranked there, and moved up by the rows of the ranges before, so no task orders all of them."""
    cuts = sorted(set(scores.approxQuantile(order[0], [i / parts for i in range(1, parts)], 0.01)))
    part = sum((F.when(F.col(order[0]) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = graph.written(scores.withColumn("_part", part), "ranges")
    before = rows.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_here", here).join(before, "_part").withColumn("rank", (F.col("_here") + F.col("_before")).cast("long")).drop("_part", "_here", "_before")


def mean_distance(points: DataFrame) -> DataFrame:
    """The mean distance of all pairs i < j."""

    def meet(a: pd.DataFrame, x: np.ndarray, b: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        d = distances2(x, y)
        np.sqrt(d, out=d)
        if not _itself(a):
            return pd.DataFrame({"s": [d.sum()], "n": [d.size]})
        pair = a["dp_id"].to_numpy()[:, None] < b["dp_id"].to_numpy()
        return pd.DataFrame({"s": [d[pair].sum()], "n": [int(pair.sum())]})

    p = points.select("dp_id", "x")
    return in_blocks(p, p, meet, "s double, n long", half=True).agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_distance"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_pairs"))


def nearest(points: DataFrame, among: DataFrame) -> DataFrame:
    """For each point the nearest other one of ``among``, ties to the lower dp_id."""

    def meet(a: pd.DataFrame, x: np.ndarray, b: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        order = np.argsort(b["dp_id"].to_numpy(), kind="stable")
        ids, y = b["dp_id"].to_numpy()[order], y[order]
        middle = y.mean(axis=0)
        turned, lengths = -2 * (y - middle).T, np.einsum("ij,ij->i", y - middle, y - middle)
        out = []
        for k in range(0, len(x), 256):
            mine, own = x[k : k + 256], a["dp_id"].to_numpy()[k : k + 256]
            # A row's squared distances by one product of matrices, less the row's own squared length, which orders nothing.
            p = np.einsum("ij,ij->i", mine - middle, mine - middle)
            d = (mine - middle) @ turned
            d += lengths
            first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
            for i in np.flatnonzero(first < last):
                d[i, first[i] : last[i]] = np.inf
            # All that could be nearest, given how far the product form may be off, are measured again; of equal ones the first counts.
            i, j = _places(~(d > (d.min(axis=1) + 1e-11 * (p + lengths.max()))[:, None]))
            other = own[i] != ids[j]
            i, j = i[other], j[other]
            near = exact_distances2(mine, y, i, j)
            best = np.lexsort((j, near, i))
            best = best[np.unique(i[best], return_index=True)[1]]
            out.append(pd.DataFrame({"dp_id": own[i[best]], "other": ids[j[best]], "d": near[best]}))
        out = pd.concat(out)
        return out[np.isfinite(out["d"])]

    def merged(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["d", "other"]).drop_duplicates("dp_id")

    p = points.select("dp_id", "x")
    found = in_blocks(p, p if among is points else among.select("dp_id", "x"), meet, "dp_id long, other long, d double", merged=merged)
    return found.groupBy("dp_id").agg(F.min_by("other", F.struct("d", "other")).alias("other"), F.sqrt(F.min("d")).alias("distance"))


def entropy(clusters: DataFrame, cluster: str = "cluster") -> DataFrame:
    """-sum p ln p over the shares of clusters."""
    c = clusters.groupBy(cluster).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return c.join(F.broadcast(total)).agg((-F.sum(p * F.log(p))).alias("entropy"))


def neighbour_clusters(points: DataFrame, cut: float | None = None) -> DataFrame:
    """dp_id, cluster: components of the graph that joins each point with its nearest other one, if that is no further than ``cut``; a cluster is named by its least dp_id. Points without vector are left out."""
    # The pairs are measured once; the components read what is written.
    near = graph.written(nearest(points, points), "nearest")
    links = (near if cut is None else near.filter(F.col("distance") <= cut)).select(F.col("dp_id").alias("a"), F.col("other").alias("b"))
    alone = points.filter("x is not null").select("dp_id").distinct()
    found = graph.merged_clusters(links).withColumnRenamed("node", "dp_id")
    return alone.join(found, "dp_id", "left").select("dp_id", F.coalesce("cluster", "dp_id").alias("cluster"))


def neighbour_cluster_entropy(points: DataFrame, cut: float | None = None) -> DataFrame:
    """entropy of the shares of the neighbour clusters, n_clusters and n_points; the entropy of no points is null."""
    sizes = graph.written(neighbour_clusters(points, cut).groupBy("cluster").agg(F.count("*").alias("n")), "clusters")
    total = sizes.agg(F.sum("n")).first()[0]
    p = F.col("n") / F.lit(total)
    return sizes.agg((-F.sum(p * F.log(p))).alias("entropy"), F.count("*").alias("n_clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_points"))


def pool(points: DataFrame, labeled: DataFrame) -> DataFrame:
    """Points not labelled yet."""
    return points.join(labeled.select("dp_id"), "dp_id", "left_anti")


def mark_first(points: DataFrame, part: str, slice_id: int, trace_id: int | None = None) -> Column:
    """Whether a datapoint is the known bug: its file contains the part, its slice and, if given, trace are the ones."""
    hit = F.col("bc").contains(part) & (F.col("slice_id") == slice_id)
    return hit if trace_id is None else hit & (F.col("trace_id") == trace_id)


def _log_density(d2: np.ndarray, bandwidth: float, dim: int) -> np.ndarray:
    """Logarithm of the kernel with the normaliser of all dimensions; far kernels would round to zero."""
    return -d2 / (2 * bandwidth**2) - dim * math.log(bandwidth * math.sqrt(2 * math.pi))


def _labeled_constants(labeled: DataFrame, bandwidth: float) -> DataFrame:
    """Each labelled point (dp_id, x, is_alarm) with s, the sum of its kernels to the positives other than itself."""

    def meet(a: pd.DataFrame, x: np.ndarray, b: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        k = np.exp(_log_density(distances2(x, y), bandwidth, x.shape[1]))
        k[a["dp_id"].to_numpy()[:, None] == b["dp_id"].to_numpy()] = 0
        return pd.DataFrame({"dp_id": a["dp_id"], "s": k.sum(axis=1)})

    own = labeled.select("dp_id", "x", "is_alarm")
    sums = in_blocks(own.select("dp_id", "x"), own.filter("is_alarm").select("dp_id", "x"), meet, "dp_id long, s double", merged=_sums).groupBy("dp_id").agg(F.sum("s").alias("s"))
    return own.filter("x is not null").join(sums, "dp_id", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))


def leave_one_out_scores(points: DataFrame, labeled: DataFrame, p_pos: float = 0.5, bandwidth: float = 1.0) -> DataFrame:
    """dp_id, score: how well a point fits among the positives, each left out once, and how badly the negatives do then.

    All sums over pairs of labelled points are constants of the labelled set, so a point needs only its two sums
    of kernels. Points without vector get no row.
    """

    def meet(a: pd.DataFrame, x: np.ndarray, b: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        k, alarm = np.exp(_log_density(distances2(x, y), bandwidth, x.shape[1])), b["is_alarm"].to_numpy(bool)
        return pd.DataFrame({"dp_id": a["dp_id"], "p": k[:, alarm].sum(axis=1), "q": k[:, ~alarm].sum(axis=1)})

    side = lambda flag, x: F.coalesce(F.sum(F.when(flag, x)), F.lit(0.0))
    total = _labeled_constants(labeled, bandwidth).agg(F.count_if("is_alarm").alias("n"), F.count_if(~F.col("is_alarm")).alias("m"), side(F.col("is_alarm"), F.col("s")).alias("pp"), side(~F.col("is_alarm"), F.col("s")).alias("np")).first()
    n, m, pp, to_negatives = (total[c] for c in ("n", "m", "pp", "np"))
    found = in_blocks(points.select("dp_id", "x"), labeled.select("dp_id", "x", "is_alarm"), meet, "dp_id long, p double, q double", merged=_sums).groupBy("dp_id").agg(F.sum("p").alias("a"), F.sum("q").alias("b"))
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    pos = (((pp + 2 * a) / (n * (n + 1))) if n else F.lit(0.0)) - (((to_negatives + b) / (m * (n + 1))) if m else F.lit(0.0))
    neg = -((to_negatives + a) / (n * (m + 1))) if n else F.lit(0.0)
    return points.filter("x is not null").select("dp_id").join(found, "dp_id", "left").select("dp_id", (p_pos * pos + (1 - p_pos) * neg).alias("score"))


def leave_in_scores(points: DataFrame, labeled: DataFrame, p_pos: float = 0.5, bandwidth: float = 1.0) -> DataFrame:
    """dp_id, score from mean log densities around the point and of the positives with it among them; 0 without negatives. Points without vector get no row."""

    def meet(a: pd.DataFrame, x: np.ndarray, b: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        log_k, alarm, own = _log_density(distances2(x, y), bandwidth, x.shape[1]), b["is_alarm"].to_numpy(bool), math.exp(_log_density(np.zeros(1), bandwidth, x.shape[1])[0])
        with_u = np.log(b["s"].to_numpy()[alarm] + own + np.exp(log_k[:, alarm])).sum(axis=1)
        return pd.DataFrame({"dp_id": a["dp_id"], "lp": log_k[:, alarm].sum(axis=1), "ln": log_k[:, ~alarm].sum(axis=1), "w": with_u, "own": math.log(own) if own else -math.inf})

    lab = _labeled_constants(labeled, bandwidth)
    total = lab.agg(F.count_if("is_alarm").alias("n"), F.count_if(~F.col("is_alarm")).alias("m")).first()
    n, m = total["n"], total["m"]
    held = points.filter("x is not null").select("dp_id", "x")
    if not m:
        return held.select("dp_id", F.lit(0.0).alias("score"))
    sums = in_blocks(held, lab, meet, "dp_id long, lp double, ln double, w double, own double", merged=lambda found: found.groupby("dp_id", as_index=False, dropna=False).agg({"lp": "sum", "ln": "sum", "w": "sum", "own": "max"})).groupBy("dp_id").agg(*[F.sum(c).alias(c) for c in ("lp", "ln", "w")], F.max("own").alias("own"))
    with_u = F.col("w") / n - math.log(n + 1) if n else F.lit(0.0)
    t = (F.col("ln") + F.col("own")) / (m + 1) - with_u
    o = F.col("ln") / m - (F.col("lp") + F.col("own")) / (n + 1)
    return sums.select("dp_id", (p_pos * t + (1 - p_pos) * o).alias("score"))


def bandwidths(points: DataFrame, grid: Sequence[float], folds: int = 5) -> DataFrame:
    """bandwidth, fitness: the log-likelihood of each fold of the points under the others, over all pairs in blocks. Points whose mean kernel is under 1e-300 count as that."""

    def meet(a: pd.DataFrame, x: np.ndarray, b: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        # Kernels are as good one way as the other, so a block's rows get their sums too, by column; sums go by fold, and a row adds up those of the other folds.
        one_hot = lambda d: (d["dp_id"].to_numpy()[:, None] % folds == np.arange(folds)).astype(float)
        fa, fb = one_hot(a), one_hot(b)
        across, down = np.zeros((len(grid), len(x), folds)), np.zeros((len(grid), len(y), folds))
        for k in range(0, len(x), 256):
            d2 = distances2(x[k : k + 256], y)
            near = np.empty_like(d2)
            for g, h in enumerate(grid):
                np.multiply(d2, -1 / (2 * h * h), out=near)
                np.exp(near, out=near)
                across[g, k : k + 256] = near @ fb
                if not _itself(a):
                    down[g] += near.T @ fa[k : k + 256]

        def sums(d: pd.DataFrame, own: np.ndarray, found: np.ndarray, others: np.ndarray) -> list[pd.DataFrame]:
            n = ((1 - own) @ others.sum(axis=0)).astype(int)
            return [pd.DataFrame({"dp_id": d["dp_id"], "bandwidth": float(h), "k": (found[g] * (1 - own)).sum(axis=1), "n": n, "dim": x.shape[1]}) for g, h in enumerate(grid)]

        return pd.concat(sums(a, fa, across, fb) + ([] if _itself(a) else sums(b, fb, down, fa)))

    def merged(found: pd.DataFrame) -> pd.DataFrame:
        return found.groupby(["bandwidth", "dp_id"], as_index=False, dropna=False).agg({"k": "sum", "n": "sum", "dim": "max"})

    p = points.select("dp_id", "x")
    near = in_blocks(p, p, meet, "dp_id long, bandwidth double, k double, n long, dim int", half=True, merged=merged).groupBy("bandwidth", "dp_id").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.max("dim").alias("dim")).filter("n > 0")
    ll = F.log(F.greatest(F.col("k") / F.col("n"), F.lit(1e-300))) - F.col("dim") * F.log(F.col("bandwidth") * F.sqrt(2 * F.pi()))
    return near.groupBy("bandwidth").agg(F.sum(ll).alias("fitness"))
