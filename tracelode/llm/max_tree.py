"""Ranked lexical search by a hierarchical max tree over document ranges for each term.

The index is a table with one row for each range of at most RANGE documents that stood in one partition: their ids and lengths,
the sorted terms, and each term's postings (place in the range, occurrences). Every row and every term of the
documents is in it; a search reads it twice, once for how many documents hold the terms asked for, once to rank.

For ranking, each term asked for gets a tree over its range: the leaves hold the greatest contribution within LEAF
documents, and each node above the greatest of its FAN children. Contributions are never negative, so the sum of
an item's terms over a node bounds the score of every document below it. A best-first search takes the node of the
highest bound from a heap, scores the documents of a leaf exactly in integers, and stops once the next bound is
below the k-th score met so far; nodes whose bound equals it are opened too, since a smaller doc_id may stand there.
The k-th score is carried from range to range within a task; the k best of each task are ranked together at the end.

What is sent to the tasks is the items of one block: at most ITEMS items and about ITEM_CHARS characters, however
many items there are; further blocks are searched after it.

Defined cases: null and empty texts have no term and count nowhere. Rows without doc_id are ranked too, after all
others of their score. Repeated rows are documents each, as repeated items are items each. Items without terms, and
terms that no document holds, find nothing. Empty tables give an empty table. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as c

RANGE = 1024
#: A range is closed once its texts have so many bytes.
RANGE_BYTES = 1 << 23
LEAF = 16
FAN = 4
ITEMS = 1024
ITEM_CHARS = 1 << 22
#: Letters and digits of ASCII and all that lies beyond it make up terms; the rest parts them. A to Z become small.
_FOLD = bytes((b if chr(b).isalnum() or b > 127 else 32) if not 65 <= b <= 90 else b + 32 for b in range(256))
INDEX = "doc_ids array<long>, lengths binary, terms array<string>, starts binary, places binary, counts binary"


def folded(text: str | None) -> str:
    """A text's terms with one or more spaces between them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).strip().decode("utf-8", "surrogatepass")


def index(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text), one row for each range."""
    kinds = [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]

    def packed(ids: list, texts: list[str]) -> pa.RecordBatch:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        found, lengths = split.flatten(), np.diff(split.offsets.to_numpy())
        doc = np.repeat(np.arange(len(texts)), lengths)
        real = pc.not_equal(found, "").to_numpy(zero_copy_only=False)  # an empty text gives one empty piece
        coded = found.dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        order = pc.sort_indices(words).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys, counts = np.unique(rank[at[real]] * len(texts) + doc[real], return_counts=True)
        term, place = np.divmod(keys, len(texts))
        held, first = np.unique(term, return_index=True)
        row = [ids, np.bincount(doc[real], minlength=len(texts)).astype("<i8").tobytes(), words.take(pa.array(order[held])).cast(pa.string()), np.append(first, len(term)).astype("<i4").tobytes(), place.astype("<u2").tobytes(), counts.astype("<u4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x] if not isinstance(x, pa.Array) else [x.to_pylist()], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in c.then(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                texts.append(folded(t.as_py()))
                size += len(texts[-1])
                if len(ids) == RANGE or size >= RANGE_BYTES:
                    yield packed(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield packed(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), c.text_or_empty("text").alias("text")).mapInArrow(run, INDEX)


def _postings(row: dict, asked: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers (among those asked for) of the terms that a range holds, the start and end of their postings, and the range's lengths."""
    where = pc.index_in(asked, value_set=pa.array(row["terms"], pa.string())).to_numpy(zero_copy_only=False).astype(float)
    held = np.flatnonzero(~np.isnan(where))
    starts = np.frombuffer(row["starts"], "<i4").astype(np.int64)
    at = where[held].astype(np.int64)
    return held, starts[at], starts[at + 1], np.frombuffer(row["lengths"], "<i8")


class RangeTree:
    """Contributions of the terms of one range, and above them the greatest by leaf and by node, level for level."""

    def __init__(self, begin: np.ndarray, end: np.ndarray, places: np.ndarray, counts: np.ndarray, m: np.ndarray) -> None:
        size = end - begin
        term = np.repeat(np.arange(len(size)), size)
        own = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        place, tf = places[own].astype(np.int64), counts[own].astype(np.int64)
        leaves = FAN ** max(0, math.ceil(math.log(max(1, -(-len(m) // LEAF)), FAN)))
        self.exact = np.zeros((len(size), leaves * LEAF), np.int32)  # under 10^6, since tf * 10^9 is divided by 1000 * tf and more
        self.exact[term, place] = 1_000_000_000 * tf // (1000 * tf + 8 * m[place])
        levels = [self.exact.reshape(len(size), leaves, LEAF).max(axis=2)]
        while levels[0].shape[1] > 1:
            levels.insert(0, levels[0].reshape(len(size), -1, FAN).max(axis=2))
        #: All nodes, the root first; the children of node i are FAN * i + 1 to FAN * i + FAN, and leaves come last.
        self.nodes = np.concatenate(levels, axis=1)
        self.first_leaf = self.nodes.shape[1] - leaves

    def best(self, rows: np.ndarray, weight: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores above 0 of at least all that are among the k best and not below ``floor``; and how many leaves were opened."""
        bound = weight @ self.nodes[rows].astype(np.int64)
        heap, places, scores, opened = [(-int(bound[0]), 0)], [], [], 0
        while heap and -heap[0][0] >= max(1, floor):
            i = heapq.heappop(heap)[1]
            if i < self.first_leaf:
                for j in range(FAN * i + 1, FAN * i + FAN + 1):
                    if bound[j] >= max(1, floor):
                        heapq.heappush(heap, (-int(bound[j]), j))
                continue
            at = (i - self.first_leaf) * LEAF
            got = weight @ self.exact[rows, at : at + LEAF].astype(np.int64)
            hit = np.flatnonzero(got >= max(1, floor))
            opened += 1
            if len(hit):
                places.append(at + hit)
                scores.append(got[hit])
                all_scores = np.concatenate(scores)
                if len(all_scores) >= k:
                    floor = max(floor, int(np.partition(all_scores, len(all_scores) - k)[len(all_scores) - k]))
        if not scores:
            return np.empty(0, np.int64), np.empty(0, np.int64), opened
        return np.concatenate(places), np.concatenate(scores), opened


def _cut(ids: np.ndarray, absent: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best = np.lexsort((ids, absent, -scores))[:k]
    return ids[best], absent[best], scores[best]


def _search_block(held: DataFrame, items: list[str], numbers: list[int], k: int) -> DataFrame:
    """item (its number), doc_id and score of the k best of each task."""
    counted = [Counter(folded(t).split()) for t in items]
    terms = sorted({t for x in counted for t in x})
    place = {t: i for i, t in enumerate(terms)}
    of_item = [(np.array([place[t] for t in x], np.int64), np.array(list(x.values()), np.int64)) for x in counted]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, df, n, total = pa.array(terms, pa.string()), np.zeros(len(terms), np.int64), 0, 0
        for row in c.rows_of(batches):
            at, begin, end, lengths = _postings(row, asked)
            df[at] += end - begin
            n += int((lengths > 0).sum())
            total += int(lengths.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, at]), pa.array(np.r_[n, total, df[at]].astype(np.int64))], names=["term", "n"])

    sums = {r["term"]: r["n"] for r in held.select("lengths", "terms", "starts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, all_terms = sums.get(-1, 0), sums.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sums.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
    spark, schema = held.sparkSession, "item long, doc_id long, score long"
    if not all_terms or not terms:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((terms, weights, of_item))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, of_item = shared.value
        asked = pa.array(terms, pa.string())
        none = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
        best = [none] * len(of_item)
        for row in c.rows_of(c.then(batches)):
            at, begin, end, lengths = _postings(row, asked)
            m = 25 + 75 * lengths * n_docs // all_terms
            tree = RangeTree(begin, end, np.frombuffer(row["places"], "<u2"), np.frombuffer(row["counts"], "<u4"), m)
            ids, absent = np.array([x or 0 for x in row["doc_ids"]], np.int64), np.array([x is None for x in row["doc_ids"]], bool)
            line = np.full(len(terms), -1, np.int64)
            line[at] = np.arange(len(at))
            for i, (own, repeats) in enumerate(of_item):
                rows = line[own]
                here = rows >= 0
                if not here.any():
                    continue
                known = best[i]
                floor = int(known[2][-1]) if len(known[2]) == k else 0
                p, s, _ = tree.best(rows[here], (weights[own] * repeats)[here], k, floor)
                if len(p):
                    best[i] = _cut(*(np.concatenate(x) for x in zip(known, (ids[p], absent[p], s), strict=True)), k)
        got = [(numbers[i], *x) for i, x in enumerate(best)]
        flat = lambda j, kind: np.concatenate([x[j] for x in got]) if got else np.empty(0, kind)
        item = np.repeat(np.array([x[0] for x in got], np.int64), [len(x[1]) for x in got])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(flat(1, np.int64), mask=flat(2, bool)), pa.array(flat(3, np.int64))], names=["item", "doc_id", "score"])

    return held.mapInArrow(run, schema)


def search(held: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item (item_id, text), from an index."""
    spark = items.sparkSession
    numbered = c.written(items.select("item_id", c.text_or_empty("text").alias("text")).withColumn("item", F.monotonically_increasing_id()), "search-items")
    size = numbered.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-size["chars"] // ITEM_CHARS))
    found = []
    for i in range(blocks):
        own = numbered.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).select("item", "text").collect()
        if own:
            found.append(_search_block(held, [r["text"] for r in own], [r["item"] for r in own], k))
    out = spark.createDataFrame([], "item long, doc_id long, score long")
    for f in found:
        out = out.unionAll(f)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_max_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = c.written(index(c.table(spark, sf_dir, "documents")), "search-index")
    return search(held, c.table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS t FROM benchmark),
c AS MATERIALIZED (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
q AS MATERIALIZED (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
p AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM c) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p GROUP BY term),
s AS (SELECT item, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * c.n) // c.l))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL),
k AS (SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""
