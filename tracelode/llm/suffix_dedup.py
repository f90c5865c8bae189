"""Substring dedup by suffix automata of reference shards.

A window is WINDOW consecutive words of one document. Every word goes that is covered by a window whose words also start
in a document with a smaller doc_id.

1. Candidates. A window's anchor is the least hash of the GRAM-word grams in it, so equal windows have equal anchors.
   Consecutive windows with one anchor make a segment (some 18 windows, at most RUN). Only segments whose anchor stands in two or more
   documents can hold a shared window; the rest are done.
2. Reference shards. Segments with equal words are one passage, kept with the first and last document that have it. Passages
   are dealt by anchor to shards of about SHARD words, so all passages that can share a window meet in one shard.
3. Automata. Each shard's suffix automaton of words is built over its passages; a state knows the first document among all
   places where its words end. The passages are then streamed through it for their matching statistics: the state
   reached, cut back to the last WINDOW words, tells in which document that window starts first. Runs of windows with an earlier
   document go back to all places where the passage stands, and there the words that they cover are removed.

An automaton takes some sixty times the room of the words it is built from. It is therefore not sent to every task that holds
documents; the passages that can match it, each once however often it is copied, are sent to the one task that holds it. What a task holds is thus bounded:
an anchor with more than HOT different passages is dealt window by window (by the hash of the whole window), after windows that stand in one document only have fallen out.

Defined cases: null and empty texts have no words; texts with fewer words than WINDOW lose none. Rows without doc_id
are kept whole and remove nothing from others. Rows with equal doc_ids are not compared with each other, as neither is smaller; each gets
its own row in the result. An empty table gives an empty table. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

WINDOW = 50
GRAM = 16
RUN = 256
#: Words of the passages in a shard, on average.
SHARD = 1 << 15
HOT = 1024
#: Texts are hashed together up to so many characters.
TOGETHER = 1 << 22
#: Fixed odd multipliers of the two rolling hashes and of the finaliser.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = 0xD6E8FEB86659FD93


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any run of words, from prefix sums modulo 2^64."""

    def __init__(self, h: np.ndarray, base: int) -> None:
        power = lambda b: np.cumprod(np.append(np.uint64(1), np.full(len(h), b, np.uint64)))
        self.back = power(pow(base, -1, 1 << 64))
        self.sums = np.append(np.uint64(0), np.cumsum(h * power(base)[:-1]))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


class Words:
    """The words of several texts one after the other: ``all``, those of text i from offsets[i] to offsets[i + 1], and the hash of each."""

    def __init__(self, texts: list[str]) -> None:
        split = pc.ascii_split_whitespace(pa.array([t.strip(c.BLANKS) for t in texts], pa.large_string()))
        found = split.flatten()
        real = pc.not_equal(found, "")  # an empty text gives one empty piece
        counts = np.diff(split.offsets.to_numpy())
        if not pc.all(real).as_py():
            counts = np.array([n if t.strip(c.BLANKS) else 0 for n, t in zip(counts, texts, strict=True)])
            found = found.filter(real)
        self.all, self.offsets = found, np.append(0, np.cumsum(counts)).astype(np.int64)
        coded = found.dictionary_encode()
        of = xxhash.xxh64_intdigest
        self.hashes = np.array([of(x) for x in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()] if len(found) else np.empty(0, np.uint64)

    def between(self, start: int, end: int) -> str:
        return " ".join(self.all.slice(start, end - start).to_pylist())


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def segments(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word (among all), number of windows and anchor of each segment."""
    n = len(words.hashes)
    if n < window:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    at = np.arange(n - gram + 1)
    anchor = _least(Rolling(words.hashes, BASES[0])(at, at + gram), window - gram + 1)
    text = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    start = np.flatnonzero(np.arange(len(anchor)) + window <= words.offsets[1:][text[: len(anchor)]])
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    # A text that repeats itself can keep one anchor for long: cut such runs.
    pieces = -(-count // RUN)
    own = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, left = np.repeat(first, pieces) + own * RUN, np.repeat(count, pieces) - own * RUN
    return text[start[begin]], start[begin], np.minimum(left, RUN), anchor[begin]


def _grouped(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    """Runs of a batch's texts of TOGETHER characters or one text, and the row at which each begins."""
    at, texts, size = 0, [], 0
    for i, t in enumerate(batch.column(column)):
        texts.append(t.as_py())
        size += len(texts[-1])
        if size >= TOGETHER:
            yield at, texts
            at, texts, size = i + 1, [], 0
    if texts:
        yield at, texts


_AS_LONG = lambda a: pa.array(a.view(np.int64))


def _occurrences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, t, start, n and anchor of each segment of the documents that have a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.then(batches):
            for at, texts in _grouped(b, "text"):
                words = Words(texts)
                text, start, n, anchor = segments(words, window, gram)
                rows = pa.array(text + at)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("t").take(rows), pa.array((start - words.offsets[text]).astype(np.int32)), pa.array(n.astype(np.int16)), _AS_LONG(anchor)], names=["doc_id", "t", "start", "n", "anchor"])

    return docs.filter("doc_id is not null").select("doc_id", "t", "text").mapInArrow(run, "doc_id long, t long, start int, n short, anchor long")


def _passages(docs: DataFrame, candidates: DataFrame, window: int) -> DataFrame:
    """The candidates with the hashes s1, s2 of their words; ``words``, the words themselves, where a batch has them for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.then(batches):
            for at, texts in _grouped(b, "text"):
                words, held = Words(texts), b.column("held").slice(at, len(texts))
                text, flat = np.repeat(np.arange(len(texts)), pc.list_value_length(held).to_numpy()), held.flatten()
                own, n = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
                start = words.offsets[text] + own
                end = start + n + window - 1
                s = np.stack([Rolling(words.hashes, base)(start, end) for base in BASES], axis=1)
                first = np.zeros(len(s), bool)
                first[np.unique(s, axis=0, return_index=True)[1]] = True
                said = [words.between(p, q) if f else None for p, q, f in zip(start.tolist(), end.tolist(), first.tolist(), strict=True)]
                rows = pa.array(text + at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(rows), b.column("t").take(rows), pa.array(own.astype(np.int32)), pa.array(n.astype(np.int16)), flat.field("anchor"), _AS_LONG(np.ascontiguousarray(s[:, 0])), _AS_LONG(np.ascontiguousarray(s[:, 1])), pa.array(said, pa.string())],
                    names=["doc_id", "t", "start", "n", "anchor", "s1", "s2", "words"],
                )

    held = candidates.groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("held"))  # a set: rows that repeat a document have the same segments
    joined = docs.join(held, ["doc_id", "t"]).select("doc_id", "t", "text", "held")
    return joined.mapInArrow(run, "doc_id long, t long, start int, n short, anchor long, s1 long, s2 long, words string")


class Automaton:
    """A suffix automaton of words over several passages. first: for each state the least document of all places where its words end."""

    def __init__(self, passages: Sequence[Sequence[str]], documents: Sequence[int]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [max(documents, default=0)]
        for words, doc in zip(passages, documents, strict=True):
            last = 0
            for w in words:
                last = self._extended(last, w)
                if doc < self.first[last]:
                    self.first[last] = doc
        for i in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[i]
            if self.first[i] < self.first[up]:
                self.first[up] = self.first[i]

    def _state(self, length: int, link: int, edges: dict[str, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        self.first.append(self.first[0])
        return len(self.link) - 1

    def _whole(self, p: int, w: str) -> int:
        """The state of p's words and w as its longest; split off from the one reached if that has longer words."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        short = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = short
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = short
            p = self.link[p]
        return short

    def _extended(self, last: int, w: str) -> int:
        if w in self.next[last]:
            return self._whole(last, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._whole(p, w)
        return new

    def stream(self, words: Sequence[str], window: int) -> Iterator[tuple[int, int | None]]:
        """For each word the length of the longest match that ends there, ``window`` at most, and for a match of that length the least document that has it."""
        state, n = 0, 0
        nexts, link, length, first = self.next, self.link, self.length, self.first
        for w in words:
            while state and w not in nexts[state]:
                state = link[state]
                n = length[state]
            state = nexts[state].get(w, 0)
            n = n + 1 if state else 0
            while n > window and length[link[state]] >= window:
                state = link[state]
            n = min(n, window)
            yield n, first[state] if n == window else None


def _first_documents(passages: DataFrame, window: int) -> DataFrame:
    """s1, s2, skip, windows and first: runs of windows of a passage that start in an earlier document than the passage's last. passages: shard, s1, s2, words, lo, hi."""

    def run(shard: pa.Table) -> pa.Table:
        words, lo, hi = [x.split(" ") for x in shard["words"].to_pylist()], shard["lo"].to_pylist(), shard["hi"].to_pylist()
        automaton, out = Automaton(words, lo), []
        for i, own in enumerate(words):
            firsts = [f for _, f in automaton.stream(own, window)][window - 1 :]
            at = 0
            for j in range(1, len(firsts) + 1):
                if j == len(firsts) or firsts[j] != firsts[at]:
                    if firsts[at] < hi[i]:
                        out.append((i, at, j - at, firsts[at]))
                    at = j
        rows = pa.array([o[0] for o in out], pa.int64())
        columns = {"s1": shard["s1"].take(rows), "s2": shard["s2"].take(rows)} | {n: pa.array([o[k] for o in out], t) for k, (n, t) in enumerate([("skip", pa.int32()), ("windows", pa.int32()), ("first", pa.int64())], 1)}
        return pa.table(columns)

    return passages.groupBy("shard").applyInArrow(run, "s1 long, s2 long, skip int, windows int, first long")


def _single_windows(passages: DataFrame, window: int) -> DataFrame:
    """A row for each window of the passages: its hashes w1, w2 and words, the passage's s1, s2, lo and hi, and skip, its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = Words(b.column("words").to_pylist())
            counts = np.diff(words.offsets) - window + 1
            text = np.repeat(np.arange(len(counts)), counts)
            skip = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            start = words.offsets[text] + skip
            rows = pa.array(text)
            hashes = [_AS_LONG(Rolling(words.hashes, base)(start, start + window)) for base in BASES]
            said = pa.array([words.between(a, a + window) for a in start.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*hashes, said, *(b.column(x).take(rows) for x in ("s1", "s2", "lo", "hi")), pa.array(skip.astype(np.int32))], names=["w1", "w2", "words", "s1", "s2", "lo", "hi", "skip"])

    return passages.select("words", "s1", "s2", "lo", "hi").mapInArrow(run, "w1 long, w2 long, words string, s1 long, s2 long, lo long, hi long, skip int")


def _sharded(passages: DataFrame, by: Column, shard: int, window: int) -> DataFrame:
    n_words = passages.agg(F.coalesce(F.sum(F.col("n") + window - 1), F.lit(0))).first()[0]
    return passages.withColumn("shard", F.pmod(by, F.lit(max(1, -(-n_words // shard)))).cast("int"))


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, t (hash of the text) and spans, an array of (start, end) in words, of the documents that lose words. docs: doc_id, t, text."""
    found = c.written(_occurrences(docs, window, gram), "segments")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    candidates = c.written(_passages(docs, found.join(shared, "anchor"), window), "candidates")
    passages = c.written(candidates.groupBy("s1", "s2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("words").alias("words"), F.first("anchor").alias("anchor"), F.first("n").alias("n")), "passages")
    many = passages.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > hot).select("anchor")
    usual = _sharded(passages.join(many, "anchor", "left_anti"), F.xxhash64("anchor"), shard, window)
    single = c.written(_single_windows(passages.join(many, "anchor", "left_semi"), window), "windows")
    least = single.groupBy("w1", "w2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("words").alias("words"), F.lit(1).alias("n")).filter("lo < hi").withColumnsRenamed({"w1": "s1", "w2": "s2"})
    of_window = _first_documents(_sharded(least, F.xxhash64("s1", "s2"), shard, window), window).select(F.col("s1").alias("w1"), F.col("s2").alias("w2"), "windows", "first")
    firsts = _first_documents(usual, window).unionByName(single.select("w1", "w2", "s1", "s2", "skip").join(of_window, ["w1", "w2"]).select("s1", "s2", "skip", "windows", "first"))
    firsts = c.written(firsts, "first-documents")
    spans = candidates.select("doc_id", "t", "start", "s1", "s2").join(firsts, ["s1", "s2"]).filter("first < doc_id")
    begin = F.col("start") + F.col("skip")
    return spans.groupBy("doc_id", "t").agg(F.collect_set(F.struct(begin.alias("a"), (begin + F.col("windows") + window - 1).alias("b"))).alias("spans"))


def without_copies(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, kept (the words that stay, with one space between), n_words, n_removed and spans (merged, in words) for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), c.text_or_empty("text").alias("text")).withColumn("t", F.xxhash64("text"))
    spans = removed_spans(docs, window, gram, shard, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.then(batches):
            kept, n_words, n_removed, merged = [], [], [], []
            for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
                words, left, out = text.as_py().encode("utf-8", "surrogatepass").split(), [], []
                end = 0
                for a, z in sorted((s["a"], s["b"]) for s in spans.as_py() or []):
                    if out and a <= end:
                        end = max(end, z)
                        out[-1]["b"] = end
                        continue
                    left += words[end:a]
                    out.append({"a": a, "b": z})
                    end = z
                left += words[end:]
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                merged.append(out)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(merged, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["doc_id", "kept", "n_words", "n_removed", "spans"])

    return docs.join(spans, ["doc_id", "t"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long, spans array<struct<a:int,b:int>>")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_copies(c.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT r, doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
f AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h),
x AS (SELECT DISTINCT r, i + k AS p FROM g JOIN f USING (h), range(0, 50) t(k) WHERE lo < doc_id),
k AS (SELECT d.r, list(w ORDER BY p) AS kept FROM (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM d) d ANTI JOIN x USING (r, p) GROUP BY d.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(len(kept), 0))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""
