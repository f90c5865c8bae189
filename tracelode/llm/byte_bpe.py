"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary. A whole pre-token that is in the vocabulary is found by
one hash, one displacement and one comparison. Second tier, for misses: the pre-token's bytes are linked spans,
and a heap of (rank, place) merges the pair of lowest rank, leftmost first, until none is in the vocabulary.

Ranks are read on the driver from a file in the usual rank format (base64 bytes, a space, the rank) and sent
with the task; their size is that of the vocabulary.

Defined cases: null or empty text has no ids. Repeated rows each get a row. An empty table gives an empty table.
Columns besides doc_id and text are ignored. A byte that the vocabulary lacks raises KeyError.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: A task remembers the ids of so many pre-tokens, and as many older ones.
MEMORY = 100_000
#: Ids in one batch handed back to Spark, unless a single document has more.
BATCH_IDS = 1_000_000


class PerfectHash:
    """A minimal perfect hash: n keys in n slots, by hash and displace.

    A key's 64-bit hash h gives a bucket; its slot is the high half of h (2 d + 1), modulo n, d being the bucket's
    displacement. Buckets are placed from the largest down; those with one key take a free slot directly,
    written as a negative displacement.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = max(1, len(keys))
        self.m = n // 3 + 1
        self.displace = [0] * self.m
        self.keys: list[bytes | None] = [None] * n
        h = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: dict[int, list[int]] = {}
        for k, x in enumerate(h):
            members.setdefault(x % self.m, []).append(k)
        taken, singles = bytearray(n), []
        for b, ks in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(ks) == 1:
                singles.append((b, ks[0]))
                continue
            for d in range(1 << 20):
                slots = [(h[k] * (2 * d + 1) & 0xFFFFFFFFFFFFFFFF) >> 32 for k in ks]
                slots = [s % n for s in slots]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
            else:
                raise ValueError("no displacement found; keys must be distinct")
            self.displace[b] = d
            for k, s in zip(ks, slots, strict=True):
                taken[s], self.keys[s] = 1, keys[k]
        free = iter([s for s in range(n) if not taken[s]])
        for b, k in singles:
            s = next(free)
            self.displace[b], self.keys[s] = -1 - s, keys[k]

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1 for what is not a key."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.m]
        at = -1 - d if d < 0 else ((h * (2 * d + 1) & 0xFFFFFFFFFFFFFFFF) >> 32) % self.n
        return at if self.keys[at] == key else -1


class _Known(dict):
    """Ids of pre-tokens, each looked up when it is first met."""

    def __init__(self, learn) -> None:
        self.learn, self.older = learn, {}

    def __missing__(self, part: str) -> bytes:
        out = self.older.get(part)
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        if out is None:
            out = self.learn(part)
        self[part] = out
        return out


class BytePairs:
    """Encoding and decoding by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, hashed: PerfectHash | None = None) -> None:
        import regex

        self.ranks, self.hash = ranks, hashed or PerfectHash(list(ranks))
        self.slot_ids = [ranks.get(k, -1) for k in self.hash.keys]
        self.split = regex.compile(pattern).findall
        self.known = _Known(self._learn)
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.tokens[i] = b

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token by repeated merging of the pair of lowest rank."""
        n, rank = len(word), self.ranks.get
        end, prev = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, e = heappop(heap)
            j = end[i]
            if not 0 < j < n or end[j] != e:  # one of the two has been merged since
                continue
            end[i], end[j] = e, 0
            if e < n:
                prev[e] = i
                if (r := rank(word[i : end[e]])) is not None:
                    heappush(heap, (r, i, end[e]))
            if (p := prev[i]) >= 0 and (r := rank(word[p:e])) is not None:
                heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out

    def _learn(self, part: str) -> bytes:
        word = part.encode()
        slot = self.hash.slot(word)
        return array("I", [self.slot_ids[slot]] if slot >= 0 else self.merge(word)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit integers of this machine's order."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def forget(self) -> None:
        self.known = _Known(self._learn)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> BytePairs:
    return BytePairs(read_ranks(path), pattern)


def _lists(raw: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *[len(x) // 4 for x in raw]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def _send(spark: SparkSession, path: str, pattern: str):
    own = coder(path, pattern)
    return spark.sparkContext.broadcast((own.ranks, own.hash))


def _encoded(own: BytePairs, b: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Rows of a batch and their ids, BATCH_IDS ids at a time."""
    raw, size, first = [], 0, 0
    for k, t in enumerate(b.column(1)):
        raw.append(own.encode(t.as_py()))
        size += len(raw[-1]) // 4
        if size > BATCH_IDS or k == b.num_rows - 1:
            yield b.column(0).slice(first, len(raw)), raw
            raw, size, first = [], 0, k + 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), c.text_or_empty("text").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids array<int> of each row of docs."""
    sent = _send(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _of(sent, pattern)
        for b in c.then(batches, own.forget):
            for ids, raw in _encoded(own, b):
                yield pa.RecordBatch.from_arrays([ids, _lists(raw)], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the decoded bytes of each row of ``encode``'s result."""
    sent = _send(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _of(sent, pattern)
        for b in batches:
            out = [own.decode(x.values.to_numpy().tolist()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """What ``decode`` makes of ``encode``'s result, in one pass of one worker."""
    sent = _send(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _of(sent, pattern)
        for b in c.then(batches, own.forget):
            for ids, raw in _encoded(own, b):
                decoded = [own.decode(np.frombuffer(x, "<u4").tolist()) for x in raw]
                yield pa.RecordBatch.from_arrays([ids, _lists(raw), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


_OWN: dict = {}


def _of(sent, pattern: str) -> BytePairs:
    """This worker's coder for what the driver sent, kept from task to task."""
    if _OWN.get("sent") is not sent.value or _OWN["pattern"] != pattern:
        ranks, hashed = sent.value
        _OWN.update(sent=sent.value, pattern=pattern, coder=BytePairs(ranks, pattern, hashed))
    return _OWN["coder"]


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = round_trip(c.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
