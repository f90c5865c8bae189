"""Log probabilities of texts by online logistic context mixing, beside those of a unigram model.

A text is its tokens, lower-cased A-Z, each followed by a space, and one line feed for the end. Bytes are predicted as the
bits of a fixed prefix code, short for bytes that are frequent in prose, so a byte takes about five bits. The predictors are
counts of zeros and ones in hashed contexts: the last 2 and the last 4 bytes, all of the token so far, and that
with the token before it. None of them
looks back beyond the token before, so the bits of a token depend on it and that one alone. Bytes that are equal in all contexts are computed
once in a stream, for all the pairs of tokens that have them, and what is equal in the other three once for all tokens before (``Shared``). The stretched probabilities are mixed by a
weighted sum; a gate, made of the bit's place and of how much the two token contexts have seen, picks the set of
weights. An adaptive probability map, indexed by the bits so far and the mixed probability, refines the result.
The sum of log2 over the bits of a text gives total_bits, bits_per_byte and the score; training and held-out texts are scored alike, by the finished model.

The plan:

1. ``dealt``: texts are dealt by hash to streams of about STREAM bytes, whose number and order depend on the rows alone, and turned
   into tokens once: a row for each stream with its words in order, and its texts as places among them.
2. ``counted``: each task counts the bits of its training pairs in hashed tables, which are summed by part. Sums of whole numbers come out the same in any order.
3. ``learnt``: along each stream, weights and map learn online, piece by piece. Each byte is predicted by the counts of the whole corpus less
   its own occurrence, as if it had not been seen there, so the weights fit the finished counts. Weights are means over streams, weighted by their bytes, in whole numbers.
4. ``scored``: each distinct byte of a stream's pairs is scored once, and the sums over the tokens of a text are its score.
   Training counts of tokens are summed over the corpus and brought back to the streams, for the base score: a stream's tokens travel as one row for each
   range of their hashes, and a group of such rows holds about as many tokens as eight streams have.

So scores depend on the rows and not on how they are partitioned or on the number of cores.

The tables have SLOTS_A_TOKEN slots or more in each context for every token, up to 2^max_bits, which bounds what is
broadcast (beyond it, contexts share slots and the bits a byte rise): 4 bytes for each of 4 * 2^max_bits slots while the weights are learnt, 67 MB unless the caller raises it, and half of that afterwards. A task's memory is bounded by its
tables, one stream and the longest text. A token that is frequent in the corpus is met once in each
stream, so no key is hot. Every step between shuffles is written to the shared folder.

Defined cases: null or empty text is the end alone. A null doc_id counts as not held out. Without training
tokens both models fall back to their priors. Repeated rows each count and get a row. An empty table gives an
empty table. Columns besides doc_id and text are ignored. Tokens of any length are read piece by piece.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

END = b"\n"
#: Weights of bytes in the prefix code, about per mille of prose; every other byte weighs a half. Fixed values.
FREQUENT = {" ": 150, "e": 110, "t": 75, "n": 70, "a": 65, "i": 60, "o": 60, "r": 55, "s": 50, "h": 50, "d": 35, "l": 35, "u": 28, "c": 22, "m": 20, "f": 15, "g": 15, "p": 15, "b": 12, "w": 12, "y": 12, ",": 10, ".": 10, "v": 8, "k": 6, "\n": 4, "z": 3, "j": 2, "q": 2, "x": 2, **{str(d): 2 for d in range(10)}, "\xc3": 15}
K = 4
WORD, PAIR = 2, 3  # the two token contexts
EARLY = 4  # bytes of a token whose last bytes may reach into the token before it
PAIRED = 3  # of these, those before which more of it than one byte can stand
TRIE = 16  # bytes of a token that are shared with other tokens that begin alike
GROUPS = 16  # in which the tokens before are put by their hash, if a caller wants that
#: How often a context was seen is told in so many levels, from these counts on.
LEVELS = (1, 2, 4, 12, 60)
N_LEVELS = 2 * (len(LEVELS) + 1)  # each of them with ones alone or zeros alone, or both
PLACES = 8  # bits of a byte with weights of their own; later ones share the last
GATES = N_LEVELS * N_LEVELS
MAP_STEPS = 33
PRIOR = np.float32(0.4)
LOG2_E = np.float32(math.log2(math.e))
STEPS = 128
FINE = 2048  # the same while the weights are learnt
FAR = 12.0  # stretched probabilities stay within this
LINE_BITS = 3  # a context's bits are kept in lines of 2^LINE_BITS slots, three bits of the code to a line
PIECE, LEAST, MOVES, RUN = 1 << 16, 512, 64, 64  # bytes predicted between two updates, at most and at least, how many updates a stream should have, and how many bytes that are side by side stay together
COUNTED, SHARED, SCORED = 1 << 16, 1 << 16, 1 << 16  # bytes counted, looked up and scored together
STREAM = 1 << 23
WHOLE = 1 << 24  # weights are summed in such parts
MIN_BITS, MAX_BITS = 18, 22
SLOTS_A_TOKEN = 8
PARTS = 32  # in which tables travel
ROWS = 500  # of documents in an Arrow batch
U = np.uint32
M1, M2, M3, M4 = U(0x85EBCA6B), U(0xC2B2AE35), U(0x27D4EB2F), U(0x165667B1)
POWER = np.cumprod(np.full(64, 0x9E3779B1, np.uint64).astype(U), dtype=U)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 5 == 1, F.lit(False))


def table_bits(n_tokens: int, max_bits: int = MAX_BITS) -> int:
    """A context has SLOTS_A_TOKEN slots or more for every token, up to the bound."""
    return min(max_bits, max(MIN_BITS, (max(SLOTS_A_TOKEN * n_tokens - 1, 0)).bit_length()))


def token_groups(n_tokens: int, max_bits: int = MAX_BITS) -> int:
    """With ``grouped``: in how many groups the pair's context knows the token before; 0, each by itself, as long as the tables have SLOTS_A_TOKEN slots for every token."""
    return GROUPS if SLOTS_A_TOKEN * n_tokens > 1 << max_bits else 0


# The prefix code.


class Code:
    """Huffman's code over FREQUENT: for each depth and byte the inner node and the bit; for each node its line and its slot there."""

    def __init__(self) -> None:
        heap = [(2 * FREQUENT.get(chr(b), 0.5), b) for b in range(256)]
        heapq.heapify(heap)
        kids: dict[int, tuple[int, int]] = {}
        while len(heap) > 1:
            (w0, x0), (w1, x1) = heapq.heappop(heap), heapq.heappop(heap)
            kids[256 + len(kids)] = x0, x1
            heapq.heappush(heap, (w0 + w1, 255 + len(kids)))
        top = heap[0][1]
        self.length = np.zeros(256, np.uint8)
        line, self.slot, path = np.zeros(255, np.uint64), np.zeros(255, U), {}
        todo: list[tuple[int, tuple, int, int]] = [(top, (), top, 1)]
        while todo:
            x, way, first, at = todo.pop()
            if x < 256:
                self.length[x], path[x] = len(way), way
                continue
            if len(way) % LINE_BITS == 0:
                first, at = x, 1
            line[x - 256], self.slot[x - 256] = first - 255, at
            todo += [(kid, (*way, (x - 256, bit)), first, 2 * at + bit) for bit, kid in enumerate(kids[x])]
        deep = int(self.length.max())
        self.node, self.bit = np.zeros((deep, 256), np.uint8), np.zeros((deep, 256), np.uint8)
        for x, way in path.items():
            for d, (node, bit) in enumerate(way):
                self.node[d, x], self.bit[d, x] = node, bit
        salt = (line * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(U)
        #: For each depth and byte, too: the node as an index, its line's salt and its slot.
        self.index, self.salts, self.slots = self.node.astype(np.int64), salt[self.node], self.slot[self.node]


CODE = Code()


# Pairs of tokens and their contexts.


def _rising(words: pa.Array) -> bool:
    """Whether each is greater than the one before it, by their bytes."""
    words = words.cast(pa.large_binary())
    return len(words) < 2 or pc.all(pc.less(words[:-1], words[1:])).as_py()


class Words:
    """The distinct tokens of a stream as the bytes that are predicted: number 0 is the end of a text, a token has its space. groups: in which they are told apart as the token before, by their hash; 0: each is one."""

    def __init__(self, words: pa.Array, groups: int = 0) -> None:
        spaced = pa.concat_arrays([pa.array([END], pa.large_binary()), pc.binary_join_element_wise(words.cast(pa.large_binary()), pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()))])
        self.length = pc.binary_length(spaced).to_numpy().astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(spaced.buffers()[2], np.uint8, int(self.length.sum()))
        within = np.arange(len(self.flat)) - np.repeat(self.start, self.length)
        sums = np.append(U(0), np.cumsum((self.flat.astype(U) + U(1)) * POWER[within & 63], dtype=U))
        #: Hash of a token's bytes before each of its places, and of all of it.
        self.so_far = sums[:-1] - np.repeat(sums[self.start], self.length) + within.astype(U) * M4
        self.whole = sums[self.start + self.length] - sums[self.start] + self.length.astype(U) * M4
        #: The last four bytes, the last one first; 0 beyond the beginning.
        self.tail = np.stack([np.where(self.length > k, self.flat[np.maximum(self.start + self.length - 1 - k, 0)], 0) for k in range(4)], axis=1).astype(U)
        #: The group of each token, and for each group its part of the hash of the pair's context.
        self.group = _mixed(self.whole[None].copy())[0].astype(np.int64) % groups if groups else np.arange(len(self.length))
        self.group[0] = groups  # the end of a text has one of its own
        #: Whether tokens that begin alike stand side by side, each told apart as the token before.
        self.in_order = not groups and _rising(words)
        context = (np.arange(groups + 1, dtype=U) + U(1)) * M4 if groups else self.whole
        self.context = (context * M1 ^ context >> U(13)) * M2


class Pairs:
    """Contexts of the bytes of tokens, each with the one before it; places are counted over the bytes of all the pairs."""

    def __init__(self, words: Words, before: np.ndarray, token: np.ndarray) -> None:
        self.words, self.before, self.token = words, before, token
        self.end = np.cumsum(words.length[token])

    @property
    def in_order(self) -> bool:
        """Whether they are distinct and in order of the token before, then the token."""
        keys = self.before * len(self.words.length) + self.token
        return bool((keys[1:] > keys[:-1]).all())

    def __len__(self) -> int:
        return int(self.end[-1]) if len(self.end) else 0

    def places(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of places a to z: where their bytes are in the words, how far on in their tokens, and the pairs that they belong to."""
        w = self.words
        lo, hi = np.searchsorted(self.end, [a, z - 1], side="right")
        begin = self.end[lo : hi + 1] - w.length[self.token[lo : hi + 1]]
        n = np.minimum(self.end[lo : hi + 1], z) - np.maximum(begin, a)
        within = np.arange(a, z) - np.repeat(begin, n)
        return np.repeat(w.start[self.token[lo : hi + 1]], n) + within, within, np.repeat(np.arange(lo, hi + 1), n)

    def of_pair(self, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Hashes of the pair's context alone, as one row."""
        w = self.words
        return _mixed((w.context[w.group[self.before[own]]] + w.so_far[at] * M3)[None])

    def read(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the contexts of places a to z, their bytes, and the pairs that they belong to."""
        w, (at, within, own) = self.words, self.places(a, z)
        before, last = self.before[own], U(0)
        for back in range(1, 5):
            byte = np.where(within >= back, w.flat[np.maximum(at - back, 0)], w.tail[before, np.maximum(back - 1 - within, 0)]).astype(U)
            last = last | byte << U(8 * (back - 1))
        return np.concatenate([_of_text(last, w.so_far[at]), self.of_pair(at, own)]), w.flat[at], own


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in (M1, M3):
        h ^= h >> U(15)
        h *= m
    h ^= h >> U(16)
    return h


def _of_text(last: np.ndarray, so_far: np.ndarray) -> np.ndarray:
    """Hashes of the contexts that are not the pair's: the last 2 and the last 4 bytes, and the token so far."""
    return _mixed(np.stack([(last & U(0xFFFF)) * M2, last * M4, so_far]))


def _coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each key among the different ones, and these in order. Keys and their places are sorted as one number if they fit, which is several times as fast."""
    shift = len(keys).bit_length()
    if not len(keys) or int(keys.max()) >> (63 - shift):
        found, place = np.unique(keys, return_inverse=True)
        return place, found
    both = keys << shift
    both |= np.arange(len(keys))
    both.sort()
    at, both = both & ((1 << shift) - 1), both >> shift
    new = np.append(True, both[1:] != both[:-1])
    place = np.empty(len(keys), np.int32)
    place[at] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return place, both[new]


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the lengths."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Shared:
    """The different bytes that pairs have in the three contexts of the text, each once; and their events, the bytes that are different in all four, which are such a byte and the group of the token before.

    A byte after the first four of its token has the contexts of the text from the token so far alone; an earlier one from its place and the last four bytes, which hold
    the token so far. From the TRIE-th byte on, those of each token stand by themselves. Bits of all of them are numbered in a row: a byte's first bit, and the others after it.
    Events of the first PAIRED bytes are found from the pairs; later ones from units, the pairs that differ in the token and in the group of the one before it.
    """

    def __init__(self, pairs: Pairs, times: np.ndarray | None = None, placed: bool = True) -> None:
        """placed: keep which events belong to which pairs."""
        self.pairs, w, parts, n = pairs, pairs.words, [], 0
        times = np.ones(len(pairs.token), np.int64) if times is None else times
        if w.in_order and pairs.in_order:
            self._runs(times, placed)
            return
        group, shift = w.group[pairs.before], len(w.context).bit_length()
        self.unit, units = _coded(group * len(w.length) + pairs.token)
        of_unit, often = np.divmod(units, len(w.length)), np.bincount(self.unit, times, len(units))
        used = np.bincount(pairs.token, minlength=len(w.length)) > 0
        #: For each place in a token the pairs or units that have it, their events, and of each event the number here, the group and how often it occurs; the last level holds all places from TRIE on.
        self.levels: list[tuple] = []

        def level(there: np.ndarray, place: np.ndarray, at: np.ndarray, group: np.ndarray, n: np.ndarray) -> None:
            kept = (there.astype(np.int32), place.astype(np.int32)) if placed else (None, None)
            self.levels.append((*kept, at.astype(np.int32), group.astype(np.int32), n.astype(np.float32 if n.max(initial=0) < 1 << 24 else np.float64)))

        tails, head = (w.tail << (U(8) * np.arange(4, dtype=U))).sum(1, dtype=U).astype(np.int64), np.zeros(len(w.length), np.int64)
        words, node = np.flatnonzero(used), np.zeros(len(w.length), np.int64)
        there, before, token = np.arange(len(pairs.token)), pairs.before, pairs.token
        for i in range(TRIE):
            if i == PAIRED:  # from here on a group tells the last byte of the token before
                one = np.zeros(len(w.context), np.int64)
                one[group] = before
                group, token = of_unit
                there, before, times = np.arange(len(units)), one[group], often
            words = words[w.length[words] > i]
            at = w.start[words] + i
            node[words], found = _coded(node[words] << 8 | w.flat[at])
            one = np.zeros(len(found), np.int64)
            one[node[words]] = words  # a token of those that begin alike
            if i < EARLY:
                there = there[w.length[token[there]] > i]
                tail, tails_found = _coded(tails & (1 << 8 * (4 - i)) - 1)
                place, events = _coded((tail[before[there]] * len(found) + node[token[there]]) << shift | group[there])
                texts, own = events >> shift, events & (1 << shift) - 1
                new = np.append(True, texts[1:] != texts[:-1])[: len(texts)]
                number, texts = np.cumsum(new) - 1, texts[new]
                tail, one = np.divmod(texts, max(len(found), 1))[0], one[texts % max(len(found), 1)]
                parts.append(((tails_found[tail] << 8 * i | head[one]).astype(U), w.so_far[w.start[one] + i], w.flat[w.start[one] + i]))
                level(there, place, number + n, own, np.bincount(place, times[there], len(events)))
                head[words] = head[words] << 8 | w.flat[at]
            else:
                there = there[w.length[token[there]] > i]
                place, events = _coded(node[token[there]] << shift | group[there])
                parts.append(self._late(w.start[one] + i))
                level(there, place, (events >> shift) + n, events & (1 << shift) - 1, np.bincount(place, times[there], len(events)))
            n += len(parts[-1][2])
        words = words[w.length[words] > TRIE]
        rest, self.rest = w.length[words] - TRIE, np.zeros(len(w.length), np.int64)
        self.rest[words] = np.cumsum(rest) - rest + n
        parts.append(self._late(np.repeat(w.start[words] + TRIE, rest) + _within(rest)))
        there = there[w.length[token[there]] > TRIE]
        rest = w.length[token[there]] - TRIE
        at, there = np.repeat(self.rest[token[there]], rest) + _within(rest), np.repeat(there, rest)
        level(there, np.arange(len(at)), at, group[there], times[there])
        self._numbered(parts)

    def _runs(self, times: np.ndarray, placed: bool) -> None:
        """The same where tokens before are known each by itself, and tokens and pairs are in order: events are then runs of pairs beside each other, found without a sort."""
        pairs, w, parts, n = self.pairs, self.pairs.words, [], 0
        self.levels, self.unit = [], np.arange(len(pairs.token))
        keep = lambda x: x.astype(np.int32) if placed else None
        counts = lambda x: x.astype(np.float32 if x.max(initial=0) < 1 << 24 else np.float64)
        used = np.bincount(pairs.token, minlength=len(w.length)) > 0
        words, node, head = np.flatnonzero(used), np.zeros(len(w.length), np.int32), np.zeros(len(w.length), np.int64)
        tails = (w.tail << (U(8) * np.arange(4, dtype=U))).sum(1, dtype=U).astype(np.int64)
        other = np.zeros(len(words), bool)  # whether a token begins otherwise than the one beside it
        other[:1] = True
        there, token, before = np.arange(len(pairs.token), dtype=np.int32), pairs.token.astype(np.int32), pairs.before.astype(np.int32)
        new = np.append(True, before[1:] != before[:-1])[: len(before)]
        for i in range(TRIE):
            longer = w.length[words] > i
            words, other = words[longer], other[longer]
            byte = w.flat[w.start[words] + i]
            other[1:] |= byte[1:] != byte[:-1]
            node[words] = np.cumsum(other, dtype=np.int32) - np.int32(1)
            one = words[other]  # a token of those that begin alike
            if not (longer := w.length[token] > i).all():
                there, token, new = there[longer], token[longer], new[longer]
            here = node[token]
            new[1:] |= here[1:] != here[:-1]
            events = np.flatnonzero(new)
            own, at = before[there[events]], here[events]
            if i < EARLY:
                tail, tails_found = _coded(tails & (1 << 8 * (4 - i)) - 1)
                at, texts = _coded(tail[own].astype(np.int64) * len(one) + at)
                tail, which = np.divmod(texts, max(len(one), 1))
                first = w.start[one[which]]
                parts.append(((tails_found[tail] << 8 * i | head[one[which]]).astype(U), w.so_far[first + i], w.flat[first + i]))
                head[words] = head[words] << 8 | byte
            else:
                parts.append(self._late(w.start[one] + i))
            often = np.add.reduceat(times[there], events) if len(events) else np.zeros(0, np.int64)
            self.levels.append((keep(there), keep(np.cumsum(new, dtype=np.int32) - np.int32(1)) if placed else None, (at + n).astype(np.int32), own, counts(often)))
            n += len(parts[-1][2])
        words = words[w.length[words] > TRIE]
        rest, self.rest = w.length[words] - TRIE, np.zeros(len(w.length), np.int64)
        self.rest[words] = np.cumsum(rest) - rest + n
        parts.append(self._late(np.repeat(w.start[words] + TRIE, rest) + _within(rest)))
        there = there[w.length[token] > TRIE]
        rest = w.length[pairs.token[there]] - TRIE
        at, there = np.repeat(self.rest[pairs.token[there]], rest) + _within(rest), np.repeat(there, rest)
        self.levels.append((keep(there), keep(np.arange(len(at))) if placed else None, at.astype(np.int32), before[there], counts(times[there])))
        self._numbered(parts)

    def _numbered(self, parts: list[tuple]) -> None:
        self.last, self.so_far, self.byte = (np.concatenate(x) for x in zip(*parts, strict=True))
        bits_of = CODE.length[self.byte]
        self.first = np.cumsum(bits_of, dtype=np.int32) - bits_of
        self.n_bits = int(bits_of.sum())

    def _late(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last bytes, hash of the token so far and byte of places that have four bytes before them in their token."""
        w, last = self.pairs.words, np.zeros(len(at), U)
        for back in range(1, 5):
            last |= w.flat[at - back].astype(U) << U(8 * (back - 1))
        return last, w.so_far[at], w.flat[at]

    @property
    def times(self) -> np.ndarray:
        """How often each byte occurs."""
        return sum(np.bincount(at, n, len(self.byte)) for _, _, at, _, n in self.levels).astype(np.int64)

    def first_bits(self, at: np.ndarray, within: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The number of the first bit of each place."""
        out = self.rest[self.pairs.token[own]] + within - TRIE
        for i, (there, place, number, _, _) in enumerate(self.levels[:TRIE]):
            here = np.flatnonzero(within == i)
            out[here] = number[place[np.searchsorted(there, own[here] if i < PAIRED else self.unit[own[here]])]]
        return self.first[out].astype(np.int64)

    def read(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the pair's context of events, as one row, their bytes, and the numbers of their first bits."""
        return _mixed((self.pairs.words.context[group] + self.so_far[at] * M3)[None]), self.byte[at], self.first[at].astype(np.int64)

    def each(self, n_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For bits of one depth at a time: their bytes' places here, their numbers, themselves, and their slots in the three tables."""
        for a in range(0, len(self.byte), SHARED):
            part = slice(a, a + SHARED)
            order = by_length(self.byte[part])
            first = self.first[part][order].astype(np.int64)
            h = _sorted(_of_text(self.last[part], self.so_far[part]), order)
            for d, _, bit, slots in bits(h, self.byte[part][order], n_bits):
                yield order[: len(bit)] + a, first[: len(bit)] + d, bit, slots


def by_length(b: np.ndarray) -> np.ndarray:
    """Places of the bytes, those with the longest codes first."""
    return np.argsort(CODE.length[b], kind="stable")[::-1]


def bits(h: np.ndarray, b: np.ndarray, n_bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each depth of the code: it, the bytes that long and their bits, and the slot in each context's table; bytes are in order of length."""
    at_byte, line = b.astype(np.int64), U((1 << n_bits) - (1 << LINE_BITS))
    length = CODE.length.take(at_byte, mode="clip")
    for d in range(len(CODE.node)):
        n = int(np.count_nonzero(length > d))
        if not n:
            return
        here = at_byte[:n]
        salt, slot = CODE.salts[d].take(here, mode="clip"), CODE.slots[d].take(here, mode="clip")
        slots = []
        for own in h:
            at = own[:n] + salt
            at &= line
            at += slot
            slots.append(at.astype(np.int64))
        yield d, here, CODE.bit[d].take(here, mode="clip"), slots


def stretched(seen: np.ndarray, ones: np.ndarray) -> np.ndarray:
    ones = ones + PRIOR
    zeros = seen - ones
    zeros += 2 * PRIOR
    ones /= zeros
    return np.log(ones, out=ones)


def level(seen: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """How much a context has seen, and, as another half of the levels, whether its bits were all the same."""
    out = (seen >= LEVELS[0]).view(np.uint8)
    for least in LEVELS[1:]:
        out = out + (seen >= least).view(np.uint8)
    same = ((ones == 0) | (ones == seen)).view(np.uint8)
    return out + same * np.uint8(N_LEVELS // 2)


def _probability(dot: np.ndarray) -> np.ndarray:
    p = np.negative(dot)
    np.exp(p, out=p)
    p += 1
    return np.reciprocal(p, out=p)


def _at_map(node: np.ndarray, dot: np.ndarray) -> np.ndarray:
    step = dot + np.float32(FAR * (1 + 1 / (MAP_STEPS - 1)))
    step *= np.float32((MAP_STEPS - 1) / (2 * FAR))
    at = step.astype(np.int64)
    at += node * MAP_STEPS
    return at


def _refined(maps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a mixed probability is multiplied by at each place of the map, and what is added: places that have seen enough count for a half."""
    n = maps.sum(0)
    half = np.where(n >= 20, 0.5, 0.0)
    return (1 - half).astype(np.float32), (half * (maps[1] + 0.4) / (n + 0.8)).astype(np.float32)


def _log(p: np.ndarray, bit: np.ndarray, share: np.ndarray, more: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural logarithm, the cheapest one, of the refined probabilities of the bits."""
    p = p * share.take(at, mode="clip")
    p += more.take(at, mode="clip")
    p -= 1 - bit
    np.abs(p, out=p)
    return np.log(p, out=p)


def _dot(w: np.ndarray, gate: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Weighted sums of the rows of x, added up column by column, so that a row's sum does not hang on where it stands."""
    parts = np.ascontiguousarray(w.T).take(gate, axis=0, mode="clip")
    parts *= x
    dot = parts[:, 0] + parts[:, 1]
    for k in range(2, K):
        dot += parts[:, k]
    return np.clip(dot, -FAR, FAR, out=dot)


def _sorted(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.stack([row.take(order, mode="clip") for row in h])


def _unsorted(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[order] = x
    return out


class Tables:
    """Counts of zeros and ones by context and slot, over pairs that occur so often."""

    def __init__(self, n_bits: int) -> None:
        self.n_bits = n_bits
        #: In each slot the ones, and in front of them how often it was seen.
        self.both = np.zeros((K, 1 << n_bits), "<u8")
        self.seen, self.ones = self.both.view("<u4")[:, 0::2], self.both.view("<u4")[:, 1::2]

    def count(self, pairs: Pairs, times: np.ndarray) -> None:
        def add(k: int, slots: np.ndarray, bit: np.ndarray, n: np.ndarray) -> None:
            np.add.at(self.both[k], slots, n + (n << np.uint64(32)) * bit)

        of = Shared(pairs, times, placed=False)
        total = of.times.astype("<u8")
        for at, _, bit, slots in of.each(self.n_bits):
            n = total[at]
            for k in range(PAIR):
                add(k, slots[k], bit, n)
        for _, _, at, group, n in of.levels:
            for a in range(0, len(at), COUNTED):
                h, b, _ = of.read(at[a : a + COUNTED], group[a : a + COUNTED])
                order = by_length(b)
                m = n[a : a + COUNTED][order].astype("<u8")
                for _, _, bit, slots in bits(_sorted(h, order), b[order], self.n_bits):
                    add(PAIR, slots[0], bit, m[: len(bit)])


def packed(seen: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Slots as tasks get them: how often seen in the lower 16 bits, the ones in the upper; fuller slots are scaled down by a power of two."""
    shift = np.maximum(np.frexp(seen.astype(np.float64))[1] - 16, 0)
    return ((ones >> shift).astype(U) << U(16)) | (seen >> shift).astype(U)


class Mixer:
    """Weights and map as they learn along a stream, from the counts of all of the corpus."""

    def __init__(self, tables: np.ndarray) -> None:
        self.tables, self.n_bits = tables, tables.shape[1].bit_length() - 1
        self.pair = self._pair_table()
        self.restart()

    def restart(self) -> None:
        self.weights = np.full((PLACES, K, GATES), 0.3, np.float32)
        self.maps = np.zeros((2, 256 * MAP_STEPS))

    def _pair_table(self) -> np.ndarray:
        """For each slot of the pair's context and each bit the stretched probability in 1/FINE and, in the lowest 4 bits, the level, as they are asked for more often than there are slots."""
        n = self.tables.shape[1]
        out = np.empty((n, 2), np.int32)
        for a in range(0, n, SHARED):
            part = slice(a, a + SHARED)
            for bit in (0, 1):
                x, seen, ones = self.without(self.tables[PAIR, part], np.float32(bit))
                out[part, bit] = np.rint(x * FINE).astype(np.int32) << 4 | level(seen, ones)
        return out.ravel()

    @staticmethod
    def without(pair: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of packed slots: the stretched probability without the bit's own occurrence, how often the context was seen else, and the ones of it."""
        seen = np.maximum((pair & U(0xFFFF)).astype(np.float32) - 1, 0)
        ones = np.clip((pair >> U(16)).astype(np.float32) - bit, 0, seen)
        return stretched(seen, ones), seen, ones

    def shared(self, of: Shared) -> np.ndarray:
        """For each bit the stretched probabilities of the contexts of the text in 1/FINE, and the token so far's part of the gate."""
        out = np.zeros((of.n_bits, K), np.int16)
        for _, at, bit, slots in of.each(self.n_bits):
            for k in range(PAIR):
                x, seen, ones = self.without(self.tables[k].take(slots[k], mode="clip"), bit)
                out[at, k] = np.rint(x * FINE)
            out[at, PAIR] = level(seen, ones) * np.uint8(N_LEVELS)
        return out

    def learn(self, h: np.ndarray, b: np.ndarray, times: np.ndarray, known: np.ndarray | None = None, first: np.ndarray | None = None, rate: float = 0.5, told: bool = True) -> np.ndarray | None:
        """log2 of each byte's probability, its own occurrence left out of the counts, before anything of this piece is learnt. known: from shared, with the bytes' first bits there; then h is that of the pairs alone."""
        out, order = np.zeros(len(b), np.float32), by_length(b)
        (share, more), met = _refined(self.maps), []
        times, first = times[order].astype(np.float32), None if first is None else first[order]
        for d, byte, bit, slots in bits(_sorted(h, order), b[order], self.n_bits):
            m, n = times[: len(bit)], len(bit)
            if known is None:
                found = [self.without(self.tables[k].take(slots[k], mode="clip"), bit) for k in range(PAIR)]
                rows = np.stack([np.rint(f[0] * FINE) for f in found] + [level(*found[WORD][1:]) * np.uint8(N_LEVELS)], axis=1)
            else:
                rows = known.take(first[:n] + d, axis=0, mode="clip")
            at, w = slots[-1] * 2, self.weights[min(d, PLACES - 1)]
            at += bit
            last, x = self.pair.take(at, mode="clip"), rows.astype(np.float32)
            gate = rows[:, PAIR].astype(np.int64)
            gate += last & 15
            last >>= 4
            x[:, PAIR] = last
            dot = _dot(w / np.float32(FINE), gate, x)
            at, p = _at_map(CODE.index[d].take(byte, mode="clip"), dot), _probability(dot)
            if told:
                out[:n] += _log(p, bit, share, more, at)
            at *= 2
            at += bit
            met.append(at)
            miss, size = (bit - p) * m, np.bincount(gate, m, minlength=GATES)
            for k in range(K):
                w[k] += rate / FINE * np.bincount(gate, miss * x[:, k], GATES) / (size + 4)
        if met:
            self.maps += np.bincount(np.concatenate(met), np.concatenate([times[: len(at)] for at in met]), minlength=2 * 256 * MAP_STEPS).reshape(-1, 2).T
        return _unsorted(out * LOG2_E, order) if told else None

    def follow(self, pairs: Pairs, times: np.ndarray) -> None:
        """Learn from the different bytes of the pairs, in pieces of PIECE of them, or smaller ones so that a short stream has MOVES of them; each piece has its share of every place in a token."""
        of = Shared(pairs, times, placed=False)
        at, group, n = (np.concatenate([x[k] for x in of.levels]) for k in (2, 3, 4))
        of.levels.clear()
        known = self.shared(of)
        moves, runs = max(1, -(-len(at) // min(PIECE, max(LEAST, len(at) // MOVES)))), -(-len(at) // RUN)
        for k in range(min(moves, runs)):  # a piece has the runs k, k + moves, ...
            own = (np.arange(k, runs, moves)[:, None] * RUN + np.arange(RUN)).ravel()
            own = own[: np.searchsorted(own, len(at))]
            h, b, first = of.read(at[own], group[own])
            self.learn(h, b, n[own], known, first, told=False)


def frozen(seen: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Slots as a finished model holds them: the stretched probability in 1/STEPS and, in the lowest 4 bits, the level."""
    x = np.rint(stretched(seen.astype(np.float32), ones.astype(np.float32)) * STEPS)
    return np.clip(x, -2047, 2047).astype(np.int16) << 4 | level(seen, ones).astype(np.int16)


class Model:
    def __init__(self, tables: np.ndarray, weights: np.ndarray, maps: np.ndarray) -> None:
        self.tables, self.weights = tables, weights.astype(np.float32) / STEPS
        self.n_bits = tables.shape[1].bit_length() - 1
        self.share, self.more = _refined(maps)

    def shared(self, of: Shared) -> np.ndarray:
        """For each bit what the contexts of the text give: the stretched probabilities, and the token so far's part of the gate."""
        out = np.zeros((of.n_bits, K), np.int16)
        for _, at, _, slots in of.each(self.n_bits):
            for k in range(PAIR):
                v = self.tables[k].take(slots[k], mode="clip")
                out[at, k] = v >> 4
            out[at, PAIR] = (v & 15) * np.int16(N_LEVELS)
        return out

    def log2(self, h: np.ndarray, b: np.ndarray, known: np.ndarray | None = None, first: np.ndarray | None = None) -> np.ndarray:
        """log2 of each byte's probability. known: from shared, with the bytes' first bits there; then h is that of the pairs alone."""
        out, order = np.zeros(len(b), np.float32), by_length(b)
        first = None if first is None else first[order]
        for d, byte, bit, slots in bits(_sorted(h, order), b[order], self.n_bits):
            if known is None:
                v = [self.tables[k].take(slots[k], mode="clip") for k in range(PAIR)]
                rows = np.stack([y >> 4 for y in v] + [(v[WORD] & 15) * np.int16(N_LEVELS)], axis=1)
            else:
                rows = known.take(first[: len(bit)] + d, axis=0, mode="clip")
            last, x = self.tables[PAIR].take(slots[-1], mode="clip"), rows.astype(np.float32)
            x[:, PAIR] = last >> 4
            last &= 15
            last += rows[:, PAIR]
            dot = _dot(self.weights[min(d, PLACES - 1)], last.astype(np.int64), x)
            at, p = _at_map(CODE.index[d].take(byte, mode="clip"), dot), _probability(dot)
            out[: len(bit)] += _log(p, bit, self.share, self.more, at)
        return _unsorted(out * LOG2_E, order)


def pair_log2(model: Model, pairs: Pairs) -> np.ndarray:
    """log2 of the probability of each pair's token after the one before it."""
    of = Shared(pairs)
    known, out, of_units = model.shared(of), np.zeros(len(pairs.token)), np.zeros(int(of.unit.max(initial=-1)) + 1)
    for i, (there, place, at, group, _) in enumerate(of.levels):
        each = np.zeros(len(at))
        for a in range(0, len(at), SCORED):
            h, b, first = of.read(at[a : a + SCORED], group[a : a + SCORED])
            each[a : a + SCORED] = model.log2(h, b, known, first)
        if i < PAIRED:
            out[there] += each[place]
        else:
            of_units += np.bincount(there, each[place], len(of_units))
    return out + of_units[of.unit]


# The plan around it.


def _quiet_memory() -> None:
    """Let this process keep the memory of short-lived arrays instead of giving it back each time."""
    import ctypes

    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 22)  # blocks of up to 4 MB come from the heap
        libc.mallopt(-1, 1 << 25)  # of which 32 MB may lie idle at its top
    except (OSError, AttributeError):  # another C library: only slower
        pass


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows reach Python in a batch, and Parquet is read row by row, as a batch's bytes count for memory."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.parquet.enableVectorizedReader": "false"}
    old = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


STREAMS = "stream int, doc_ids array<long>, held array<boolean>, words string, sizes binary, ids binary"


def _joined(words: pa.Array) -> pa.Array:
    """One text of the words, which hold no space."""
    words = words.cast(pa.large_string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(" ", pa.large_string())).cast(pa.string())


def _split(text: pa.Scalar) -> pa.Array:
    joined = text.cast(pa.large_string())
    return pa.array([], pa.string()) if not len(joined.as_buffer()) else pc.split_pattern(pa.array([joined], pa.large_string()), " ").flatten().cast(pa.string())


def dealt(docs: DataFrame) -> DataFrame:
    """A row for each stream: the texts' doc_ids, whether they are held out and their numbers of tokens (with the end); the distinct words, with a space between; and the tokens as places among these, from 1, or 0 for the end."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held"), c.text_or_empty("text").alias("text"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) // STREAM))
    placed = rows.withColumn("stream", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).withColumn("place", F.xxhash64(F.lit(1), "doc_id", "text"))
    names = [x.split()[0] for x in STREAMS.split(", ")]

    def stream_of(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        column = lambda name: pa.concat_arrays([p.column(name) for p in parts])
        text = pc.ascii_trim_whitespace(pc.ascii_lower(column("text").cast(pa.large_string())))
        split = pc.ascii_split_whitespace(text)
        sizes = np.where(pc.equal(text, "").to_numpy(zero_copy_only=False), 0, np.diff(split.offsets.to_numpy()))
        found = split.flatten()
        coded = found.filter(pc.not_equal(found, "")).dictionary_encode()
        order = pc.sort_indices(coded.dictionary.cast(pa.large_binary())).to_numpy()  # so that tokens that begin alike stand side by side
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(1, len(order) + 1)
        places = rank[coded.indices.to_numpy(zero_copy_only=False)]
        ids = np.insert(places, np.cumsum(sizes), U(0))
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        values = [pa.array([number], pa.int32()), whole(column("doc_id")), whole(column("held")), _joined(coded.dictionary.take(pa.array(order))), pa.array([(sizes + 1).astype("<i4").tobytes()]), pa.array([ids.astype("<u4").tobytes()])]
        return pa.RecordBatch.from_arrays(values, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, number = [], -1
        for b in c.then(batches):
            streams = b.column("stream").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(streams)) + 1).tolist(), len(streams)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                if first == last:
                    continue
                if parts and streams[first] != number:
                    yield stream_of(number, parts)
                    parts = []
                number = int(streams[first])
                parts.append(b.slice(first, last - first))
        if parts:
            yield stream_of(number, parts)

    return placed.repartition(n, "stream").sortWithinPartitions("stream", "place", "doc_id").mapInArrow(run, STREAMS)


def _streams(batches: Iterator[pa.RecordBatch], groups: int = 0) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray, np.ndarray, dict]]:
    """Number, words, ids, ids of the tokens before them, and whether a token is learnt from, stream by stream."""
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(n)[i] for n in b.schema.names}
            ids, sizes = np.frombuffer(row["ids"].as_buffer(), "<u4").astype(np.int64), np.frombuffer(row["sizes"].as_buffer(), "<i4")
            before = np.append(0, ids[:-1])  # what stands before a text's first token is an end
            held = np.repeat(row["held"].values.to_numpy(zero_copy_only=False).astype(bool), sizes)
            names = _split(row["words"])
            yield row["stream"].as_py(), Words(names, groups), ids, before, ~held, row | {"sizes": sizes, "names": names}


def _distinct(before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in the order in which they first occur, and how often each does."""
    coded = pa.array(before << 32 | ids).dictionary_encode()
    return coded.dictionary.to_numpy(), np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))


def _pairs(words: Words, keys: np.ndarray) -> Pairs:
    return Pairs(words, keys >> 32, keys & 0xFFFFFFFF)


def _sorted_pairs(words: Words, before: np.ndarray, ids: np.ndarray) -> tuple[Pairs, np.ndarray]:
    """Distinct pairs in order, and the number of each token's pair."""
    place, found = _coded(before * len(words.length) + ids)
    return Pairs(words, *np.divmod(found, len(words.length))), place


_COUNTED = "part int, values binary, stream int, of int, tokens string, at binary, n binary"
_COUNTED_SCHEMA = pa.schema([("part", pa.int32()), ("values", pa.binary()), ("stream", pa.int32()), ("of", pa.int32()), ("tokens", pa.string()), ("at", pa.binary()), ("n", pa.binary())])


def _put(x: np.ndarray) -> bytes:
    """Counts with their bytes of the same weight together, which compress well."""
    return pa.compress(np.ascontiguousarray(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _got(x: pa.Buffer, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(x, 4 * n, codec="zstd"), np.uint8).reshape(4, n).T).view("<u4").ravel()


def counted(streams: DataFrame, n_bits: int, tasks: int, ranges: int, groups: int = 0) -> DataFrame:
    """Rows of tables (part, values), and rows of each stream's tokens: those in a range of hashes (of), with a space between, their places, and how often each is in the training texts (the end of texts is the token of two line feeds, at 0)."""

    def row(**columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([columns.get(f.name)], f.type) for f in _COUNTED_SCHEMA], schema=_COUNTED_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _quiet_memory()
        tables, some = Tables(n_bits), False
        for number, words, ids, before, train, held in _streams(c.then(batches), groups):
            some = True
            pairs, place = _sorted_pairs(words, before[train], ids[train])
            tables.count(pairs, np.bincount(place))
            n = np.bincount(ids[train], minlength=len(words.length))
            names = pa.concat_arrays([pa.array(["\n\n"], pa.string()), held["names"]])
            of = ((words.whole * M1 ^ words.whole >> U(15)) * M2 >> U(8)).astype(np.int64) % ranges
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(ranges + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[k] : cuts[k + 1]]
                yield row(stream=number, of=k, tokens=_joined(names.take(pa.array(at)))[0].as_py(), at=at.astype("<u4").tobytes(), n=n[at].astype("<i8").tobytes())
        if some:
            for kind, values in enumerate((tables.seen, tables.ones)):
                for part in range(PARTS):
                    k, i = divmod(part, PARTS // K)
                    yield row(part=2 * part + kind, values=_put(np.split(values[k], PARTS // K)[i]))

    return streams.coalesce(tasks).mapInArrow(run, _COUNTED)


def _summed(rows: DataFrame, n: int | None = None) -> dict[int, np.ndarray]:
    """The sums of the parts (part, values), which are arrays of whole numbers; bounded by the size of the tables. n: of tables, whose parts have so many slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, values in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = np.frombuffer(values.as_buffer(), "<i8") if n is None else _got(values.as_buffer(), n).astype(np.int64)
                sums[part] = sums[part] + found if part in sums else found
        if n is not None:  # tables: what was seen and the ones of it, side by side
            sums = {part // 2: packed(seen, sums[part + 1]) for part, seen in sums.items() if part % 2 == 0}
        for part, found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["part", "values"])

    by = F.col("part") if n is None else F.expr("part div 2")
    # Written first, and fetched a few rows at a time, so that the driver never holds more than the arrays and a part on its way.
    sums, folder = c.written_at(rows.select("part", "values").repartition(PARTS, by).mapInArrow(run, "part int, values binary"), "lm-sums", "zstd")
    found = {r["part"]: np.frombuffer(r["values"], np.int64 if n is None else U) for r in sums.toLocalIterator()}
    c.remove(rows.sparkSession, folder)
    return found


def learnt(streams: DataFrame, tables: np.ndarray, groups: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and map: the means of the streams' weights by their bytes, and the sums of their maps."""
    sent = streams.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _quiet_memory()
        total, own = None, None
        for _, words, ids, before, train, _ in _streams(c.then(batches), groups):
            pairs, place = _sorted_pairs(words, before[train], ids[train])
            times = np.bincount(place)
            if not len(pairs):
                continue
            own = own or Mixer(sent.value)
            own.restart()
            own.follow(pairs, times)
            n = int((words.length[pairs.token] * times).sum())
            found = np.concatenate([np.rint(own.weights.ravel().astype(np.float64) * WHOLE).astype(np.int64) * n, np.rint(own.maps.ravel()).astype(np.int64), [n]])
            total = found if total is None else total + found
        if total is not None:
            for part, own in enumerate(np.array_split(total, PARTS)):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.astype("<i8").tobytes()], pa.binary())], names=["part", "values"])

    found = _summed(c.written(streams.mapInArrow(run, "part int, values binary"), "lm-weights"))
    sent.destroy()
    none = Mixer(np.zeros((K, 1 << MIN_BITS), U))
    if not found:
        return none.weights, none.maps
    every, n_maps = np.concatenate([found[k] for k in range(PARTS)]), none.maps.size
    weights = np.array([int(x) / int(every[-1]) / WHOLE for x in every[: none.weights.size]], np.float32)
    return weights.reshape(none.weights.shape), every[-n_maps - 1 : -1].reshape(none.maps.shape).astype(float)


_KNOWN = "stream int, at binary, n binary, n_train long, n_distinct long"


def known_tokens(counts: DataFrame) -> DataFrame:
    """stream, at and n of each row of counts, where n are the tokens' training occurrences in all streams; and for each range of hashes a row with the sum of these and the number of tokens that have any."""

    def run(rows: pa.Table) -> pa.Table:
        tokens, n = [_split(x) for x in rows["tokens"]], [np.frombuffer(x.as_buffer(), "<i8") for x in rows["n"]]
        coded = pa.concat_arrays(tokens).dictionary_encode()
        place, own = coded.indices.to_numpy(), np.concatenate(n)
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, place, own)
        found = [x.tobytes() for x in np.split(total[place].astype("<i8"), np.cumsum([len(x) for x in n])[:-1])]
        none = [None] * len(found)
        return pa.table({
            "stream": pa.array([*rows["stream"].to_pylist(), None], pa.int32()), "at": pa.array([*rows["at"].to_pylist(), None], pa.binary()), "n": pa.array([*found, None], pa.binary()),
            "n_train": pa.array([*none, int(total.sum())], pa.int64()), "n_distinct": pa.array([*none, int((total > 0).sum())], pa.int64()),
        })

    return counts.groupBy("of").applyInArrow(run, _KNOWN)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, log2 double, n_bytes long"


def scored(streams: DataFrame, known: DataFrame, model: Model, n_train: int, n_distinct: int, groups: int = 0) -> DataFrame:
    """SCORES of each text; known: from known_tokens."""
    sent, whole = streams.sparkSession.sparkContext.broadcast(model), math.log10(n_train + 0.5 * (n_distinct + 1))

    def run(held: pa.Table, known: pa.Table) -> pa.Table:
        _quiet_memory()
        out = []
        for _, words, ids, before, _, row in _streams(c.then(held.to_batches()), groups):
            n = np.zeros(len(words.length), np.int64)
            for at, found in zip(known["at"], known["n"], strict=True):
                n[np.frombuffer(at.as_buffer(), "<u4")] = np.frombuffer(found.as_buffer(), "<i8")
            pairs, place = _sorted_pairs(words, before, ids)
            cost = pair_log2(sent.value, pairs)[place]
            sizes, bytes_of = row["sizes"], words.length[ids]
            start = np.cumsum(sizes) - sizes
            per = lambda x: np.add.reduceat(x, start)  # noqa: B023, E731
            n_bytes = per(bytes_of) - (sizes > 1)  # a text has no space before its end
            out.append(pa.table({
                "doc_id": row["doc_ids"].values, "held_out": row["held"].values, "n_tokens": sizes.astype(np.int64), "n_known": per((n[ids] > 0).astype(np.int64)),
                "base_score": per(np.log10(n + 0.5)[ids]) - sizes * whole, "log2": per(cost), "n_bytes": n_bytes.astype(np.int64),
            }))
        return pa.concat_tables(out)

    return streams.groupBy("stream").cogroup(known.select("stream", "at", "n").groupBy("stream")).applyInArrow(run, SCORES)


def lm_score(docs: DataFrame, max_bits: int = MAX_BITS, grouped: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability), total_bits and bits_per_byte of each row of docs.

    grouped: tokens before are known by their group alone once the tables are full (``token_groups``), which is cheaper and tells less; by default each is known by itself.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, ROWS):
        streams, folder = c.written_at(dealt(docs), "lm-streams", "zstd")
    with arrow_rows(spark, 1):  # a stream is a row
        size = streams.agg(F.sum(F.aggregate(F.arrays_zip("held", F.sequence(F.lit(1), F.size("held"))), F.lit(0).cast("long"), lambda s, x: s + F.when(x["held"], 1).otherwise(0))).alias("held"), F.count("*").alias("n"), F.sum(F.octet_length("ids") / 4).cast("long").alias("tokens")).first()
        n_streams = size["n"]
        n_bits, groups = table_bits(size["tokens"] or 0, max_bits), token_groups(size["tokens"] or 0, max_bits) if grouped else 0
        found, counted_in = c.written_at(counted(streams, n_bits, max(spark.sparkContext.defaultParallelism, n_streams >> 6), max(PARTS, n_streams >> 3), groups), "lm-counts")
        known = c.written(known_tokens(found.filter("tokens IS NOT NULL").select("of", "stream", "tokens", "at", "n")), "lm-known")
        total = known.agg(F.sum("n_train").alias("n"), F.sum("n_distinct").alias("v")).first()
        n_train, n_distinct = total["n"] or 0, total["v"] or 0
        parts = _summed(found.filter("part IS NOT NULL"), (K << n_bits) // PARTS)
        tables = np.zeros((K, 1 << n_bits), U)
        for k in sorted(parts):  # one at a time, as all of this is the driver's memory
            tables.reshape(PARTS, -1)[k] = parts.pop(k)
        c.remove(spark, counted_in)
        weights, maps = learnt(streams, tables, groups)
        finished = np.empty(tables.shape, np.int16)
        for a in range(0, tables.shape[1], 1 << 16):  # a piece at a time, as all of this is the driver's memory
            own = tables[:, a : a + (1 << 16)]
            finished[:, a : a + (1 << 16)] = frozen(own & U(0xFFFF), own >> U(16))
        del tables, own
        model = Model(finished, weights, maps)
        out = c.written(scored(streams, known.filter("stream IS NOT NULL"), model, n_train, n_distinct, groups), "lm-scores")
    c.remove(spark, folder)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", (F.col("log2") * math.log10(2)).alias("score"), (-F.col("log2")).alias("total_bits"), (-F.col("log2") / F.col("n_bytes")).alias("bits_per_byte"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(c.table(spark, sf_dir, "documents"))
