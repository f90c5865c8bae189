"""The language model's work on what is different: bytes in the contexts of the text, and tokens on their way between streams."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracelode.llm import lm_score

TEXTS = ("the cat sat on the mat", "a thethethe cat été", "", "on \x00 x" + "y" * 70, "the cat sat on the mat")


def stream():
    tokens = [t.split() for t in TEXTS]
    known = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in tokens for w in t))}
    ids = np.array([i for t in tokens for i in [*map(known.__getitem__, t), 0]])
    keys, times = lm_score._distinct(np.append(0, ids[:-1]), ids)
    return lm_score._pairs(lm_score.Words(pa.array(list(known), pa.string())), keys), times


def test_shared_bytes_stand_for_all_places():
    """Each place finds the byte and hashes that it has by itself, with fewer of them than places, and no occurrence is lost."""
    pairs, times = stream()
    h, b, own = pairs.read(0, len(pairs))
    shared = lm_score.Shared(pairs, times)
    at, within, of = pairs.places(0, len(pairs))
    where = np.searchsorted(shared.first, shared.first_bits(at, within, of))
    assert (shared.byte[where] == b).all() and (of == own).all() and len(shared.byte) < len(b)
    assert (lm_score._of_text(shared.last[where], shared.so_far[where]) == h[:3]).all()
    assert (np.bincount(where, times[own], len(shared.byte)) == shared.times).all()
    numbers = np.concatenate([bits for _, bits, _, _ in shared.each(20)])
    assert sorted(numbers.tolist()) == list(range(shared.n_bits))


def test_tokens_travel_in_packets(spark):
    """A row for each stream and range of hashes, not for each token; every token comes back with its count in all streams."""
    docs = spark.createDataFrame([(i, f"{t} w{i} w{i % 7}") for i in range(300) for t in TEXTS], "doc_id long, text string")
    whole, lm_score.STREAM = lm_score.STREAM, 1 << 14
    try:
        streams = lm_score.dealt(docs).cache()
    finally:
        lm_score.STREAM = whole
    rows = lm_score.counted(streams, 18, 2, 4).cache()
    tokens, n = rows.filter("tokens IS NOT NULL"), streams.count()
    assert n > 2 and n <= tokens.count() <= 4 * n
    known = lm_score.known_tokens(tokens.select("of", "stream", "tokens", "at", "n"))
    want = {r.w: r["count"] for r in docs.filter(~lm_score.held_out()).select(F.explode(F.split(F.concat(F.lower("text"), F.lit(" \n\n")), "[ ]")).alias("w")).filter("w != ''").groupBy("w").count().collect()}
    got, words = {}, {r.stream: ["\n\n", *r.words.split(" ")] for r in streams.collect()}
    for r in known.filter("stream IS NOT NULL").collect():
        for at, times in zip(np.frombuffer(r["at"], "<u4"), np.frombuffer(r["n"], "<i8"), strict=True):
            assert got.setdefault(words[r.stream][at], int(times)) == times
    assert {w: k for w, k in got.items() if k} == want
    total = known.agg(F.sum("n_train").alias("n"), F.sum("n_distinct").alias("v")).first()
    assert (total.n, total.v) == (sum(want.values()), len(want))


def test_tables_are_packed_whole():
    values = np.array([0, 1, 255, 256, 1 << 31, (1 << 32) - 1] * 100, np.uint32)
    assert (lm_score._got(pa.py_buffer(lm_score._put(values)), len(values)) == values).all()
    assert len(lm_score._put(np.arange(1 << 16, dtype=np.uint32) % 5)) < 1 << 14
