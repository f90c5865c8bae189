"""Bytes that are equal in all contexts of the language model are computed once, for all the pairs of tokens that have them."""

import numpy as np
import pyarrow as pa
import pytest

from tracelode.llm import lm_score

TEXTS = ("the cat sat on the mat", "a then they theme théâtre", "", "on \x00 x" + "y" * 40, "in cats that sat on the man", "y" * 40 + "z the cat")


@pytest.fixture(params=[0, 2])
def stream(request):
    tokens = [t.split() for t in TEXTS * 3]
    known = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in tokens for w in t))}
    ids = np.array([i for t in tokens for i in [*map(known.__getitem__, t), 0]])
    pairs, place = lm_score._sorted_pairs(lm_score.Words(pa.array(list(known), pa.string()), request.param), np.append(0, ids[:-1]), ids)
    return pairs, np.bincount(place)


def test_events_are_the_different_bytes(stream):
    """One for each byte and contexts, with all of its occurrences, and found again from every pair that has it."""
    pairs, times = stream
    h, b, own = pairs.read(0, len(pairs))
    _, within, _ = pairs.places(0, len(pairs))
    shared = lm_score.Shared(pairs, times)
    want, got = {}, {}
    for x, n in zip(zip(np.minimum(within, lm_score.TRIE).tolist(), *h.tolist(), b.tolist(), strict=True), times[own].tolist(), strict=True):
        want[x] = want.get(x, 0) + n
    for i, (there, place, at, group, n) in enumerate(shared.levels):
        pair_h, byte, _ = shared.read(at, group)
        text_h = lm_score._of_text(shared.last[at], shared.so_far[at])
        for x, k in zip(zip([i] * len(at), *text_h.tolist(), pair_h[0].tolist(), byte.tolist(), strict=True), n.tolist(), strict=True):
            got[x] = got.get(x, 0) + k
        who = np.arange(len(pairs.token)) if i < lm_score.PAIRED else shared.unit
        mine = np.flatnonzero(within == i)
        if i < lm_score.TRIE:
            here = place[np.searchsorted(there, who[own[mine]])]
            assert (pair_h[0][here] == h[3][mine]).all() and (byte[here] == b[mine]).all()
    assert got == want
    assert sum(len(x[2]) for x in shared.levels) < len(pairs)


def test_counts_and_scores_are_those_of_every_byte_by_itself(stream):
    """Tables as from all places one by one; and the same scores as without anything shared."""
    pairs, times = stream
    tables, plain = lm_score.Tables(18), np.zeros((4, 1 << 18, 2), np.int64)
    tables.count(pairs, times)
    h, b, own = pairs.read(0, len(pairs))
    order = lm_score.by_length(b)
    for _, _, bit, slots in lm_score.bits(h[:, order], b[order], 18):
        for k in range(4):
            np.add.at(plain[k], (slots[k], bit), times[own[order]][: len(bit)])
    assert (tables.seen == plain.sum(2)).all() and (tables.ones == plain[:, :, 1]).all()
    mixer = lm_score.Mixer(np.stack([lm_score.packed(tables.seen[k].astype(np.int64), tables.ones[k].astype(np.int64)) for k in range(4)]))
    mixer.follow(pairs, times)
    model = lm_score.Model(lm_score.frozen(tables.seen, tables.ones), mixer.weights, mixer.maps)
    assert lm_score.pair_log2(model, pairs) == pytest.approx(np.bincount(own, model.log2(h, b)), rel=1e-5)


def test_full_tables_know_tokens_before_by_group(spark):
    """Groups begin where the tables have too few slots, and scores don't hang on partitions there either."""
    assert lm_score.token_groups(1 << 19) == 0 and lm_score.token_groups((1 << 19) + 1) == lm_score.GROUPS
    docs = spark.createDataFrame([(i, f"{t} w{i} w{i % 7}") for i in range(200) for t in TEXTS], "doc_id long, text string")
    first, second = (sorted((r.doc_id, r.score) for r in lm_score.lm_score(d, max_bits=12).collect()) for d in (docs.repartition(5), docs.coalesce(1)))
    assert first == second and len(first) == docs.count()


@pytest.mark.parametrize("high", [1 << 10, 1 << 60])
def test_numbers_of_keys(high):
    keys = np.random.default_rng(1).integers(0, 50, 500) * (high // 50)
    place, found = lm_score._coded(keys)
    assert (found[place] == keys).all() and (np.diff(found) > 0).all()
    assert [len(x) for x in lm_score._coded(keys[:0])] == [0, 0]
