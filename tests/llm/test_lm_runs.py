"""The language model knows each token before by itself, however full its tables are, and finds the different bytes of ordered pairs as runs."""

import numpy as np
import pyarrow as pa
import pytest

from tracelode.llm import lm_score

TEXTS = ("the cat sat on the mat", "a then they themes théâtre a\x01 a", "", "on \x00 x" + "y" * 40, "in cats that sat on the man", "y" * 40 + "z the cat", "internationalisation internationalise")


def pairs_of(words, texts):
    known = {w: i + 1 for i, w in enumerate(words)}
    ids = np.array([i for t in texts for i in [*map(known.__getitem__, t), 0]])
    pairs, place = lm_score._sorted_pairs(lm_score.Words(pa.array(words, pa.string())), np.append(0, ids[:-1]), ids)
    return pairs, np.bincount(place), place


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("abc"), rng.integers(1, 22))) for _ in range(300)]
    return [t.split() for t in TEXTS * 2] + [rng.choice(made, 9).tolist() for _ in range(200)]


def test_runs_are_the_events_of_the_sorts(texts):
    """The same bytes, contexts and occurrences, and the same costs of each token, whatever the order of words."""
    words = sorted({w for t in texts for w in t}, key=str.encode)
    mixed = [words[i] for i in np.random.default_rng(4).permutation(len(words))]
    assert pairs_of(words, texts)[0].words.in_order and not pairs_of(mixed, texts)[0].words.in_order
    found, costs = [], []
    tables = lm_score.Tables(18)
    tables.count(*pairs_of(words, texts)[:2])
    plain = lm_score.Tables(18)
    plain.count(*pairs_of(mixed, texts)[:2])
    assert (tables.both == plain.both).all()
    model = lm_score.Model(lm_score.frozen(tables.seen, tables.ones), np.full((lm_score.PLACES, lm_score.K, lm_score.GATES), 0.3, np.float32), np.zeros((2, 256 * lm_score.MAP_STEPS)))
    for order in (words, mixed):
        pairs, times, place = pairs_of(order, texts)
        shared, events = lm_score.Shared(pairs, times), {}
        for i, (_, _, at, group, n) in enumerate(shared.levels):
            h, byte, _ = shared.read(at, group)
            text = lm_score._of_text(shared.last[at], shared.so_far[at])
            for x, k in zip(zip([i] * len(at), *text.tolist(), h[0].tolist(), byte.tolist(), strict=True), n.tolist(), strict=True):
                events[x] = events.get(x, 0) + k
        found.append((events, len(shared.byte), sum(len(x[2]) for x in shared.levels)))
        costs.append(lm_score.pair_log2(model, pairs)[place])
    assert found[0] == found[1]
    assert costs[0] == pytest.approx(costs[1], rel=1e-6)


def test_each_token_before_counts_in_full_tables(spark, monkeypatch):
    """With far fewer slots than tokens the pair's context still tells every token before from the others."""
    seen = []
    monkeypatch.setattr(lm_score, "learnt", lambda s, tables, groups=0, learn=lm_score.learnt: seen.append(groups) or learn(s, tables, groups))
    docs = spark.createDataFrame([(i, f"a{i % 40} x{i % 40} b{i % 40} y{i % 40}") for i in range(400)], "doc_id long, text string")
    assert lm_score.token_groups(2000, 12) == lm_score.GROUPS
    assert lm_score.lm_score(docs, max_bits=12).count() == 400 and seen == [0]
    pairs = pairs_of([f"w{i:03d}" for i in range(200)], [[f"w{i:03d}", "w000"] for i in range(200)])[0]
    assert len(set(pairs.words.context[pairs.words.group].tolist())) == 201


def test_streams_hold_their_words_in_order(spark):
    docs = spark.createDataFrame([(i, f"b{i} a{i % 3} zz") for i in range(50)] + [(99, None)], "doc_id long, text string")
    with lm_score.arrow_rows(spark, 1):
        row = lm_score.dealt(docs).collect()
    words = row[0].words.split(" ")
    assert len(row) == 1 and words == sorted(words) and len(words) == 54
    ids = np.frombuffer(row[0].sizes, "<i4")
    assert ids.sum() == len(row[0].ids) // 4 == 50 * 4 + 1
    assert lm_score.dealt(docs.filter("doc_id = 99")).first().words == ""
