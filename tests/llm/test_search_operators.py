"""Substring dedup, ball-tree clusters and max-tree search against plain versions on small inputs."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from tracelode.llm import ball_tree, max_tree, suffix_dedup

DOCS = "doc_id long, text string, shard string, n int, s1 string"


def docs(spark, rows):
    """Rows (doc_id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], DOCS).repartition(3)


# Substring dedup


def plain_kept(rows, window):
    first = {}
    split = [(i, (t or "").split(" ") if t else []) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, 1000])
@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_against_plain_windows(spark, seed, hot):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(20)]
    rows = []
    for i in range(60):
        w = [rng.choice("abcdefgh") for _ in range(rng.randrange(25))]
        for _ in range(rng.randrange(3)):  # parts of one passage, at times with one word changed
            a = rng.randrange(8)
            part = passage[a : a + rng.randrange(5, 14)]
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "!"
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        rows.append((i if i % 17 else None, " ".join(w) or None))
    rows += [(3, rows[5][1]), (3, rows[3][1]), (40, " ".join(["la"] * 700)), (41, " ".join(["la"] * 650)), (-5, "")]
    got = suffix_dedup.without_copies(docs(spark, rows), window=8, gram=3, shard=200, hot=hot).collect()
    assert sorted([(r.doc_id, r.kept, r.n_words, r.n_removed) for r in got], key=str) == plain_kept(rows, 8)
    for r in got:
        assert sum(s.b - s.a for s in r.spans) == r.n_removed


def test_automaton_states_know_the_first_document():
    rng = random.Random(1)
    passages = [[rng.choice("abc") for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    documents = rng.sample(range(100), 12)
    auto = suffix_dedup.Automaton(passages, documents)
    assert len(auto.link) <= 2 * sum(map(len, passages)) + 1
    text = [rng.choice("abcd") for _ in range(300)]
    joined = ["".join(p) for p in passages]
    for i, (n, first) in enumerate(auto.stream(text, 4)):
        want = max(k for k in range(5) if k <= i + 1 and (not k or any("".join(text[i + 1 - k : i + 1]) in p for p in joined)))
        assert n == want
        if n == 4:
            assert first == min(d for p, d in zip(joined, documents, strict=True) if "".join(text[i - 3 : i + 1]) in p)


def test_words_are_parted_by_six_characters_only(spark):
    text = "\x0b a b \t\tc\x1cd\r\n e f \x0c"
    got = suffix_dedup.without_copies(docs(spark, [(1, text), (2, text), (None, None)]), window=2, gram=1).collect()
    assert sorted([(r.doc_id, r.kept, r.n_words, r.n_removed) for r in got], key=str) == [(1, "a b c\x1cd e f", 3, 0), (2, "", 3, 3), (None, "", 0, 0)]


def test_suffix_dedup_of_nothing_and_of_a_long_text(spark):
    assert suffix_dedup.without_copies(docs(spark, []).filter("doc_id > 0")).count() == 0
    rng = random.Random(2)
    text = " ".join(str(rng.randrange(5000)) for _ in range(120_000))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.without_copies(docs(spark, [(1, text), (2, "x " + text), (3, text[: len(text) // 2])])).select("doc_id", "n_removed").collect()}
    assert got[1] == 0 and got[2] == 120_000 and got[3] >= 59_000


# Ball-tree clusters


def plain_clusters(rows, k, rounds, seed=1):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    m = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(m))
    for _ in range(rounds):
        parts = [[] for _ in m]
        for _, v in kept:
            parts[near(v)[1]].append(v)
        m = [[sum(x) // len(p) for x in zip(*p, strict=True)] if p else old for p, old in zip(parts, m, strict=True)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    return sorted(out, key=str), m, sum(d for *_, d in out)


@pytest.mark.parametrize("seed", range(4))
def test_ball_tree_against_plain_rounds(spark, seed):
    rng = random.Random(seed)
    point = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) + (rng.gauss(0, 0.2) if seed % 2 else rng.choice([0.0, 0.25])) for _ in range(3)]
    rows = [(i, point()) for i in range(400)] + [(5, point()), (5, [1.0, 1.0, 1.0]), (5, [1.0, 1.0, 1.0]), (None, point()), (900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 0.0, 0.0]), (903, [1.0]), (904, []), (905, [float("inf"), 0.0, 0.0])]
    rows += [(1000 + i, [2.0, 2.0, 2.0]) for i in range(200)]  # one common vector
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got, centroids = ball_tree.ball_tree_clusters(df, k=6, rounds=3, dim=3, tree=64)
    got = got.collect()
    want, m, inertia = plain_clusters(rows, 6, 3)
    assert centroids == m
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got], key=str) == want
    assert {r.inertia for r in got} == {inertia}
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, m[r.cluster])).encode()).hexdigest()


def test_balls_that_lie_near_one_centroid_are_not_opened():
    rng = np.random.default_rng(0)
    middles = rng.integers(-500, 500, (8, 16))
    rows = (middles[rng.integers(0, 8, 4000)] + rng.integers(-20, 20, (4000, 16))).astype(np.int64)
    tree, order = ball_tree.build(rows)
    assert sorted(order.tolist()) == list(range(4000)) and (tree.vectors == rows[order]).all()
    n, sums, inertia, opened = ball_tree.gathered(tree, middles)
    best, d = ball_tree.nearest(rows, middles)
    assert n.tolist() == np.bincount(best, minlength=8).tolist() and sum(inertia) == int(d.sum())
    assert (sums == np.stack([rows[best == j].sum(axis=0) for j in range(8)])).all()
    assert opened < 400  # most rows go with their ball


def test_ball_tree_of_few_none_and_too_large(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, m = ball_tree.ball_tree_clusters(frame([(1, [0.0, 1.0]), (2, [3.0, 1.0])]), k=16, dim=2)
    assert len(m) == 2 and sorted((r.vec_id, r.distance) for r in got.collect()) == [(1, 0), (2, 0)]
    got, m = ball_tree.ball_tree_clusters(frame([(1, None)]), dim=2)
    assert got.count() == 0 and m == [] and len(got.columns) == 6
    with pytest.raises(Exception, match="too large"):
        ball_tree.ball_tree_clusters(frame([(1, [1e12, 0.0])]), dim=2)


# Max-tree search


def plain_search(rows, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, terms(t)) for i, t in rows]
    n, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        asked, scored = terms(text), []
        for i, t in held:
            s = 0
            for q in asked:
                df = sum(q in x for _, x in held)
                if q in t:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * t.count(q) // (1000 * t.count(q) + 8 * (25 + 75 * len(t) * n // total)))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_max_tree_against_plain_scores(spark, monkeypatch, seed):
    monkeypatch.setattr(max_tree, "RANGE", 150)
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ÄÖ", "x1", "the", "the", "gamma-delta", "K", "naïve", "0"]
    text = lambda n: rng.choice([" ", ",", "_", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(n)))
    rows = [(i, text(12)) for i in range(300)] + [(7, "beta beta"), (7, "beta beta"), (None, "beta"), (None, None), (500, ""), (501, "???"), (502, "beta " * 3000)]
    rows += [(2000 - i, "same text of many") for i in range(100)]  # equal scores
    items = [(1, "alpha BETA beta"), (2, "nothing here"), (3, "?"), (4, None), (5, "same text"), (5, "the x1"), (None, "ÄÖ äö naïve")]
    frame = lambda r, key: spark.createDataFrame([(i, t, 1, 2) for i, t in r], f"{key} long, text string, score int, item int")
    held = max_tree.index(frame(rows, "doc_id").repartition(2))
    got = [(r.item_id, r.rank, r.doc_id, r.score) for r in max_tree.search(held, frame(items, "item_id"), k=10).collect()]
    assert sorted(got, key=str) == plain_search(rows, items, 10)
    monkeypatch.setattr(max_tree, "ITEMS", 3)  # more blocks of items, the same answer
    again = [(r.item_id, r.rank, r.doc_id, r.score) for r in max_tree.search(held, frame(items, "item_id"), k=10).collect()]
    assert sorted(again, key=str) == sorted(got, key=str)


def test_few_leaves_are_opened():
    rng = np.random.default_rng(0)
    tf = rng.zipf(2.0, 1024).clip(1, 50)
    tree = max_tree.RangeTree(np.array([0]), np.array([1024]), np.arange(1024), tf, np.full(1024, 100))
    places, scores, opened = tree.best(np.array([0]), np.array([7]), 10, 0)
    want = np.sort(7 * (1_000_000_000 * tf // (1000 * tf + 800)))[::-1]
    assert np.sort(scores)[::-1][:10].tolist() == want[:10].tolist() and opened < 64
    assert set(np.flatnonzero(7 * (1_000_000_000 * tf // (1000 * tf + 800)) == want[9])) <= set(places.tolist())  # all ties of the last
    assert tree.best(np.array([0]), np.array([7]), 10, int(want[0]) + 1)[2] == 0


def test_max_tree_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert max_tree.search(max_tree.index(empty), items).count() == 0
    docs_ = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert max_tree.search(max_tree.index(docs_), items.filter("item_id > 1")).columns == ["item_id", "rank", "doc_id", "score"]
    assert [r.doc_id for r in max_tree.search(max_tree.index(docs_), items).collect()] == [1]
