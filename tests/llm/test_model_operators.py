"""Language-model scores, token files, BPE, exact search, mixing and the pipeline against plain versions, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelode.llm import byte_bpe, lm_score, source_mix, token_files, va_search

DOCS = "doc_id long, text string, source string, ids string, score double, batch long"
LONG = "Über " + " ".join(f"word{i % 997}," for i in range(30_000))
TEXTS = [None, "", " ", "a", "The the\x0bTHE x\n", "two  spaces and\ttab \n newline\n\nmore", LONG, "<|endoftext|> ok<|endoftext|>", "don't WE'LL 123 日本語 \U0001f600", "ERT*** thst%%% a.\nB c!!", "Étre\nÀ, çà."]
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 2 else None, t, [None, "s", "t"][i % 3], "x", 1.0, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], rows[4]], DOCS)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def plain_base(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    c = Counter(w for i, ws in toks if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in toks]


def test_lm_score(spark, odd, docs):
    for df in (odd, docs):
        want = sorted(plain_base([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]))
        rows = df.transform(lm_score.lm_score).collect()
        got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
        assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm_score.lm_score(odd.limit(0)).count() == 0


def test_lm_prefers_what_it_learnt(spark):
    """Held-out text in the language of the corpus against the same letters shuffled; and none of it leaks from held-out rows."""
    rng = np.random.default_rng(2)
    vocab = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(2, 8))) for _ in range(300)]
    text = lambda: " ".join(rng.choice(vocab, 60))
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, text()) for i in range(300) if i not in ids]
    good = text()
    bad = "".join(rng.permutation(list(good)))
    got = {r.doc_id: r.score for r in lm_score.lm_score(spark.createDataFrame([*rows, (ids[0], good), (ids[1], bad)], "doc_id long, text string")).collect()}
    assert got[ids[0]] > got[ids[1]] + 20


def stream_of(*texts):
    """Words, ids and the ids before them, as a stream has them."""
    tokens = [t.lower().split() for t in texts]
    known = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in tokens for w in t))}
    ids = np.array([i for t in tokens for i in [*map(known.__getitem__, t), 0]])
    return lm_score.Words(pa.array(list(known), pa.string())), ids, np.append(0, ids[:-1])


def exact_contexts(before, token, i):
    """What the four contexts of byte i of a token are, as plain values."""
    both, so_far = (before + token[:i]), token[:i]
    return [*((n, both[max(0, len(both) - n) :]) for n in (2, 4)), ("token", so_far), ("pair", before, so_far)]


def path_of(x):
    code = lm_score.CODE
    return [(int(code.node[d, x]), int(code.bit[d, x])) for d in range(code.length[x])]


def stretch(pair):
    return math.log((pair[1] + 0.4) / (pair[0] + 0.4))


def level(pair):
    return sum(sum(pair) >= n for n in lm_score.LEVELS) + (6 if 0 in pair else 0)


def test_lm_model_against_a_plain_one():
    """Counting, learning and scoring with dictionaries of contexts instead of hashed tables, bit by bit and occurrence by occurrence."""
    words, ids, before = stream_of("the cat sat on the mat", "The cat ate the rat that sat", "", "a cat, the \u00e9t\u00e9 and a thethethe " * 3, "x" * 150, "the cat sat on the mat")
    units = [bytes(words.flat[a : a + n]) for a, n in zip(words.start, words.length, strict=True)]
    keys, times = lm_score._distinct(before, ids)
    assert [(k >> 32, k & 0xFFFFFFFF) for k in keys.tolist()] == list(dict.fromkeys(zip(before.tolist(), ids.tolist(), strict=True)))
    pairs, tables, counts = lm_score._pairs(words, keys), lm_score.Tables(23), {}
    tables.count(pairs, times)
    for p, t in zip(before, ids, strict=True):
        for i, x in enumerate(units[t]):
            for node, bit in path_of(x):
                for c in exact_contexts(units[p], units[t], i):
                    old = counts.get((c, node), (0, 0))
                    counts[c, node] = (old[0] + 1 - bit, old[1] + bit)
    table = np.stack([lm_score.packed(tables.seen[k].astype(np.int64), tables.ones[k].astype(np.int64)) for k in range(4)])
    own, w, maps = lm_score.Mixer(table), np.full((8, 4, 144), 0.3), Counter()
    bytes_of = [(units[k >> 32], units[k & 0xFFFFFFFF], i, n) for k, n in zip(keys.tolist(), times.tolist(), strict=True) for i in range(len(units[k & 0xFFFFFFFF]))]

    def seen(event, d, node, mixed, less=None):
        held = [counts.get((c, node), (0, 0)) for c in exact_contexts(*event[:3])]
        held = [(a - (less == 0), b - (less == 1)) for a, b in held]
        x, gate = [stretch(p) for p in held], level(held[2]) * 12 + level(held[3])
        dot = min(12.0, max(-12.0, sum(a * b for a, b in zip(mixed[min(d, 7), :, gate], x, strict=True))))
        return x, gate, dot, int((dot + 12.375) * 32 / 24)

    def refined(dot, maps, node, at, bit):
        p, m = 1 / (1 + math.exp(-dot)), (maps[node, at, 0], maps[node, at, 1])
        p = (p + (m[1] + 0.4) / (sum(m) + 0.8)) / 2 if sum(m) >= 20 else p
        return p if bit else 1 - p

    for a in range(0, len(pairs), 61):
        h, b, of = pairs.read(a, min(a + 61, len(pairs)))
        assert bytes(b) == bytes(e[1][e[2]] for e in bytes_of[a : a + 61])
        told, known, costs = own.learn(h, b, times[of]), maps.copy(), np.zeros(len(b))
        for d in range(int(lm_score.CODE.length[b].max())):
            up, size = np.zeros((4, 144)), np.zeros(144)
            for i, event in enumerate(bytes_of[a : a + 61]):
                way = path_of(event[1][event[2]])
                if d >= len(way):
                    continue
                node, bit = way[d]
                x, gate, dot, at = seen(event, d, node, w, bit)
                costs[i] += math.log2(refined(dot, known, node, at, bit))
                maps[node, at, bit] += event[3]
                up[:, gate] += event[3] * (bit - 1 / (1 + math.exp(-dot))) * np.array(x)
                size[gate] += event[3]
            w[min(d, 7)] += 0.5 * up / (size + 4)
        assert told == pytest.approx(costs, rel=2e-3, abs=2e-3)
    assert own.weights == pytest.approx(w, abs=5e-3)
    model = lm_score.Model(lm_score.frozen(table & 0xFFFF, table >> np.uint32(16)), own.weights, own.maps)
    want = [0.0] * len(keys)
    for j, k in enumerate(keys.tolist()):
        for i, x in enumerate(units[k & 0xFFFFFFFF]):
            for d, (node, bit) in enumerate(path_of(x)):
                _, _, dot, at = seen((units[k >> 32], units[k & 0xFFFFFFFF], i), d, node, w)
                want[j] += math.log2(refined(dot, maps, node, at, bit))
    assert lm_score.pair_log2(model, pairs) == pytest.approx(want, rel=0.03, abs=0.3)


def test_lm_model_is_a_distribution(monkeypatch):
    """After any bytes of a token the probabilities of all 256 next ones sum to 1; pieces don't change a score."""
    words, ids, before = stream_of("the then of and a " * 40)
    keys, times = lm_score._distinct(before, ids)
    pairs, tables = lm_score._pairs(words, keys), lm_score.Tables(18)
    tables.count(pairs, times)
    table = np.stack([lm_score.packed(tables.seen[k].astype(np.int64), tables.ones[k].astype(np.int64)) for k in range(4)])
    own = lm_score.Mixer(table)
    own.follow(pairs, times)
    model = lm_score.Model(lm_score.frozen(table & 0xFFFF, table >> np.uint32(16)), own.weights, own.maps)
    h, b, _ = pairs.read(0, len(pairs))
    for i in range(0, len(b), 3):
        every = [float(model.log2(h[:, i : i + 1], np.array([x], np.uint8))[0]) for x in range(256)]
        assert (2.0 ** np.array(every)).sum() == pytest.approx(1, abs=1e-4)
    whole = lm_score.pair_log2(model, pairs)
    monkeypatch.setattr(lm_score, "SCORED", 5)
    assert lm_score.pair_log2(model, pairs) == pytest.approx(whole, rel=1e-6)


def test_lm_scores_do_not_depend_on_partitions(spark, small, monkeypatch):
    """Equal scores to the last bit however the rows are dealt, and equal texts score alike whether they were learnt from or not."""
    monkeypatch.setattr(lm_score, "STREAM", 1 << 17)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(spark.createDataFrame([(10_000 + i, "the very same text of many rows") for i in range(20)], "doc_id long, text string"))
    of = lambda df: {(r.doc_id, r.score, r.base_score, r.n_known) for r in lm_score.lm_score(df).collect()}
    first = of(docs.repartition(7))
    assert first == of(docs.coalesce(1).orderBy(F.desc("doc_id"))) and len(first) == docs.count()
    same = {(i, s) for i, s, _, _ in first if i >= 10_000}
    assert len(same) == 20 and len({s for _, s in same}) == 1


def test_lm_tables_pack_full_slots():
    seen, ones = np.array([0, 3, 65_535, 65_536, 1 << 30]), np.array([0, 1, 65_535, 32_768, 1 << 29])
    got = lm_score.packed(seen, ones)
    assert (got & 0xFFFF).tolist() == [0, 3, 65_535, 32_768, 32_768] and (got >> np.uint32(16)).tolist() == [0, 1, 65_535, 16_384, 16_384]


def test_lm_long_token_and_growth(spark):
    """A token of a megabyte is read in pieces, and the bits a byte fall as more of the same language is learnt."""
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(2, 8))) for _ in range(400)]
    bits = []
    held = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5 == 1][:20]
    for n in (40, 1500):
        rows = [(i, " ".join(rng.choice(vocab, 60))) for i in range(5000, 5000 + n)] + [(i, " ".join(rng.choice(vocab, 60))) for i in held] + [(9000, "ab" * (1 << 19))] * (n == 40)
        got = {r.doc_id: r for r in lm_score.lm_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert len(got) == len(rows)
        assert all(r.total_bits == pytest.approx(-r.score / math.log10(2)) for r in got.values())
        bits.append(np.mean([got[i].bits_per_byte for i in held]))
    assert bits[1] < bits[0] - 0.3


def test_lm_contexts_run_across_tokens(spark):
    """Which token follows which is learnt, repeated texts count, and tables grow with the training tokens."""
    rng = np.random.default_rng(4)
    pairs = [("red", "fox"), ("old", "oak"), ("wet", "sea"), ("low", "hum")]
    text = lambda: " ".join(w for i in rng.integers(0, 4, 30) for w in pairs[i])
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    good = text().split()
    bad = [good[i] if i % 2 == 0 else good[(i + 2) % 60] for i in range(60)]  # the same tokens, in other pairs
    rows = [(i, text()) for i in range(200) if i not in ids]
    got = {r.doc_id: r.score for r in lm_score.lm_score(spark.createDataFrame([*rows, (ids[0], " ".join(good)), (ids[1], " ".join(bad))], "doc_id long, text string")).collect()}
    assert got[ids[0]] > got[ids[1]] + 20
    assert [lm_score.table_bits(n) for n in (0, 1 << 15, 1 << 16, 1 << 18, 1 << 19)] == [18, 18, 19, 21, 22]
    assert lm_score.table_bits(1 << 30) == lm_score.MAX_BITS and lm_score.table_bits(1 << 30, 26) == 26


def test_token_files(spark, odd, docs, tmp_path):
    plain = Tokenizer.from_file(JSON)
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids.count(plain.token_to_id("<|endoftext|>")) == 1
    for k, df in enumerate((odd, docs)):
        folder = f"{tmp_path}/{k}"
        manifest = token_files.write_token_files(df, folder, JSON)
        got = token_files.read_token_files(spark, folder).orderBy("start").collect()
        rows = sorted(((r.doc_id, plain.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        start = 0
        for g, (i, ids) in zip(got, rows, strict=True):
            assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
        assert manifest.agg(F.sum("n_tokens")).first()[0] == start
        first = manifest.orderBy("shard").first()
        with open(f"{folder}/dictionary.zdict", "rb") as f:
            dictionary = f.read()
        assert token_files.ShardReader(f"{folder}/{first.file}", dictionary).ids(0).tolist() == rows[0][1]
        with pytest.raises(ValueError, match="another dictionary"):
            token_files.ShardReader(f"{folder}/{first.file}", b"other")
    empty = f"{tmp_path}/none"
    token_files.write_token_files(odd.limit(0), empty, JSON)
    assert token_files.read_token_files(spark, empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t.,!'aZéß1日ɐ\x85 ", "don't", "we'll", "12345", "<|endoftext|>", "<|", "|>", " and", " Étre"]), max_size=20).map("".join), st.booleans())
def test_chunks_have_the_ids_of_the_text(text, plain):
    t = token_files._tokenizer(JSON, plain)
    assert np.frombuffer(token_files.Encoder(JSON, plain)(text, b""), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def test_byte_bpe(odd, docs):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    for df in (odd, docs):
        texts = {str((r.doc_id, r.text)): r for r in df.select("doc_id", "text").collect()}
        rows = byte_bpe.round_trip(df, RANKS, P.PATTERN).collect()
        assert len(rows) == df.count()
        by_id = {str(r.doc_id): r for r in texts.values()}
        for r in rows:
            text = by_id[str(r.doc_id)].text or ""
            assert list(r.ids) == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert byte_bpe.round_trip(odd.limit(0), RANKS, P.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = byte_bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(5000))
    assert all(h.slot(f"x{i}".encode()) == -1 for i in range(1000))
    assert byte_bpe.PerfectHash([b"a"]).slot(b"a") == 0 and byte_bpe.PerfectHash([]).slot(b"a") == -1


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_merges_are_those_of_the_library(text):
    own = byte_bpe.coder(RANKS, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    assert np.frombuffer(own.encode(text), "<u4").tolist() == enc.encode_ordinary(text)


def test_va_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.3, (900, 8)).round(2)
    x[100:400] = x[100]  # one vector many times: ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2020, [1.0, None], 0), (2040, [float("nan")] * 8, 0), (2060, [float("inf")] * 8, 0), (2080, [], 0), (None, [0.5] * 8, 0), (2100, [0.5] * 3, 0), (2101, [0.25] * 3, 0)]
    df = spark.createDataFrame([*rows, rows[7]], "vec_id long, embedding array<double>, score int")
    va = va_search.CHUNK
    va_search.CHUNK = 128
    try:
        got = {}
        for r in va_search.top_k(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
            assert r.rank == len(got[r.query_id])
    finally:
        va_search.CHUNK = va
    q = np.floor(64 * x).astype(int)
    ids = [*range(900), 7]
    for i in range(0, 900, 20):
        want = sorted(((-int(q[j] @ q[i]), j) for j in ids if j != i))[:20]
        assert got[i] == [(j, -s) for s, j in want]
    assert got[2100] == [(2101, 3 * 32 * 16)] and set(got) == {*range(0, 900, 20), 2100}
    assert va_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    with pytest.raises(Exception, match="may not fit"):
        va_search.top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).count()


def test_va_bounds_hold():
    rng = np.random.default_rng(4)
    v, q = rng.integers(-500, 500, (300, 6)), rng.integers(-500, 500, (20, 6))
    middle, slack = va_search.Approximation(v, 3).bounds(q)
    assert (np.abs(middle - q @ v.T) <= slack[:, None]).all()


def plain_apportion(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        got[max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12).filter(any), st.integers(0, 300))
def test_apportionment_is_by_highest_quotients(votes, seats):
    big = [10**9] * len(votes)
    got, want = source_mix.apportion(votes, seats, big), plain_apportion(votes, seats)
    assert sum(got) == seats
    # Equal quotients may go to either; the last seats given are then worth the same.
    worth = lambda n: sorted(round(v / (2 * k + 1), 9) for v, m in zip(votes, n) for k in range(m))
    assert worth(got) == worth(want)
    caps = [min(3, v) for v in votes]
    limited = source_mix.apportion(votes, seats, caps)
    assert sum(limited) == min(seats, sum(caps)) and all(a <= b for a, b in zip(limited, caps))


def test_targets():
    assert source_mix.targets([100, 100, 100], [3, 1, 2]) == [200, 250 / 3, 500 / 3]
    assert source_mix.targets([10, 1000], [3, 1]) == [20, 1495] and source_mix.targets([0, 10], [3, 1]) == [0, 15] and source_mix.targets([], []) == []


def test_source_mix(spark, odd, docs):
    for df in (odd, docs):
        rows = source_mix.source_mix(df).collect()
        sizes = sorted((str(r.doc_id), len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in df.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), r.size) for r in rows) == sizes
        assert all(0 <= r.taken <= 2 * r.size for r in rows)
        for s in {r.source for r in rows}:
            own = [r for r in rows if r.source == s]
            assert sum(r.size for r in own) == own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) <= 2 * source_mix.BLOCK
        again = source_mix.source_mix(df.repartition(3)).collect()
        assert sorted((str(r.doc_id), r.size, r.taken) for r in rows) == sorted((str(r.doc_id), r.size, r.taken) for r in again)
    mixed = source_mix.mixed_documents(docs, ["doc_id", "text", "lang", "source", "n_chars"])
    total = sum(len(re.findall("[^\x20\x09-\x0d]+", r.text)) for r in mixed.collect())
    assert total == sum(r.taken for r in source_mix.source_mix(docs).collect())
    assert mixed.columns == docs.select("doc_id", "text", "lang", "source", "n_chars").columns
    assert source_mix.source_mix(odd.limit(0)).count() == 0


def test_many_shards(spark):
    """Streams of several shards meet the same targets."""
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 50).cast("int"))).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    old, source_mix.SHARD_WORDS = source_mix.SHARD_WORDS, 500
    try:
        rows = source_mix.source_mix(df).collect()
    finally:
        source_mix.SHARD_WORDS = old
    for s in "ab":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * source_mix.BLOCK and all(r.taken <= 2 * r.size for r in own)


def test_pipeline(spark, small, docs):
    import corpus_pipeline
    from tracelode.llm import quality_rules, simhash_dedup, toxicity

    now, labels = docs, spark.read.parquet(f"{small}/labels.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = corpus_pipeline.c.written(stage(spark, now, small), name)
        assert now.columns == corpus_pipeline.COLUMNS
        kept.append(now)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(kept[1]) == ids(quality_rules.quality_rules(docs).filter("kept"))
    assert ids(kept[2]) == ids(toxicity.toxicity(kept[1], labels).filter("predicted = 0"))
    comps = simhash_dedup.simhash_components(kept[2])
    assert ids(kept[3]) == sorted({r.component_id for r in comps.collect()})
    taken = {r.doc_id: r.taken for r in source_mix.source_mix(kept[3]).collect()}
    words = Counter()
    for r in kept[4].collect():
        words[r.doc_id] += len(re.findall("[^\x20\x09-\x0d]+", r.text))
    assert {k: v for k, v in taken.items() if v} == dict(words)
    out = corpus_pipeline.STAGES[4][1](spark, kept[4], small).collect()
    text = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in kept[4].collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in out) == text and all(r.n_tokens == len(r.ids) for r in out)
    assert corpus_pipeline.run(spark, small).count() == len(out)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0
