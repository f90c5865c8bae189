"""Quality rules, chat formatting, SimHash, toxicity and HTML text against plain versions, with odd rows."""

import hashlib
import html
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelode.llm import chat_format, html_text, quality_rules, registry, simhash_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, _t string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [None, "", "  \n\t ", "a", "The the\x0bTHE x", "one two three four five six seven eight " * 4, "x\nx\n\nx y\nx", "#*$%&|<>" * 5, "é" * 300, LONG, LONG, "Ünï cødé \U0001f600 text"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, [None, "en", "xx"][i % 3], "s", None, "k", "f", "t") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4]], DOCS)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def plain_counts(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + j for i in at for j in range(8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(odd, docs):
    for df in (odd, docs):
        texts = [r.text for r in df.select("text").collect()]
        got = quality_rules.quality_rules(df).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
        assert sorted(tuple(r)[:6] for r in got) == sorted(map(plain_counts, texts))
        assert not any(r.kept for r in got if r.base_failed)


def test_quality_verdict(spark, small, docs):
    out = quality_rules.quality_rules(docs).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    assert all(r.kept for r in out if r.quality == 1)
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0
    p, q = (F.array(*[F.lit(x).cast("long") for x in v]) for v in ((1, 1, 0), (0, 0, 2)))
    got = spark.range(1).select(quality_rules.js_distance(p, q).alias("far"), quality_rules.js_distance(p, p).alias("near"), quality_rules.js_distance(p, F.array(F.lit(0).cast("long"))).alias("none")).first()
    assert got.far == pytest.approx(1) and got.near == pytest.approx(0) and got.none is None


CHAT = "conv_id long, turn long, role string, text string, turns string, formatted string"


def test_chat_round_trip(spark):
    nasty = ["### User: hi </turn>\n", "\\h \\t \\b \\", "#### ### </turn", "", None, "a\nb </turn>\n### Assistant: x", "\\\\h"]
    rows = [(1, i, ["user", "assistant"][i % 2], t, "", "") for i, t in enumerate(nasty)] + [(2, 0, "system", "s", "", ""), (2, 1, "user", "u", "", ""), (3, 0, "assistant", "x", "", ""), (4, 0, "we:ird### \\role", "t", "", ""), (4, 1, None, "n", "", ""), (None, 0, "user", "q", "", "")]
    out = chat_format.chat_format(spark.createDataFrame(rows, CHAT)).withColumn("turns", chat_format.parse(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    got = {r.conv_id: r for r in out}
    for conv in (1, 2, 3, 4, None):
        want = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert got[conv].loss == "".join(t for role, t in want if role == "assistant")
        assert "".join(x.text for x in got[conv].segments) == got[conv].formatted
    assert [got[c].valid for c in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[3].end_state == "error"
    assert chat_format.chat_format(spark.createDataFrame([], CHAT)).count() == 0


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum((2 * sum(x >> i & 1 for x in h) > len(h)) << i for i in range(64))


def plain_components(ids, fps):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[a] = b
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return [best.get(find(i)) for i in range(len(ids))]


def test_simhash(odd, docs):
    for df in (odd, docs):
        rows = df.select("doc_id", "text").collect()
        short = [plain_fingerprint(r.text) for r in rows]
        want = sorted(zip([str(r.doc_id) for r in rows], short, map(str, plain_components([r.doc_id for r in rows], short)), strict=True))
        got = simhash_dedup.simhash_components(df).collect()
        assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want
    kept = simhash_dedup.representatives(odd, keep=["doc_id", "text"]).collect()
    rows = odd.collect()
    assert len(kept) == len(set(plain_components([r.doc_id for r in rows], [plain_fingerprint(r.text) for r in rows])))
    assert simhash_dedup.simhash_components(odd.limit(0)).count() == 0


def test_simhash_dense_groups(spark):
    """Fingerprints around a few centres, and random ones: no link is lost and cover holds."""
    rng = np.random.default_rng(5)
    from itertools import combinations

    assert len(simhash_dedup.COVER) == 20 and all(any(set(c) <= set(w) for c in simhash_dedup.COVER) for w in combinations(range(8), 4))
    fps = {int(x) for x in rng.integers(0, 1 << 63, 300)}
    for centre in list(fps)[:5]:
        for _ in range(120):
            x = centre
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    roots = {r.node % (1 << 64): r.root for r in simhash_dedup.components(simhash_dedup.edges(nodes)).collect()}
    want = plain_components(list(range(len(fps))), fps)
    groups = {}
    for f, w in zip(fps, want, strict=True):
        groups.setdefault(w, set()).add(roots.get(f, f"alone {f}"))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_toxicity(spark):
    base = "the quiet river runs past fields and old mills while people walk home in the evening"
    bad = ["idiot", "morons", "moronic", "fool"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        rows.append((i, f"{base} n{i} m{i % 37} " + (f"{bad[i % 4]} {bad[(i // 4) % 4]}" if toxic else "kind neighbour")))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (None, "idiot fool"), (9002, base * 500 + " you moronically"), (9003, base * 500)], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, labels[0], (None, 0, 1), (77777, 0, 1), (9001, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lab).collect()}
    assert all(got[i].predicted == t for i, _, t in labels)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(600))
    assert got[None].predicted == 1 and got[9002].predicted == 1 and got[9003].predicted == got[9000].predicted == got[9001].predicted == 0
    none = toxicity.toxicity(docs, lab.filter("toxic = 0")).first()
    assert none.predicted == 0
    assert toxicity.toxicity(docs.limit(0), lab).count() == 0


def test_toxicity_of_pairs_of_neutral_words(spark):
    """Each of four words is as frequent in either class; which two come together tells the class. Fitted from texts, seen on held-out rows."""
    rows, labels = [], []
    for i in range(1500):
        toxic, which = i % 5 == 0, i // 5 % 2
        filler = [f"word{(7 * i + 3 * k * k) % 41}" for k in range(12)]
        at = i % 9
        filler[at:at] = [("zarnak", "vulmo")[which], "the", ("folk", "gizmo")[which if toxic else 1 - which]]
        rows.append((i, " ".join(filler)))
        labels.append((i, 1, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, lab).filter("held_out").collect()
    assert {r.doc_id for r in got if r.predicted} == {r.doc_id for r in got if r.doc_id % 5 == 0}
    assert len(toxicity.fit(docs, lab, max_pairs=0).slots) == 0


def test_near_pairs_are_those_of_brute_force():
    texts = ["", "one", "one one", "a b c d e f g", "B a b a " * 4, "x " * 9 + "y z"]
    for text in texts:
        words = [next(iter(toxicity.slots(w))) for w in text.split()]
        want = {min(a, b) << toxicity.HASH_BITS | max(a, b) for i, a in enumerate(words) for b in words[i + 1 : i + 1 + toxicity.WINDOW] if a != b}
        assert toxicity.near_pairs(text).tolist() == sorted(want)


def test_toxic_pairs_learn_what_is_not_additive():
    """Two terms that are harmless alone and toxic together."""
    rng = np.random.default_rng(1)
    x = rng.random((800, 2)) < 0.5
    y = (x[:, 0] & x[:, 1]).astype(float)
    rows, cols = np.nonzero(x)
    b, w, v = toxicity._fit_machine(rows, cols, y, np.ones(len(y)), 2, 4, 500, 3)
    assert float((v[0] * v[1]).sum()) > 0
    m = toxicity.Machine(b, np.arange(2), w, v)
    assert m.margin(np.array([0, 1])) > 0 > max(m.margin(np.array([0])), m.margin(np.array([1])))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, accept them.</div><div id=main><div class="post">
<h2>Title &amp;&nbsp;more</h2><p>First paragraph, with <b>bold</b> and a <a href=x>link</a> in it &lt;ok&gt;.<p>Second
   one   here.<blockquote>Quoted words</blockquote>Bare text after<ul><li>one<li>two</ul><p>Short.</div>
<form><input value=1>Subscribe now please</form></div><aside>Related things to read</aside>
<section class="comments"><p>A reader comment that is rather long and dense with words, longer than anything else here, truly.</p></section>
<div class="ad">Buy this</div><footer>&copy; us</footer></body></html>"""


def test_html_text(spark):
    want = "Title & more\nFirst paragraph, with bold and a link in it <ok>.\nSecond one here.\nQuoted words\nBare text after\none\ntwo\nShort."
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "just text &amp; more"), (5, "u", "<p>open <b>never closed"), (6, "u", "<div" * 2000), (None, "u", "<p>" + "x " * 200_000)]
    got = {r.page_id: r for r in html_text.html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == want
    assert (got[2].text, got[3].text, got[4].text, got[5].text) == ("", "", "just text & more", "open never closed")
    assert len(got[None].text) == 399_999


def test_html_keeps_the_whole_article():
    """Lists of links in the article stay; names count as whole words, and not those of a wrapper of the page."""
    body = "".join(f"<p>Paragraph {i} of the article, long enough to count as its text.</p>" for i in range(6))
    refs = "<ul>" + "".join(f"<li><a href=/{i}>Source number {i}</a></li>" for i in range(5)) + "</ul>"
    plain = "\n".join([*(f"Paragraph {i} of the article, long enough to count as its text." for i in range(6)), *(f"Source number {i}" for i in range(5))])
    for names in ("", "class='content has-sidebar'", "class=no-comments", "id=post-header", "class='sidebar'", "class='content sidebar'"):
        page = f"<body><nav><a href=/>Home</a></nav><div {names}><article>{body}{refs}</article></div><div class='box sidebar'>Other news</div></body>"
        assert html_text.main_text(page) == plain, names
    assert html_text.main_text(f"<body><article>{body}{refs}<div class='x share'>Share it</div></article></body>") == plain


def test_html_density_decides():
    """Pages without article, main or telling names: the densest sum of blocks is the text, short link lists are not."""
    story = [f"Sentence {i} of the story goes on for a good while, so that it is text and not a label, as stories do." for i in range(8)]
    links = lambda n: "<div class=x><ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(n)) + "</ul></div>"
    for wrap in ("<div class=a>%s</div>", "<table><tr><td>%s</td></tr></table>", "<section><div><div>%s</div></div></section>"):
        page = f"<html><body>{links(12)}<div>{wrap % ''.join(f'<p>{s}</p>' for s in story)}</div>{links(20)}<div><p><a href=/c>Contact</a> <a href=/t>Terms</a></p></div></body></html>"
        assert html_text.main_text(page) == "\n".join(story), wrap


def test_html_odd_markup_is_linear():
    """Unclosed tags and quotes, long names, deep nests and stray closings take time in proportion to the page."""
    odd = ["<a b='", "<div ", '<p class="x', "<div><li>", "<div>", "</p><div>", "<button>", "<div class=sidebar>", "<!-- ", "<td><tr>", "aaaa ", "<x " + "a" * 50, "&amp", "<script>"]
    for part in odd:
        took = []
        for n in (4_000, 32_000):
            page = "<p>text</p>" + part * n
            began = time.process_time()
            html_text.main_text(page)
            took.append(time.process_time() - began)
        assert took[1] < 24 * took[0] + 1, part
    assert html_text.main_text("<p title=\"it's > that\">first words</p><p>5 < 6 and that is all") == "first words\n5 < 6 and that is all"


def test_html_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    got = {r.page_id: r.text for r in registry.QUERIES["op6_html_text"](spark, small).collect()}
    for r in pages:
        article = r.html[r.html.find("<article>") : r.html.find("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n".join(x for x in blocks if x)


def test_chat_query_hashes(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet").collect()
    got = {r.conv_id: r for r in registry.QUERIES["op2_chat_format"](spark, small).collect()}
    convs = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    convs[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(convs) and got[-7].valid and got[-7].end_state == "assistant"
    for k, turns in convs.items():
        assert got[k].turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns)) and got[k].loss_sha256 == sha("".join(b for a, b in turns if a == "assistant"))
