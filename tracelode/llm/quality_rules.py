"""Quality rules by distribution divergence, in DataFrame functions only.

Each document gives two histograms: its code points by character class, and its words by a short list of
common words of its language (the last bin holds all other words). The same histograms, summed over all
documents of a language that pass the base rules, are that language's reference. A document is kept if its
Jensen-Shannon distances (base 2, 0 to 1) to the reference stay within limits. Each distance counts only
where the document is long enough for its histogram to mean something; shorter ones pass that test.

One pass reads the texts and writes a narrow row for each document to the shared folder; the references are
one row for each language listed, so the join back is a broadcast whose size the language list bounds.

Defined cases: null or empty text has no words and fails the base rules. A language that is null or not in
LANGUAGES is compared with the sum over all languages, by character class only. An empty table gives an empty
table. Repeated rows are judged one by one. Columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: Common words of each language, most frequent function words of ordinary prose.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "pas", "ce"],
}

#: Character classes counted by pattern; white space and all other characters are two further bins.
CLASSES = [r"[^\p{Ll}]+", r"[^\p{Lu}]+", r"[^\p{Nd}]+", r"""[^.,;:!?'"()\-]+"""]
SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    #: A distance is too far beyond limit + slack / sqrt(length), the noise of a short histogram being of that
    #: order, and counts from a least length on; lengths are code points for classes and words for words.
    class_limit: float = 0.14
    class_slack: float = 2.8
    min_class_chars: int = 200
    word_limit: float = 0.24
    word_slack: float = 0.6
    min_words_for_words: int = 100
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)


def _count(text: Column, all_but: str) -> Column:
    return F.length(F.regexp_replace(text, all_but, "")).cast("long")


def _sum(values: Column, zero: Column) -> Column:
    return F.aggregate(values, zero, lambda a, x: a + x)


def repeat_words(words: str, n: str, width: int, df: DataFrame) -> DataFrame:
    """df with n_repeat_words: words in windows of ``width`` words that occur twice or more in the text.

    Windows are compared by 64-bit hash. Texts without a repeated hash, nearly all, stop after one pass.
    """
    df = df.withColumn("_h", F.when(F.col(n) >= width, F.transform(F.sequence(F.lit(1), F.col(n) - (width - 1)), lambda i: F.xxhash64(F.slice(F.col(words), i, width)))).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(some, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_s")
    same = lambda x, at: F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    p = F.col("_p")
    steps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
    return df.withColumn("n_repeat_words", F.coalesce(_sum(steps, F.lit(0)), F.lit(0)).cast("long")).drop("_h", "_s", "_p")


def features(docs: DataFrame, rules: Rules = Rules(), keep: Sequence[str] = ()) -> DataFrame:
    """A row for each document: the base counts and its two histograms, narrow unless columns are to be kept."""
    n_list = {lang: F.array(*map(F.lit, ws)) for lang, ws in rules.common_words.items()}
    common = F.lit(None).cast("array<string>")
    for lang, ws in n_list.items():
        common = F.when(F.col("lang") == lang, ws).otherwise(common)
    kept = [f"_keep_{k}" for k in keep]
    df = docs.select(*[F.col(k).alias(f"_keep_{k}") for k in keep], F.col("doc_id"), F.when(F.col("lang").isin(list(rules.common_words)), F.col("lang")).alias("lang"), c.text_or_empty("text").alias("_t"))
    df = df.withColumn("_w", c.words(F.col("_t"))).withColumn("n_words", F.size("_w").cast("long"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(c.BLANKS)) != "")
    df = df.withColumn("_lines", lines)
    df = df.withColumn("_c", F.filter(F.transform("_w", F.lower), lambda w: F.array_contains(common, w)))
    df = repeat_words("_w", "n_words", rules.repeat_window, df.withColumn("n_words", F.col("n_words").cast("int")))
    t = F.col("_t")
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    df = df.withColumn("_k", F.array(*[_count(t, p) for p in CLASSES], (F.length(t) - F.col("word_chars")).cast("long")))
    c_words = F.col("_c")
    hist = F.transform(common, lambda r: (F.size(c_words) - F.size(F.array_remove(c_words, r))).cast("long"))
    return df.select(
        *kept, "doc_id", "lang", F.col("n_words").cast("long").alias("n_words"), "word_chars",
        _count(t, SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.concat("_k", F.array(F.length(t).cast("long") - _sum(F.col("_k"), F.lit(0).cast("long")))).alias("classes"),
        F.concat(hist, F.array((F.col("n_words") - F.size(c_words)).cast("long"))).alias("commons"),
    ).withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))


def references(feats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each language of the rules (and null: all documents): its two summed histograms."""
    n_common = max(map(len, rules.common_words.values())) + 1
    sums = lambda name, n: F.array(*[F.coalesce(F.sum(F.get(name, F.lit(i))), F.lit(0).cast("long")) for i in range(n)])
    return feats.filter(~F.col("base_failed")).cube("lang").agg(sums("classes", len(CLASSES) + 2).alias("ref_classes"), sums("commons", n_common).alias("ref_commons"), F.grouping("lang").alias("_all"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; null if either is null or sums to zero."""
    zero = F.lit(0).cast("long")
    share = lambda a: F.transform(a, lambda x: x / F.nullif(_sum(a, zero), zero))
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(share(p), share(q), lambda a, b: 0.5 * part(a, (a + b) / 2) + 0.5 * part(b, (a + b) / 2))
    total = _sum(terms, F.lit(0.0))
    return F.when(total.isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0))))


def judge(feats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    refs = references(feats, rules)
    known = refs.filter((F.col("_all") == 0) & F.col("lang").isNotNull()).select("lang", "ref_classes", "ref_commons")
    overall = refs.filter(F.col("_all") == 1).select(F.col("ref_classes").alias("all_classes"))
    # Both sides hold at most one row for each language listed in the rules.
    df = feats.join(F.broadcast(known), "lang", "left").join(F.broadcast(overall), how="left")
    n_chars = _sum(F.col("classes"), F.lit(0).cast("long"))
    df = df.withColumn("class_distance", F.when(n_chars >= rules.min_class_chars, js_distance(F.col("classes"), F.coalesce("ref_classes", "all_classes"))))
    df = df.withColumn("word_distance", F.when(F.col("n_words") >= rules.min_words_for_words, js_distance(F.col("commons"), F.slice("ref_commons", F.lit(1), F.greatest(F.size("commons"), F.lit(0))))))
    beyond = lambda distance, limit, slack, n: F.coalesce(F.col(distance) > limit + slack / F.sqrt(n), F.lit(False))
    far = beyond("class_distance", rules.class_limit, rules.class_slack, n_chars) | beyond("word_distance", rules.word_limit, rules.word_slack, F.col("n_words"))
    return df.withColumn("kept", ~F.col("base_failed") & ~far)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the two distances for each row of docs; or, with columns to keep, these and kept."""
    judged = judge(c.written(features(docs, rules, keep), "quality-features"), rules)
    if keep:
        return judged.select(*[F.col(f"_keep_{k}").alias(k) for k in keep], "kept")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def _oracle(rules: Rules = Rules()) -> str:
    blanks = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    common = "CASE lang " + " ".join(f"WHEN '{lang}' THEN {listed(ws)}" for lang, ws in rules.common_words.items()) + " END"
    count = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
    inner = [p.replace("[^", "[").removesuffix("+").replace("'", "''") for p in [*CLASSES, SYMBOLS]]
    width, n_common = rules.repeat_window, max(map(len, rules.common_words.values())) + 1
    distance = lambda p, q: f"(SELECT sqrt(greatest(sum(0.5 * CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + 0.5 * CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END), 0)) FROM (SELECT x / nullif(list_sum({p}), 0) AS a, y / nullif(list_sum({q}), 0) AS b FROM (SELECT unnest({p}) AS x, unnest({q}) AS y)))"
    sums = lambda name, n: "[" + ", ".join(f"coalesce(sum({name}[{i + 1}]), 0)" for i in range(n)) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IN {tuple(rules.common_words)} THEN lang END AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, CASE WHEN trim(t, {blanks}) = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(trim(t, {blanks}), '[\\x20\\x09-\\x0D]+') END AS w, {common} AS common FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + {width - 1}], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - {width - 2})) AS i FROM w)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
rep AS (SELECT rid, sum(step) AS n FROM (SELECT rid, least({width}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {width})) AS step FROM twice) GROUP BY rid),
f AS (SELECT w.rid, doc_id, lang, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {count(inner[-1])} AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: trim(x, {blanks}) <> '')) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: trim(x, {blanks}) <> ''))) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, common, list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains(common, x)) AS c FROM w LEFT JOIN rep USING (rid)),
g AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
  [{", ".join(count(p) for p in inner[:-1])}, length(t) - word_chars] AS k, CASE WHEN common IS NOT NULL THEN list_append(list_transform(common, lambda r: len(list_filter(c, lambda x: x = r))), n_words - len(c)) END AS commons FROM f),
h AS (SELECT *, list_append(k, length(t) - list_sum(k)) AS classes FROM g),
refs AS (SELECT lang, grouping(lang) AS every, {sums("classes", len(CLASSES) + 2)} AS ref_classes, {sums("commons", n_common)} AS ref_commons FROM h WHERE NOT base_failed GROUP BY CUBE (lang)),
j AS (SELECT h.*, {distance("classes", "coalesce(r.ref_classes, o.ref_classes)")} AS cd, CASE WHEN commons IS NOT NULL THEN {distance("commons", "r.ref_commons")} END AS wd
  FROM h LEFT JOIN (SELECT * FROM refs WHERE every = 0 AND lang IS NOT NULL) r ON h.lang = r.lang LEFT JOIN (SELECT * FROM refs WHERE every = 1) o ON true)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (length(t) >= {rules.min_class_chars} AND coalesce(cd > {rules.class_limit} + {rules.class_slack} / sqrt(length(t)), false))
  AND NOT (n_words >= {rules.min_words_for_words} AND coalesce(wd > {rules.word_limit} + {rules.word_slack} / sqrt(n_words), false)) AS kept
FROM j"""


ORACLE = _oracle()


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(c.table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")
