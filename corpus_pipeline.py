"""The corpus pipeline: documents through the stages below, each written and read again.

Each stage works on all that the one before it kept: documents that fail the quality rules go, toxic ones go, of
each group of near-duplicates one stays, the sources are mixed to their target weights, and what is left is
encoded. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import _common as c
from tracelode.llm import byte_bpe, quality_rules, simhash_dedup, source_mix, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(docs, keep=COLUMNS).filter("kept").select(COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(docs, c.table(spark, sf_dir, "labels"), keep=COLUMNS).filter("predicted = 0").select(COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.representatives(docs, keep=COLUMNS).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs, COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("toxicity", clean), ("near_dedup", dedup), ("mix", mix), ("byte_bpe", encode)]
#: SQL has neither the fingerprints nor the models of these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = c.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
