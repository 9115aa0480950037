"""From raw documents to token counts, stage by stage; each stage's table is written and read again by the next.

No SQL: learnt scores, fingerprints and byte-pair merges have none, so the pipeline is tested stage by stage.

In every stage null and empty texts are alike, very long texts are taken whole, rows without an id and rows that share
one are documents of their own, extra columns stay whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import bpe, mixing, simhash, suffix, toxicity
from quarrymill.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model of this corpus rejects are left out. Texts without hits stay, null and empty
    ones among them; repeated rows go or stay together; without labels every row stays."""
    return toxicity.without_toxic(docs, toxicity.model_for(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least id, rows without an id last, and of rows
    that share an id the one numbered first. Null and empty texts are one group. Different texts of one id all stay."""
    return simhash.keep_one(docs, Scratch(spark, "simhash"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that an earlier document has are cut out of texts; no row goes, a text may become
    empty. Null ids come first, rows that share an id in the order of a kept table; null texts become empty."""
    return suffix.without_repeats(docs, Scratch(spark, "suffix"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, 3 times at most. A null source is a source; texts without
    words, null ones among them, are left out."""
    return mixing.mixed(docs, Scratch(spark, "mixing"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left, a row for each; null and empty texts have no tokens."""
    codec = bpe.BytePairCodec(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(docs.select("doc_id", "text"), codec)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("tokens", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
