"""Constrained orders and selections of documents. Each step depends on the last, so they are tested against plain loops
and have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators import selection as S
from ..sources.tables import table
from .memory import shared_words

ROLES = ["src17", "src18", "src19"]


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


def guarded_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best documents for the shared words of every document whose id is divisible by 100, anew by how many of
    their words are asked for; documents labelled toxic do not rise."""
    docs = table(spark, d, "documents")
    asked = shared_words(docs).select("query_id", F.split("query", " ").alias("terms"))
    hits = R.top(R.linear(docs, "doc_id", "text", asked).where("doc_id <> query_id"), ["query_id"], [F.desc("score"), "doc_id"], 20).drop("score")
    words = docs.select("doc_id", T.tokens(F.col("text")).alias("w")).join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    dense = hits.join(asked, "query_id").join(words, "doc_id").withColumn("score", F.size(F.filter("w", lambda w: F.array_contains("terms", w))) / F.greatest(F.lit(1), F.size("w")))
    rows = dense.join(_labels(spark, d), "doc_id", "left").select("query_id", F.col("doc_id").alias("item"), "rank", "score", (F.col("toxic") == 1).alias("guarded"))
    return S.guarded_rerank(rows, 20)


def covering_selection(spark: SparkSession, d: str) -> DataFrame:
    """Twelve documents of each language, long ones first, with one at least of each of three sources; toxic ones are
    pruned, and quality and length decide which give way."""
    docs = table(spark, d, "documents").where("lang is not null and doc_id is not null").join(_labels(spark, d), "doc_id", "left")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    score = F.coalesce("quality", F.lit(0)) + F.col("n_chars") / 1_000_000
    return S.covering_selection(docs.select(F.col("lang").alias("topic"), F.col("doc_id").alias("item"), rank.alias("rank"), F.col("source").alias("role"), score.alias("score"), (F.col("toxic") == 1).alias("pruned")), ROLES, 12)


QUERIES = {"guarded_rerank": (guarded_rerank, None), "covering_selection": (covering_selection, None)}
