"""Labelled samples of bounded size for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def fold(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo `of`; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, of: int, held_out: int, most_rows: int, scratch: Scratch) -> DataFrame:
    """(text, label) of at most most_rows labelled documents outside the held-out fold, in the order of a hash of
    their ids; kept, so that every later pass reads the sample alone. Only ids and labels are ranked, with a limit in
    each task, and the ids left are few enough to be sent to every task that reads texts.

    Several labels of an id are averaged; null ids and null labels teach nothing. An id that is there more than once
    gives one text, the least by hash, chosen where the texts are before any is shuffled; a null text is empty."""
    learnt = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), of) != held_out))
        .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(learnt), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    parts = 2 * docs.sparkSession.sparkContext.defaultParallelism  # a small table, but its texts are worked on at length
    return scratch.keep(found.select("text", "label").repartition(parts), "sample")
