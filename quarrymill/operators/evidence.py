"""Evidence of a query: what is kept of it, and how much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedupe(rows: DataFrame, by: str, rank: str, key: str, family: str) -> DataFrame:
    """rows in order of rank, without those whose key or family an earlier row that stayed has. What a dropped row has
    does not drop later ones, so the rows of one query, a bounded number, are walked through in one array."""
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(rank, key, family))).alias("_all"))
    none = F.filter("_all", lambda x: F.lit(False))
    seen = lambda kept, x: F.exists(kept, lambda k: (k[key] == x[key]) | (k[family] == x[family]))
    kept = F.aggregate("_all", none, lambda acc, x: F.when(F.coalesce(seen(acc, x), F.lit(False)), acc).otherwise(F.concat(acc, F.array(x))))
    return listed.select(by, F.explode(kept).alias("_k")).select(by, f"_k.{rank}", f"_k.{key}", f"_k.{family}")


def most_sources(source_type: Column, intent: Column) -> Column:
    """How many pieces of evidence an answer takes: fewer from papers, fewest where a paper explains a concept."""
    return F.when((source_type == "paper") & (intent == "definition"), 2).when(source_type == "paper", 4).when(intent.isin("comparison", "implementation"), 5).otherwise(6)
