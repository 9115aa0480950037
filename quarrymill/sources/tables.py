"""Reading and keeping tables: scans, keep-latest upserts, deletes and sequenced appends as whole-table rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; time stamps without zone become UTC time stamps, as streams and windows need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def matches(filters: dict) -> Column:
    """Equality over several columns; null equals null."""
    out = F.lit(True)
    for name, value in filters.items():
        out = out & F.col(name).eqNullSafe(F.lit(value))
    return out


def merge_filters(base: dict | None, extra: dict | None) -> dict:
    """The extra filter overrides the same column."""
    return {**(base or {}), **(extra or {})}


def upsert(stored: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Keep-latest by `order`; a change wins a tie."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank", "_new")


def delete_where(stored: DataFrame, filters: dict) -> DataFrame:
    return stored.where(~matches(filters))


def sequenced(rows: DataFrame, aggregate: str, *order: str) -> DataFrame:
    """A running number within each aggregate."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(aggregate).orderBy(*order)))


def store_diff(active: DataFrame, backup: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's side: active_only, backup_only, changed or same; values compare null-safely."""
    a, b = active.select(key, F.col(value).alias("a"), F.lit(1).alias("in_a")), backup.select(key, F.col(value).alias("b"), F.lit(1).alias("in_b"))
    side = (
        F.when(F.col("in_b").isNull(), "active_only").when(F.col("in_a").isNull(), "backup_only")
        .when(~F.col("a").eqNullSafe(F.col("b")), "changed").otherwise("same")
    )
    return a.join(b, key, "full_outer").select(key, side.alias("side"))
