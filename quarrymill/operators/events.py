"""Event logs: state as of a time, day spines and streaks, sessions, windows, idempotent records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_at(events: DataFrame, entity: str, at: str, order: str, until: str, removed: Column) -> DataFrame:
    """The last event of each entity up to a time, of entities whose last event does not remove them."""
    last = events.where(F.col(at) <= F.lit(until).cast("timestamp")).groupBy(entity).agg(F.max_by(F.struct("*"), F.struct(at, order)).alias("s"))
    return last.select("s.*").where(~removed)


def day_spine(days: DataFrame, day: str) -> DataFrame:
    """Every day from the first to the last."""
    ends = days.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi")).alias(day))


def streaks(rows: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """Longest run of consecutive rows where flag holds, within `by`."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = rows.withColumn("_f", flag.cast("int")).withColumn("_g", F.sum(1 - F.col("_f")).over(w))
    runs = marked.groupBy(*by, "_g").agg(F.sum("_f").alias("run"))
    return runs.groupBy(*by).agg(F.max("run").alias("longest"))


def sessions(events: DataFrame, by: str, at: str, order: str, gap_seconds: int) -> DataFrame:
    """Adds `session`, counted from 1, which grows after a pause longer than the gap."""
    w = Window.partitionBy(by).orderBy(at, order)
    pause = F.col(at).cast("double") - F.lag(F.col(at).cast("double")).over(w)
    return events.withColumn("_new", F.when(pause.isNull() | (pause > gap_seconds), 1).otherwise(0)).withColumn("session", F.sum("_new").over(w)).drop("_new")


def fresh_runs(runs: DataFrame, key: list[str], order: list, status: str) -> DataFrame:
    """First run of each request that is allowed: a run is refused if an earlier one started or completed."""
    blocks = F.col(status).isin("started", "completed").cast("int")
    before = F.max(blocks).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("fresh", F.coalesce(before, F.lit(0)) == 0)


def trend(series: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Latest, previous, change, direction and extremes of a series."""
    w = Window.partitionBy(*by).orderBy(order)
    lagged = series.withColumn("_p", F.lag(value).over(w))
    out = lagged.groupBy(*by).agg(F.max_by(value, order).alias("latest"), F.max_by("_p", order).alias("previous"), F.min(value).alias("least"), F.max(value).alias("most"))
    delta = F.round(F.col("latest") - F.col("previous"), 6)
    return out.withColumn("delta", delta).withColumn("direction", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("flat"))
