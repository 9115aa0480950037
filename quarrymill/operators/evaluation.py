"""Retrieval metrics, gates and deltas over judged rows (query, rank, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision_at_k(rows: DataFrame, query: str, rank: str, label: str, k: int, groups: list[str]) -> DataFrame:
    """Per group: mean over queries of the share of labelled results in the first k that are good, and of whether one
    of the first three is. Queries without any label count as 0; unlabelled results count neither way."""
    first, labelled = F.col(rank) <= k, F.col(label).isNotNull()
    good = (F.col(label) == 1).cast("int")
    each = rows.groupBy(*groups, query).agg(
        F.coalesce(F.avg(F.when(first & labelled, good)), F.lit(0.0)).alias("p"),
        F.coalesce(F.max(F.when((F.col(rank) <= 3) & labelled, good)), F.lit(0)).alias("h"),
    )
    return each.groupBy(*groups).agg(F.count("*").alias("queries"), F.round(F.avg("p"), 6).alias("precision_at_k"), F.round(F.avg("h"), 6).alias("hit_at_3"))


def rates(rows: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """Rates of each flag over the rows where it is known, for every value of `by` and for all ('all')."""
    shown = [F.round(F.avg(flag.cast("int")), 6).alias(name) for name, flag in flags.items()]
    out = rows.rollup(by).agg(F.grouping(by).alias("_all"), F.count("*").alias("n"), *shown)
    return out.withColumn(by, F.when(F.col("_all") == 1, "all").otherwise(F.col(by))).drop("_all")


def gate(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds the names of failed checks and whether all hold."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]))
    return row.withColumn("failed", F.array_join(failed, ",")).withColumn("passed", F.size(failed) == 0)


def delta(candidate: DataFrame, baseline: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Percentage points that each metric gains over the baseline, rounded to 3 places."""
    base = baseline.select(by, *[F.col(m).alias(f"_{m}") for m in metrics])
    return candidate.join(base, by, "full_outer").select(by, *[F.round((F.col(m) - F.col(f"_{m}")) * 100, 3).alias(f"{m}_delta") for m in metrics])


#: Limits of the answer stage.
STAGE_B_LIMITS = {"answerable": 0.01, "non_substantive": 0.30, "grounded": 0.30, "good_or_partial": 0.70, "wrong_era": 0.20, "abstention": 0.80}


def answer_stage(rows: DataFrame, by: str) -> DataFrame:
    """Of judged answers (top1, answerable, substantive, temporal, abstains, wrong_era, must_abstain: booleans; grounded:
    long; label: good, partial, bad or null), for every value of `by`: rates over the rows that each concerns, 0 where
    there are none, and whether all limits hold. Rates of judgements are over rows with a result and a label."""
    top, judged = F.col("top1"), F.col("top1") & F.col("label").isNotNull()
    parts = {
        "answerable": (top, F.col("answerable")), "non_substantive": (top, ~F.col("substantive")), "grounded": (top & F.col("temporal"), F.col("grounded") > 0),
        "good_or_partial": (judged, F.col("label").isin("good", "partial")), "wrong_era": (judged & F.col("temporal"), F.col("wrong_era")),
        "abstention": (judged & F.col("must_abstain"), F.col("abstains")),
    }
    sums = rows.groupBy(by).agg(*[F.count_if(among).alias(f"_n_{k}") for k, (among, _) in parts.items()], *[F.count_if(among & yes).alias(f"_y_{k}") for k, (among, yes) in parts.items()])
    rate = {k: F.round(F.when(F.col(f"_n_{k}") > 0, F.col(f"_y_{k}") / F.col(f"_n_{k}")).otherwise(0.0), 6) for k in parts}
    most = {"non_substantive", "wrong_era"}
    holds = [(F.col(f"_n_{k}") > 0) & ((rate[k] <= limit) if k in most else (rate[k] >= limit)) for k, limit in STAGE_B_LIMITS.items()]
    whole = holds[0]
    for h in holds[1:]:
        whole = whole & h
    return sums.select(by, F.col("_n_answerable").alias("results"), F.col("_n_good_or_partial").alias("judged"), *[c.alias(k) for k, c in rate.items()], whole.alias("passed"))
