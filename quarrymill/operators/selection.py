"""Orders and selections under constraints: hits that may not rise, roles that a selection must have.

Both are worked out step by step on few rows: a query's hits, or a topic's selection and the best outsider of each role.
Spark finds these rows; what is folded in one place is bounded by the number of hits, or by the limit and the roles.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def guard(order: list[tuple[int, bool]]) -> list[int]:
    """(original rank from 1, guarded) in a new order, to original ranks in the order that the guards leave: the first
    guarded one above its original rank is put back to it, which moves others up by one, as often as there are hits at
    most; so of very many guarded ones some may still stand too high."""
    order = list(order)
    for _ in range(len(order)):
        high = next((k for k, (rank, guarded) in enumerate(order) if guarded and k + 1 < rank), None)
        if high is None:
            break
        item = order.pop(high)
        order.insert(min(item[0] - 1, len(order)), item)
    return [rank for rank, _ in order]


def guarded_rerank(hits: DataFrame, most: int) -> DataFrame:
    """(query_id, item, rank, new_rank, delta) of the first `most` hits of each query (query_id, item, rank, score,
    guarded): by falling score, ties by rank, but guarded hits (null: not) are put back to their place among these (guard).
    A null score is the lowest. delta is new_rank - place, negative for hits that rise."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item"))
    first = hits.where("query_id is not null").withColumn("place", place).where(F.col("place") <= most)
    rows = first.select("query_id", "item", "rank", "place", F.col("score").cast("double").alias("score"), F.coalesce("guarded", F.lit(False)).alias("guarded"))

    def ordered(group: pd.DataFrame) -> pd.DataFrame:
        by = group.sort_values(["score", "place"], ascending=[False, True], na_position="last", kind="stable")
        new = {rank: k + 1 for k, rank in enumerate(guard(list(zip(by["place"].tolist(), by["guarded"].tolist()))))}
        group["new_rank"] = [new[p] for p in group["place"]]
        return group[["query_id", "item", "rank", "place", "new_rank"]]

    kinds = dict(rows.dtypes)
    out = rows.groupBy("query_id").applyInPandas(lambda group: ordered(group), f"query_id {kinds['query_id']}, item {kinds['item']}, rank {kinds['rank']}, place int, new_rank int")
    return out.select("query_id", "item", "rank", "new_rank", (F.col("new_rank") - F.col("place")).alias("delta"))


def cover(selected: list[tuple], outsiders: list[tuple], roles: list[str], limit: int) -> tuple[list[tuple], list[tuple]]:
    """(kept, demoted) of rows (rank, role, score, pruned, ...): each required role that is missing takes its first
    outsider, if that is not pruned; a full selection gives up its lowest score for it, the earlier of equals."""
    selected, outsiders, demoted = list(selected), list(outsiders), []
    have = {row[1] for row in selected}
    for role in roles:
        found = None if role in have else next((row for row in [*outsiders, *demoted] if row[1] == role), None)
        if found is None or found[3]:
            continue
        (outsiders if found in outsiders else demoted).remove(found)
        if len(selected) >= limit:
            selected.sort(key=lambda row: row[2])
            demoted.append(selected.pop(0))
        selected.append(found)
        have.add(role)
    return sorted(selected, key=lambda row: row[0]), demoted


def covering_selection(candidates: DataFrame, roles: list[str], limit: int) -> DataFrame:
    """(topic, item, rank, role, verdict) of each topic's selection: the first `limit` candidates that are not pruned, in
    order of rank, and for each required role that they lack its first other candidate, in place of the lowest score if
    the selection is full. verdict: kept, added or demoted.

    candidates: topic, item, rank (unique in a topic), role, score, pruned; null roles are the empty one, null scores 0,
    null pruned false. A role's first outsider decides: if it is pruned, the role stays missing. A topic of more
    candidates than limit and roles sends no more than these to one place."""
    rows = candidates.where("topic is not null").select(
        "topic", "item", "rank", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.coalesce("pruned", F.lit(False)).alias("pruned")
    )
    sound = rows.where("not pruned").withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy("rank")))
    chosen = sound.where(F.col("n") <= limit).select("topic", "item", "rank", "role", "score", "pruned", F.lit(True).alias("chosen"))
    others = sound.where(F.col("n") > limit).drop("n").unionByName(rows.where("pruned")).where(F.col("role").isin(*roles))
    firsts = others.withColumn("n", F.row_number().over(Window.partitionBy("topic", "role").orderBy("rank"))).where("n = 1").drop("n").withColumn("chosen", F.lit(False))
    kinds = dict(rows.dtypes)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", kind="stable")
        as_rows = lambda g: list(zip(g["rank"].tolist(), g["role"], g["score"].tolist(), g["pruned"].tolist(), g["item"]))
        before = as_rows(group[group["chosen"]])
        kept, gone = cover(before, as_rows(group[~group["chosen"]]), roles, limit)
        out = [(r, "kept" if r in before else "added") for r in kept] + [(r, "demoted") for r in gone if r in before]
        return pd.DataFrame([(group["topic"].iloc[0], r[4], r[0], r[1], verdict) for r, verdict in out], columns=["topic", "item", "rank", "role", "verdict"])

    return chosen.unionByName(firsts).groupBy("topic").applyInPandas(lambda group: fold(group), f"topic {kinds['topic']}, item {kinds['item']}, rank {kinds['rank']}, role string, verdict string")
