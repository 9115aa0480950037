"""Learning graphs: edges from relations and claims, and groups of nodes that need one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Predicate, kind of edge, whether it is turned round, least confidence.
RELATION_RULES = (
    ("requires", "prerequisite", True, 0.85), ("part_of", "recommended_before", False, 0.60), ("enables", "recommended_before", False, 0.70),
    ("improves", "builds_on", False, 0.55), ("example_of", "example_of", False, 0.55),
)
#: Wording of a claim, kind of edge from object to subject, least confidence.
CLAIM_RULES = ((r"(?i)\bbuilds on\b", "builds_on", 0.62), (r"(?i)\brequires?\b|\bneeded for\b|\brequired for\b", "prerequisite", 0.76))


def relation_edges(relations: DataFrame) -> DataFrame:
    """relations (source, target, predicate, confidence) as edges (source, target, edge_type, confidence); predicates
    without a rule, missing ends and loops give none."""
    p, rule = F.col("predicate"), F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit(False).alias("turned"), F.lit(0.0).alias("least")))
    for name, kind, turned, least in RELATION_RULES:
        rule = rule.when(p == name, F.struct(F.lit(kind).alias("kind"), F.lit(turned).alias("turned"), F.lit(least).alias("least")))
    edges = relations.withColumn("_r", rule).where("_r is not null and source <> target")
    turned = F.col("_r.turned")
    return edges.select(
        F.when(turned, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(turned, F.col("source")).otherwise(F.col("target")).alias("target"),
        F.col("_r.kind").alias("edge_type"), F.least(F.lit(1.0), F.greatest(F.coalesce("confidence", F.lit(0.5)), F.col("_r.least"))).alias("confidence"),
    )


def claim_edges(claims: DataFrame) -> DataFrame:
    """claims (subject, object, text, confidence) as edges from object to subject, one for each wording that is found."""
    found = [F.when(F.col("text").rlike(pattern), F.struct(F.lit(kind).alias("edge_type"), F.lit(least).alias("least"))) for pattern, kind, least in CLAIM_RULES]
    hit = claims.where("subject <> object").select("subject", "object", "confidence", F.explode(F.array_compact(F.array(*found))).alias("r"))
    return hit.select(F.col("object").alias("source"), F.col("subject").alias("target"), "r.edge_type", F.greatest(F.coalesce("confidence", F.lit(0.5)), F.col("r.least")).alias("confidence"))


def strong_components(closed: DataFrame, nodes: DataFrame, a: str, b: str, node: str) -> DataFrame:
    """node, component (the least node of those that reach each other), from a closure (a reaches b)."""
    back = closed.select(F.col(b).alias(a), F.col(a).alias(b))
    mutual = closed.select(a, b).join(back, [a, b]).groupBy(F.col(a).alias("_n")).agg(F.min(b).alias("_m"))
    return nodes.join(mutual, nodes[node] == mutual["_n"], "left").select(node, F.least(node, F.coalesce("_m", node)).alias("component"))


def resolve_links(notes: DataFrame, links: DataFrame) -> DataFrame:
    """notes (id, path, stem, alias) and links (id, key) as (id, target): the note of that path, else the only one with
    the key's last part as stem, else the only one with that alias. Links that name no single note are left out."""
    only = lambda c: notes.groupBy(F.col(c).alias("_k")).agg(F.count_distinct("id").alias("_n"), F.min("id").alias(f"_{c}")).where("_k is not null and _k <> '' and _n = 1").drop("_n")
    path = notes.groupBy(F.col("path").alias("_k")).agg(F.min("id").alias("_path"))
    stems = links.withColumn("_s", F.element_at(F.split("key", "/"), -1))
    found = stems.join(path, stems["key"] == path["_k"], "left").drop("_k")
    for name, on in (("stem", "_s"), ("alias", "key")):
        side = only(name)
        found = found.join(side, found[on] == side["_k"], "left").drop("_k")
    return found.select("id", F.coalesce("_path", "_stem", "_alias").alias("target")).where("target is not null").distinct()
