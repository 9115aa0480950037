"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by the set of sources they belong to. Word capacity flows from these patterns to source
quotas; repeating a pattern's words costs more with each repetition, so the cheapest flow repeats as little as it can.
Documents are then selected in a seeded order until their pattern's share is filled.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, numbered

#: Cost of a word taken for the first, second, third time.
REPEAT_COST = (0.0, 1.0, 3.0)
WEIGHTS = (5.0, 2.0, 1.0)
WORDS = r"[^\x20\x09-\x0D]+"
#: Quotas are cut by sums over ever longer prefixes of the seeded order, which leave so many bits, until a pattern has
#: at most SORTED documents of the prefix to be sorted.
SHIFTS, SORTED = (50, 40, 31, 20, 10, 0), 10_000


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def placed(names: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """names (different values of one column) with `place`, their position by code point, null last. Ranges are sorted
    in their own tasks; the driver sees a count of each."""
    sorted_ = names.orderBy(F.asc_nulls_last(column)).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = scratch.keep(sorted_.withColumn("_part", F.shiftright("_at", 33)), "places")
    ahead, rows = 0, []
    for r in sorted_.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("least")).orderBy("_part").collect():  # a row for each range
        rows.append((r["_part"], ahead - r["least"]))
        ahead += r["n"]
    shift = names.sparkSession.createDataFrame(rows, "_part long, _shift long")
    return sorted_.join(F.broadcast(shift), "_part").select(column, (F.col("_at") + F.col("_shift")).alias("place"))


def targets(own: DataFrame, total: int, most_repeats: int = 3) -> DataFrame:
    """own (words, weight, ...) with `target`: total shared out by weight, no target above most_repeats times the words
    and the excess shared out again. Each round is one sum over the table; sums of words and of whole weights are exact."""
    level, capped, over = 0.0, -1, F.lit(False)
    while True:
        r = own.agg(F.sum(F.when(over, F.col("words") * most_repeats)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if r[2] == capped or not r[1]:
            break
        capped, level = r[2], (total - (r[0] or 0)) / r[1]
        over = F.lit(level) * F.col("weight") > F.col("words") * most_repeats
    return own.withColumn("target", F.when(over, (F.col("words") * most_repeats).cast("double")).otherwise(F.lit(level) * F.col("weight")))


def cheapest_flow(capacity: dict, quota: dict, costs=REPEAT_COST) -> dict:
    """capacity: words of each pattern (a tuple of sources). quota: words of each source. Returns {(pattern, source):
    words} of largest flow and, among these, least cost, each pattern's words being usable len(costs) times at rising
    cost. Successive shortest paths with node potentials."""
    return _flow([p for p in capacity if p], capacity, quota, costs)


def _flow(patterns: list, capacity: dict, quota: dict, costs) -> dict:
    arcs: list[list] = []  # to, room, cost
    leaving: dict = {}

    def arc(a, b, room, cost):
        for x, y, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            leaving.setdefault(x, []).append(len(arcs))
            arcs.append([y, r, c])

    between = {}
    for p in patterns:
        for cost in costs:
            arc("in", ("p", p), float(capacity[p]), cost)
        for s in p:
            between[p, s] = len(arcs)
            arc(("p", p), ("s", s), float("inf"), 0.0)
    for s in sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s)):
        arc(("s", s), "out", float(quota.get(s, 0.0)), 0.0)
    height = dict.fromkeys(leaving, 0.0)
    while True:
        far, via, queue, k = {"in": 0.0}, {}, [(0.0, 0, "in")], 0
        while queue:
            d, _, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in leaving[x]:
                y, room, cost = arcs[e]
                new = d + cost + height[x] - height[y]
                if room > 1e-6 and new < far.get(y, float("inf")) - 1e-12:
                    far[y], via[y], k = new, e, k + 1
                    heapq.heappush(queue, (new, k, y))
        if "out" not in far:
            return {key: arcs[e + 1][1] for key, e in between.items()}
        for x in height:
            height[x] += far.get(x, far["out"])
        path, x = [], "out"
        while x != "in":
            path.append(via[x])
            x = arcs[via[x] ^ 1][0]
        much = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= much
            arcs[e ^ 1][1] += much


def _flows(arcs: DataFrame, scratch: Scratch) -> DataFrame:
    """arcs (p, words, place, target): a row for each source of each pattern. Returns (p, flow): the words that the
    cheapest flow takes of the pattern. Patterns that a chain of shared sources joins are solved together, in one task;
    others, single sources included, are solved apart."""
    heads = arcs.groupBy("p").agg(F.min("place").alias("head"))
    edges = arcs.join(heads, "p").where("place <> head").select(F.col("place").alias("u"), F.col("head").alias("v"))
    linked = components(edges, scratch).select(F.col("node").alias("place"), "component")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sources, capacity = {}, {}
        for p, words, place in zip(pdf["p"], pdf["words"], pdf["place"]):
            sources.setdefault(p, []).append(place)
            capacity[p] = words
        key = {p: tuple(sorted(s)) for p, s in sorted(sources.items())}
        taken = dict.fromkeys(key, 0.0)
        back = {k: p for p, k in key.items()}
        for (k, _), words in cheapest_flow({k: capacity[p] for p, k in key.items()}, dict(zip(pdf["place"], pdf["target"]))).items():
            taken[back[k]] += words
        return pd.DataFrame({"p": list(taken), "flow": list(taken.values())})

    together = arcs.join(linked, "place", "left").withColumn("component", F.coalesce("component", "place"))
    return together.groupBy("component").applyInPandas(solve, "p string, flow double")


def mix(docs: DataFrame, key: str, sources: str, size: str, scratch: Scratch, seed: str = "mix", weights=WEIGHTS, most_repeats: int = 3) -> DataFrame:
    """Adds to docs (columns key, sources: array of names, size: words; others are kept, whatever their names) the columns
    `pattern_size`, `target` (the summed targets of the document's sources) and `taken` (words taken, repeats counted),
    in place of columns so named.

    Weights repeat over the sources in code point order, null last; the targets share out all words. Within a pattern
    every document is taken as often as the flow fills whole rounds, the first documents in the order of a seeded hash
    once more, and one closing document whose size comes nearest to what is then missing. The order's quota is cut by
    sums over prefixes of the order, so that no pattern is sorted as a whole; documents of one key are told apart by
    their row. Documents of size 0 are taken as 0 words; documents with no source take no part and are taken as 0; a
    null key is hashed as an empty one; an empty table gives an empty one."""
    made = ("pattern_size", "target", "taken")
    half = lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long")
    kept = docs.select(
        F.struct(*[c for c in docs.columns if c not in made]).alias("_kept"), F.col(key).cast("string").alias("_key"), F.col(size).alias("_size"),
        F.array_sort(F.array_distinct(sources)).alias("_sources"), F.monotonically_increasing_id().alias("_row"),
    )
    first, second = half(F.concat_ws(":", F.lit(seed), "_key")), half(F.concat_ws(":", F.lit(seed), "_key", "_row"))
    order = F.shiftleft(F.shiftright(first, 1), 31).bitwiseOR(F.shiftright(second, 1))
    # nulls inside arrays make array equality unknown to a join, so patterns are matched by a string that spells them
    kept = scratch.keep(kept.withColumns({"_order": order, "_p": F.to_json(F.struct("_sources"))}), "documents")
    patterns = scratch.keep(kept.groupBy("_p").agg(F.sum("_size").alias("words"), F.first("_sources").alias("_sources")), "patterns")
    members = patterns.select(F.col("_p").alias("p"), F.coalesce("words", F.lit(0)).alias("words"), F.explode("_sources").alias("source"))
    places = placed(members.select("source").distinct(), "source", scratch).withColumnRenamed("source", "name")
    arcs = scratch.keep(members.join(places, F.col("source").eqNullSafe(F.col("name"))).select("p", "words", "place"), "arcs")
    own = arcs.groupBy("place").agg(F.sum("words").alias("words"))
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1))
    total = patterns.where(F.size("_sources") > 0).agg(F.sum("words")).first()[0] or 0
    wanted = scratch.keep(targets(scratch.keep(own, "own"), total, most_repeats).select("place", "target"), "targets")
    arcs = arcs.join(wanted, "place")
    share = _flows(arcs, scratch).join(arcs.groupBy("p").agg(F.first("words").alias("words"), F.sum("target").alias("target")), "p")
    take = F.least(F.round("flow").cast("long"), F.col("words") * most_repeats)
    plan = share.select(
        F.col("p").alias("_p"), F.col("words").alias("pattern_size"), "target",
        F.when(F.col("words") > 0, F.floor(take / F.col("words"))).otherwise(0).cast("long").alias("_rounds"),
        F.when(F.col("words") > 0, take % F.col("words")).otherwise(0).cast("long").alias("_rest"),
    )
    plan = scratch.keep(plan, "plan")

    todo = kept.select("_p", "_row", "_key", "_size", "_order").join(plan.where("_rest > 0").select("_p", "_rest"), "_p").withColumn("_ahead", F.lit(0).cast("long"))
    cuts = None
    for level, shift in enumerate(SHIFTS):
        bins = todo.groupBy("_p", F.shiftright("_order", shift).alias("_cut")).agg(F.sum("_size").alias("s"), F.count("*").alias("n"), F.first("_rest").alias("_rest"), F.first("_ahead").alias("_ahead"))
        before = F.coalesce(F.sum("s").over(Window.partitionBy("_p").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        reached = bins.withColumn("_ahead", F.col("_ahead") + before).where((F.col("_ahead") <= F.col("_rest")) & (F.col("_rest") < F.col("_ahead") + F.col("s")))
        cuts = scratch.keep(reached.select("_p", "_cut", F.lit(shift).alias("_shift"), "n", "_ahead"), f"cuts-{level}")  # a row for each pattern
        inside = todo.drop("_ahead").join(cuts, "_p").where(F.shiftright("_order", shift) == F.col("_cut"))
        if (cuts.agg(F.max("n")).first()[0] or 0) <= SORTED:
            break
        todo = inside.drop("_cut", "_shift", "n")
    upto = F.sum("_size").over(Window.partitionBy("_p").orderBy("_order", "_key", "_row")) + F.col("_ahead")
    first = scratch.keep(inside.withColumn("_upto", upto).where(F.col("_upto") <= F.col("_rest")).select("_row", "_p", "_upto"), "first")
    reached = first.groupBy("_p").agg(F.max("_upto").alias("_reached"))
    cut = cuts.select("_p", "_cut", "_shift", "_ahead")
    chosen = kept.join(plan, "_p", "left").join(cut, "_p", "left").join(first.select("_row", F.lit(1).alias("_in")), "_row", "left")
    bin_ = F.expr("shiftright(_order, _shift)")
    chosen = chosen.withColumn("_once", F.coalesce(bin_ < F.col("_cut"), F.lit(False)) | F.col("_in").isNotNull())
    missing = F.col("_rest") - F.coalesce("_reached", "_ahead")
    closing = (
        chosen.where(F.col("_cut").isNotNull() & ~F.col("_once")).join(reached, "_p", "left")
        .withColumn("_gap", F.abs(F.col("_size") - missing)).where(F.col("_gap") < missing)
        .groupBy("_p").agg(F.min(F.struct("_gap", "_order", "_row")).alias("c")).select("c._row", F.lit(1).alias("_closes"))
    )
    more = F.when(F.col("_once") | F.col("_closes").isNotNull(), 1).otherwise(0)
    out = chosen.join(closing, "_row", "left").withColumn("taken", F.coalesce((F.col("_rounds") + more) * F.col("_size"), F.lit(0)).cast("long"))
    return out.select("_kept.*", "pattern_size", "target", "taken")


def mixed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """documents as the mix takes them: whole, and as many rows of each as it takes copies. Documents that it does not
    take, and those without words (null and empty texts), are left out; very long texts are taken or left whole. Rows
    that repeat an id or have none are told apart; columns keep their names, whatever these are; an empty table gives an
    empty one."""
    rows, ids, number = numbered(docs, "doc_id", scratch)
    rows = rows.select(F.struct(*docs.columns).alias("rest"), "doc_id", F.col(number).alias("uid"))
    narrow = rows.select("doc_id", "uid", n_words(F.col("rest.text")).alias("size"), F.array("rest.source").alias("sources"))
    taken = mix(narrow, "doc_id", "sources", "size", scratch).where("taken > 0")
    copies = scratch.keep(taken.select(F.col("doc_id").alias("id"), F.col("uid").alias("row"), (F.col("taken") / F.col("size")).cast("int").alias("copies")), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("id")) if len(ids) > 1 else F.col("doc_id") == F.col("id")
    out = rows.join(copies, same & (F.col("uid") == F.col("row")))
    return out.select("rest", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("rest.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`mix` over all documents, one source each, a null source being one too; its docstring states the other cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", n_words(F.col("text")).alias("size"), F.array("source").alias("sources"))
    mixed = mix(docs, "doc_id", "sources", "size", Scratch(spark, "mixing"))
    return mixed.select("doc_id", "size", F.col("pattern_size").alias("source_size"), "target", "taken")
