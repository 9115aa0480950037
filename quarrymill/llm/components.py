"""Connected components of an undirected link table by alternating large-star and small-star rounds.

Before each round the links that a task reads are turned into stars, block by block, as a sum is made before a shuffle:
that leaves fewer links to move, and shorter chains, so that fewer rounds are needed.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Links that are turned into stars in one go, which bounds a task's memory.
BLOCK = 1 << 18


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that the links reach) of every node that is not the least itself."""
    names, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(names))
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _contract(batches):
    def made(held):
        table = pa.Table.from_batches(held)
        ends = stars(*(table[k].to_numpy() for k in "uv"))
        return pa.RecordBatch.from_arrays([pa.array(x, table.schema.field(k).type) for x, k in zip(ends, "uv")], names=["u", "v"])

    held = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= BLOCK:
            yield made(held)
            held = []
    if held:
        yield made(held)


def _contracted(edges: DataFrame) -> DataFrame:
    """Links of the same components, each from a node to a lesser one."""
    edges = edges.where("u <> v").select("u", "v")
    return edges.mapInArrow(_contract, edges.schema)


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node leads to two others, or to one that leads on."""
    ends = edges.select(F.col("u").alias("n"), "v").unionByName(edges.select(F.col("v").alias("n"), F.lit(None).cast(edges.schema["v"].dataType).alias("v")))
    seen = ends.groupBy("n").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("met"), F.count("v").alias("out"))
    return seen.agg(F.count_if(F.expr("low < high OR (out > 0 AND met > out)"))).first()[0] > 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round. The least neighbour of a node is a partial aggregate and is joined back, so that a node with
    very many neighbours is neither sorted in one window nor gathered in one group."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hooked = both.join(least, "u")
    if large:
        return hooked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (u, v) of one comparable type; returns (node, component), component being the least node reachable.
    Nodes without links are not returned. Every round's table is written to the shared folder, which bounds the
    lineage; the driver only sees one count of each round. The rounds number as the logarithm of the nodes."""
    scratch = Scratch(scratch.spark, "components")  # calls that read one another's tables share no folder
    links = scratch.keep(_contracted(edges).distinct(), "round-0")
    for k in count(1):
        now = scratch.keep(_contracted(links), f"stars-{k}")
        scratch.drop(f"round-{k - 1}")
        if not _unsettled(now):
            break
        links = scratch.keep(_star(_star(now, True), False).where("u <> v").distinct(), f"round-{k}")
        scratch.drop(f"stars-{k}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
