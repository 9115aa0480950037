"""Near copies by exact Jaccard likeness of word shingles: the general form of the SimHash operator, for the pipeline.

Candidates come from the fingerprints' segment-popcount grid first. A 64-bit fingerprint that differs in 4 bits or fewer
finds close copies only: at a likeness of 0.8 about 10 bits differ, and a grid wide enough for those puts nearly all
fingerprints side by side. Texts therefore also meet by min-hashes: 20 bands of 4 minima, equal in one band at least
with a probability of 0.99997 at likeness 0.8. Every link is then verified on the shingle sets themselves. Candidates
that a chain of links joins already are not compared again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .scratch import Scratch

WIDTH, LIKENESS = 5, (4, 5)  # likeness as a fraction, compared in whole numbers
BANDS, ROWS = 20, 4
#: Rounds in which the members of a bucket meet one of them only; what is left unjoined then meets in blocks of so many
#: bytes of text.
ROUNDS, BLOCK = 1, 4 << 20
#: Texts that one task compares with one text.
GROUP = 512
_RNG = np.random.default_rng(42)
_ADD, _BY = _RNG.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_BY |= np.uint64(1)
_SALT, _MIX = _RNG.integers(0, 1 << 64, BANDS, np.uint64), np.uint64(0x9E3779B97F4A7C15)


def set_of(text: bytes, width: int = WIDTH) -> np.ndarray:
    return np.unique(simhash.shingles_of(text, width))


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """One number for each band; a set without shingles has the numbers of no other."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        h = (shingles[at : at + 1024, None] ^ _ADD) * _BY
        np.minimum(least, (h ^ (h >> np.uint64(32))).min(axis=0), out=least)
    out = _SALT.copy()
    for k in range(ROWS):
        out = (out ^ least[k::ROWS]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _sketch(text: Column, width: int) -> Column:
    """node (a digest of the shingle set, so that equal sets are one node), fp (the fingerprint) and bands."""

    @F.arrow_udf("node long, fp long, bands array<long>")
    def made(texts: pa.Array) -> pa.Array:
        nodes, prints, bands = (np.empty((len(texts), k), np.uint64) for k in (1, 1, BANDS))
        for k, text in enumerate(texts.cast(pa.binary())):
            shingles = simhash.shingles_of(text.as_py() or b"", width)
            s = np.unique(shingles)
            nodes[k], prints[k], bands[k] = xxhash.xxh64_intdigest(s.tobytes()), simhash.majority(shingles), bands_of(s)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64)))
        return pa.StructArray.from_arrays([pa.array(nodes.ravel().view(np.int64)), pa.array(prints.ravel().view(np.int64)), lists], names=["node", "fp", "bands"])

    return made(text)


def _alike(a: np.ndarray, b: np.ndarray, likeness: tuple[int, int]) -> bool:
    over, under = likeness
    if under * min(len(a), len(b)) < over * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return under * both >= over * (len(a) + len(b) - both)


def _pair(u: list, v: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _verified(pairs: DataFrame, texts: DataFrame, width: int, likeness: tuple[int, int]) -> DataFrame:
    """Of different pairs (u, v), those whose shingle sets are alike enough. A text with very many partners is sent to
    as many places as it has groups of GROUP partners, each partner to one."""

    def check(batches):
        mine = None
        for batch in batches:
            us, vs = [], []
            for u, v, text in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), batch["text"].cast(pa.binary())):
                s = set_of(text.as_py() or b"", width)
                if v is None:
                    mine = s
                elif _alike(mine, s, likeness):
                    us.append(u)
                    vs.append(v)
            yield _pair(us, vs)

    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    u, v = (texts.select(F.col("node").alias(k), "text") for k in "uv")
    one = parts.join(u, "u").select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("v"), "text")
    others = pairs.join(parts, "u").join(v, "v").select("u", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"), "v", "text")
    met = one.unionByName(others).repartition("u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v"))
    return met.select("u", "v", "text").mapInArrow(check, "u long, v long")


def _block_links(open_: DataFrame, texts: DataFrame, width: int, likeness: tuple[int, int]) -> DataFrame:
    """Links between the members (bucket, node, component, size) of a bucket that are of different components, compared
    block by block, each pair of blocks in a place of its own. Two members of several buckets are compared in one."""

    def compare(table):
        nodes, label, bucket = table["node"].to_numpy(), table["component"].to_numpy().copy(), table["bucket"][0].as_py()
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        here = int(np.flatnonzero(bands[0] == bucket)[0])
        sets, us, vs = [set_of(t.as_py() or b"", width) for t in table["text"].cast(pa.binary())], [], []
        for a in range(len(nodes)):
            met_before = (bands[:a, :here] == bands[a, :here]).any(axis=1)
            for b in np.flatnonzero(~met_before & (label[:a] != label[a])).tolist():
                if label[a] != label[b] and _alike(sets[a], sets[b], likeness):
                    us.append(nodes[a])
                    vs.append(nodes[b])
                    label[label == label[a]] = label[b]
        return pa.table(_pair(us, vs).columns, names=["u", "v"])

    blocks = open_.groupBy("bucket").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("n"))
    dealt = open_.drop("size").join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), "n").cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    placed = paired.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component").join(texts, "node")
    return placed.groupBy("bucket", "i", "j").applyInArrow(lambda table: compare(table), "u long, v long")


def near_copies(docs: DataFrame, scratch: Scratch, key: str, text: str = "text", width: int = WIDTH, likeness: tuple[int, int] = LIKENESS) -> DataFrame:
    """Of documents with a key that tells rows apart: key, component_id (the least key that a chain of links reaches).

    Texts are linked where the Jaccard likeness of their sets of `width`-word shingles is at least `likeness`. Null and
    empty texts are copies of one another; a text of fewer words is one shingle; very long texts are taken whole; an
    empty table gives an empty one."""
    sketched = docs.select(F.col(key).alias("key"), _sketch(F.col(text), width).alias("x"), (F.coalesce(F.octet_length(text), F.lit(0)) + 64).cast("long").alias("size"))
    sketched = scratch.keep(sketched.select("key", "x.node", "x.fp", "x.bands", "size"), "sketches")
    distinct = sketched.groupBy("node").agg(F.min("key").alias("least"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"), F.max("size").alias("size"))
    distinct = scratch.keep(distinct, "nodes")
    filed = distinct.select("node", "size", F.explode("bands").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1").select("bucket", "head")
    members = scratch.keep(filed.join(shared, "bucket"), "members")

    heads = distinct.groupBy("fp").agg(F.min("node").alias("head"))
    alike = distinct.join(heads, "fp").select(F.col("head").alias("u"), F.col("node").alias("v"))
    grid = simhash.links(heads.select("fp"), scratch)
    a, b = (heads.select(F.col("fp").alias(k), F.col("head").alias(f"h{k}")) for k in "uv")
    close = grid.join(a, "u").join(b, "v").select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v"))
    banded = members.select(F.col("head").alias("u"), F.col("node").alias("v"))
    pairs = scratch.keep(alike.unionByName(close).unionByName(banded).where("u <> v").distinct(), "pairs")

    asked = members.select("node").unionByName(pairs.select(F.col("u").alias("node"))).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    asked = asked.join(distinct, "node").select("node", F.col("least").alias(key), "bands")
    texts = scratch.keep(docs.select(key, F.col(text).alias("text")).join(asked, key).select("node", "text", "bands"), "texts")
    linked = components(scratch.keep(_verified(pairs, texts, width, likeness), "links-0"), scratch)
    rest = members.where("node <> head").select("bucket", "node", "size")
    for k in range(1, ROUNDS + 1):
        now = rest.join(linked.withColumnRenamed("component", "c"), "node", "left").select("bucket", "node", "size", F.coalesce("c", "node").alias("component"))
        first = now.groupBy("bucket").agg(F.min(F.struct("component", "node")).alias("p"), (F.min("component") < F.max("component")).alias("open")).where("open")
        now = scratch.keep(now.join(first.select("bucket", "p"), "bucket"), f"open-{k}")
        if now.isEmpty():
            break
        if k == ROUNDS:
            more = _block_links(now.drop("p"), texts, width, likeness)
        else:
            met = now.where("component <> p.component").select(F.least("p.node", "node").alias("u"), F.greatest("p.node", "node").alias("v"))
            more = _verified(scratch.keep(met.distinct(), f"pairs-{k}"), texts, width, likeness)
        more = scratch.keep(more, f"links-{k}")
        if not more.isEmpty():
            linked = components(linked.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), scratch)
        rest = now.where("node <> p.node").select("bucket", "node", "size")

    placed = distinct.join(linked, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = scratch.keep(placed.join(named, "component").select("node", "component_id"), "classes")
    for name in ("members", "texts"):
        scratch.drop(name)
    return sketched.join(classes, "node").select(F.col("key").alias(key), "component_id")
