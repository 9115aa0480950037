"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint becomes the vector of bit counts of its 32 two-bit segments. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints, so fingerprints that differ in 4 bits or fewer have a
half (16 segments) whose vectors are at most 2 apart. Every fingerprint is filed, for each half, in the grid cells at
distance 0 and 1 from its vector; two vectors at most 2 apart then share a cell. Fingerprints of a cell are compared
exactly, and each cell keeps a spanning forest of its links, which is all that components need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .components import components
from .scratch import Scratch, numbered

MOST_DIFFERING = 4
SHINGLE, SEED = 4, 42
#: Fingerprints of one cell that are compared in one place; larger cells are cut into blocks of this size, and every
#: pair of blocks is compared in a place of its own.
BLOCK = 2048
_SMALL = 12  # cells up to this size are compared side by side
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles_of(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of UTF-8 bytes, in order; A-Z count as a-z, words are split at ASCII white space. A
    text of fewer words is one shingle, one without words has none."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[: 1 - width].tolist(), end[width - 1 :].tolist())), np.uint64, len(words) - width + 1)


def fingerprint_of(text: bytes, width: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 bytes, 0 where there are no words."""
    return majority(shingles_of(text, width))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column) -> Column:
    """bigint; the fingerprint's bits as a signed number. Null texts count as empty, which is 0."""

    @F.arrow_udf("long")
    def made(texts: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint_of(t.as_py() or b"") for t in texts.cast(pa.binary())), np.uint64, len(texts))
        return pa.array(out.view(np.int64))

    return made(text)


def cells_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fingerprint) of every grid cell that each fingerprint is filed in. A cell is named by its half and the
    half's 16 counts, two bits each."""
    one = np.uint64(1)
    counts = prints - ((prints >> one) & np.uint64(0x5555555555555555))
    cells, held = [], []
    for half in (0, 1):
        base = ((counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)) | np.uint64(half << 32)
        cells.append(base)
        held.append(prints)
        for segment in range(16):
            unit = one << np.uint64(2 * segment)
            c = (base >> np.uint64(2 * segment)) & np.uint64(3)
            up, down = c < 2, c > 0
            cells += [base[up] + unit, base[down] - unit]
            held += [prints[up], prints[down]]
    return np.concatenate(cells), np.concatenate(held)


def _near(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MOST_DIFFERING


def _forest(left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within `left`, or of those among both where right is given: every fingerprint
    is expanded once, against those not reached yet."""
    todo = left if right is None else np.concatenate((left, right))
    a, b = [], []
    while len(todo) > 1:
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            x = front.pop()
            hit = _near(todo, x)
            if hit.any():
                reached = todo[hit]
                a.append(np.full(len(reached), x, np.uint64))
                b.append(reached)
                front.extend(reached)
                todo = todo[~hit]
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the cells of rows sorted by cell; every cell is whole and of at most BLOCK rows."""
    edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
    size = np.diff(edge)
    a, b = [], []
    member = np.repeat(size, size)
    few = np.flatnonzero((member > 1) & (member <= _SMALL))
    c, f = cell[few], fp[few]
    for d in range(1, _SMALL):
        if len(f) <= d:
            break
        hit = (c[d:] == c[:-d]) & _near(f[d:], f[:-d])
        a.append(f[:-d][hit])
        b.append(f[d:][hit])
    for k in np.flatnonzero(size > _SMALL):
        x, y = _forest(fp[edge[k] : edge[k + 1]])
        a.append(x)
        b.append(y)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


_ROWS = "u long, v long, cell long, block int"


def _batch(u, v, cell=None, block=None) -> pa.RecordBatch:
    n = len(u)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(u.view(np.int64)), none if v is None else pa.array(v.view(np.int64)), none if cell is None else pa.array(cell.view(np.int64)), pa.nulls(n, pa.int32()) if block is None else pa.array(block, pa.int32())],
        names=["u", "v", "cell", "block"],
    )


def _unique(u, v):
    low, high = np.minimum(u, v), np.maximum(u, v)
    both = np.unique(np.stack((low, high), axis=1), axis=0) if len(low) else np.empty((0, 2), np.uint64)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _compare(batches):
    """Rows (cell, fp) sorted by cell, to links (u, v). Members of a cell beyond BLOCK come out as rows
    (u, cell, block) instead, to be compared block by block elsewhere."""
    rest_c, rest_f, overflow = np.empty(0, np.uint64), np.empty(0, np.uint64), {}
    for batch in (*batches, None):
        if batch is not None:
            rest_c = np.concatenate((rest_c, batch["cell"].to_numpy(zero_copy_only=False).view(np.uint64)))
            rest_f = np.concatenate((rest_f, batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)))
        if not len(rest_c):
            continue
        last = rest_c[-1]
        cut = len(rest_c) if batch is None else int(np.searchsorted(rest_c == last, True)) if len(rest_c) else 0
        whole_c, whole_f, rest_c, rest_f = rest_c[:cut], rest_f[:cut], rest_c[cut:], rest_f[cut:]
        if len(whole_c):
            edge = np.flatnonzero(np.concatenate(([True], whole_c[1:] != whole_c[:-1], [True])))
            size = np.diff(edge)
            large = np.repeat((size > BLOCK) | np.isin(whole_c[edge[:-1]], np.fromiter(overflow, np.uint64, len(overflow))), size)
            if large.any():
                for c in np.unique(whole_c[large]):
                    these = whole_f[whole_c == c]
                    from_ = overflow.get(int(c), 0)
                    overflow[int(c)] = from_ + len(these)
                    yield _batch(these, None, np.full(len(these), c), (from_ + np.arange(len(these))) // BLOCK)
                whole_c, whole_f = whole_c[~large], whole_f[~large]
            if len(whole_c):
                yield _batch(*_unique(*_links(whole_c, whole_f)))
        if len(rest_c) >= BLOCK:  # the open cell is large already: pass its members on, keeping none
            from_ = overflow.get(int(last), 0)
            overflow[int(last)] = from_ + len(rest_c)
            yield _batch(rest_f, None, rest_c, (from_ + np.arange(len(rest_f))) // BLOCK)
            rest_c, rest_f = rest_c[:0], rest_f[:0]


def _compare_blocks(key, table):
    fp, side = table["u"].to_numpy().view(np.uint64), table["block"].to_numpy()
    u, v = _unique(*_forest(fp[np.argsort(side, kind="stable")]))
    return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})


def links(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """prints: distinct fingerprints (fp). Returns links (u, v) that connect all fingerprints which a chain of steps of
    at most 4 bits connects."""

    def file(batches):
        for batch in batches:
            cell, fp = cells_of(batch["fp"].to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp.view(np.int64))], names=["cell", "fp"])

    filed = prints.mapInArrow(file, "cell long, fp long").repartition("cell").sortWithinPartitions("cell")
    rows = scratch.keep(filed.mapInArrow(_compare, _ROWS), "links")
    found, large = rows.where("cell is null").select("u", "v"), rows.where("cell is not null")
    if large.isEmpty():
        return found
    blocks = large.groupBy("cell").agg((F.max("block") + 1).alias("n"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    paired = large.join(blocks, "cell").select("cell", "u", "block", other.alias("o")).select("cell", "u", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    return found.unionByName(paired.groupBy("cell", "i", "j").applyInArrow(_compare_blocks, "u long, v long"))


def near_duplicates(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of documents: key, fp, component_id (the least key reachable by links, the document's own included).

    Every row is returned, repeated rows repeatedly. Copies share a fingerprint and are never paired with one another.
    Null and empty texts have fingerprint 0, linked like any other; very long texts are read whole; a null key never
    names a component that has other keys; an empty table gives an empty one. Texts are read once and not shuffled."""
    printed = scratch.keep(docs.select(F.col(key).alias("key"), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    distinct = scratch.keep(printed.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    linked = components(links(distinct.select("fp"), scratch), scratch)
    placed = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = scratch.keep(placed.join(named, "component").select("fp", "component_id"), "classes")
    return printed.join(classes, "fp").select(F.col("key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """documents with one row of each group of near copies (near_copies): that of the least doc_id, rows without an id
    last, and of rows that share an id the one numbered first. Only near copies leave: rows that repeat an id with other texts
    are documents of their own, as are rows without an id. Null and empty texts are copies of one another; very long
    texts are compared whole; columns keep their names, whatever these are; an empty table gives an empty one."""
    rows, ids, number = numbered(docs, "doc_id", scratch)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", number)
    found = near_copies.near_copies(rows.select(row.alias("row"), "text"), scratch, "row")
    kept = found.where(F.col("row").eqNullSafe(F.col("component_id"))).select(F.col("row").getField(ids[-1]).alias(ids[-1]))
    return rows.join(scratch.keep(kept, "kept"), ids[-1], "left_semi").select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`near_duplicates` over all documents; its docstring states nulls, copies, long texts, repeated rows and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, Scratch(spark, "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
