"""Substring dedup by seed and extend, on words: removes every word covered by a run of 35 words that occurs elsewhere.

Seeds are winnowed anchors: of each run of 35 consecutive words, the 8-word gram of the least hash, so that equal runs
have equal anchors at equal places. The runs of a document that share an anchor's place are one stretch, which reaches
as far to both sides of the anchor as any of them. Documents meet on anchors:

- an anchor with one stretch in the corpus is in no repeated run;
- an anchor whose stretches are all equal, and more than one, is in repeated runs only;
- of any other anchor, equal stretches are in repeated runs only, and one of each kind is extended: each of its runs
  reaches some words to the left and the rest to the right, and meets equal reaches of the same anchor. No two stretches
  are compared as a pair, and copies are not extended again and again.

The anchors' counts are summed before they are shuffled. Only stretches of recurring anchors travel; two bit tables of
fixed size tell tasks which those may be, and a join with the counts decides. What remains is joined to the texts and
merged to maximal repeats.

Words, grams and runs are known by 64-bit hashes; two runs count as equal if anchor and run agree, by 128 bits.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _once
from .scratch import Scratch, numbered
from .suffix import _spans

WORD = re.compile("[^\x20\x09-\x0d]+")
LENGTH, SEED = 35, 8
#: Words that are hashed together at most; longer texts are taken in parts that overlap by a run.
PART = 1 << 18
#: Words whose hashes a Python worker remembers, if no longer than LONGEST_REMEMBERED characters.
REMEMBERED, LONGEST_REMEMBERED = 400_000, 40
#: Bits of each table of anchors, and blocks of it that are made apart.
TABLE_BITS, TABLE_BLOCKS = 1 << 26, 64
_STEP = np.uint64(0x9E3779B97F4A7C15 | 5)  # odd, as hashes of parts are taken from running sums by its inverse
_PLACE = np.uint64((1 << 24) - 1)  # the low bits of a hash make room for places, which 2 * PART words don't exceed


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse modulo 2^64."""
    made = _once("powers", 0, list)
    if not made or len(made[0]) < n:
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        size = max(n, PART + 1)
        made[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x, np.uint64)))) for x in (_STEP, inverse)]
    return made[0][:n], made[1][:n]


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words; remembers short ones."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        new = set(words).difference(seen)
        if len(seen) + len(new) > REMEMBERED:
            seen.clear()
            new = set(words)
        long = [w for w in new if len(w) > LONGEST_REMEMBERED]
        seen.update((w, xxhash.xxh3_64_intdigest(w.encode())) for w in new)
        out = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        for w in long:
            del seen[w]
        return out


def _parts(text: str, length: int):
    """(place of the first word, words) of a text's parts of at most PART words; neighbours share length - 1 words."""
    found, place, held = (m.group() for m in WORD.finditer(text)) if len(text) > 2 * PART else iter(WORD.findall(text)), 0, []
    while more := list(islice(found, PART - len(held))):
        held += more
        yield place, held
        keep = held[-(length - 1) :] if length > 1 else []
        place += len(held) - len(keep)
        held = keep


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of so many neighbours."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def stretches(parts: list[np.ndarray], length: int = LENGTH, seed: int = SEED):
    """Of word hashes of several texts: arrays (text, first run, runs, anchor's hash, stretch's hash) and a function that
    gives the hashes of the runs of chosen stretches, one after another."""
    sizes = np.array([len(p) for p in parts], np.int64)
    none = np.empty(0, np.int64)
    if not len(sizes) or sizes.max() < length:
        return (none, none, none, none.view(np.uint64), none.view(np.uint64)), lambda chosen: none.view(np.uint64)
    words = np.concatenate(parts)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    up, down = _powers(len(words) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:-1])))

    def hashes(at, n, salt):
        return _mixed((total[at + n] - total[at]) * down[at], salt)

    n_runs = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), n_runs)
    start = np.arange(n_runs.sum()) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs) + edges[text]
    grams = hashes(np.arange(len(words) - seed + 1), seed, 0x5EED)
    # the least 40 bits of the hash decide, then the place; windows across two texts are left out by `start`
    here = np.arange(len(grams), dtype=np.uint64)
    by_place = (grams & ~_PLACE) | here
    place = (_least(by_place, length - seed + 1)[start] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    runs = np.diff(np.append(first, len(place)))
    at = start[first]
    whole = hashes(at, runs + length - 1, 0x5713)
    # equal words at another distance from the anchor are another stretch
    whole ^= _mixed((place[first] - at).astype(np.uint64), 0xA2C4)

    def run_hashes(chosen):
        n = runs[chosen]
        which = np.repeat(at[chosen], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return hashes(which, length, 0x2077)

    return (text[first], at - edges[text[first]], runs, grams[place[first]], whole), run_hashes


def _batches_of_words(batch: pa.RecordBatch, length: int):
    """(rows, places of first words, hashes) of texts and parts of texts, about PART words at a time."""
    hasher = _once("words", 0, WordHasher)
    rows, places, parts, n = [], [], [], 0
    for row, text in enumerate(batch["text"]):
        for place, words in _parts(text.as_py() or "", length):
            rows.append(row)
            places.append(place)
            parts.append(hasher(words))
            n += len(words)
            if n >= PART:
                yield np.array(rows), np.array(places, np.int64), parts
                rows, places, parts, n = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(places, np.int64), parts


# ---- Spark stages


def _table(arrays: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays.values()], names=list(arrays))


def _anchors(length: int, seed: int):
    """(anchor, n, least, most) of a task's parts: how many stretches, and the least and largest of their hashes."""

    def run(batches):
        for batch in batches:
            for _, _, parts in _batches_of_words(batch, length):
                (_, _, _, anchor, whole), _ = stretches(parts, length, seed)
                if not len(anchor):
                    continue
                by = np.lexsort((whole, anchor))
                anchor, whole = anchor[by].view(np.int64), whole[by].view(np.int64)
                first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                n = np.diff(np.append(first, len(anchor)))
                yield _table({"anchor": anchor[first], "n": n, "least": np.minimum.reduceat(whole, first), "most": np.maximum.reduceat(whole, first)})

    return run


def _slots(anchor: np.ndarray) -> np.ndarray:
    return (_mixed(anchor.view(np.uint64), 0xB17) % np.uint64(TABLE_BITS)).astype(np.int64)


def _bit_table(anchors: DataFrame) -> np.ndarray:
    """The bits of all anchors' slots, of TABLE_BITS bits whatever their number: made block by block in tasks."""
    size = TABLE_BITS // TABLE_BLOCKS

    def slots(batches):
        for batch in batches:
            at = np.unique(_slots(batch["anchor"].to_numpy()))
            yield _table({"block": (at // size).astype(np.int32), "slot": at % size})

    def filled(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            block, slot = batch["block"].to_numpy(), batch["slot"].to_numpy()
            for k in np.unique(block).tolist():
                held.setdefault(k, np.zeros(size, bool))[slot[block == k]] = True
        if held:
            yield _table({"block": np.array(list(held), np.int32), "bits": pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())})

    blocks = anchors.select("anchor").mapInArrow(slots, "block int, slot long").distinct().repartition(TABLE_BLOCKS, "block").mapInArrow(filled, "block int, bits binary")
    out = np.zeros((TABLE_BLOCKS, size // 8), np.uint8)
    for r in blocks.collect():  # TABLE_BITS bits together
        out[r["block"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _may_hold(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    slot = _slots(anchor)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


_SENT = "doc_id long, uid long, place long, n int, anchor long, kind long, runs array<long>"


def _send_stretches(tables, length: int, seed: int):
    """Stretches whose anchor may recur, with the hashes of their runs where it may have different ones."""

    def run(batches):
        again, unlike = tables.value
        for batch in batches:
            ids, uids = batch["doc_id"].to_numpy(), batch["uid"].to_numpy()
            for rows, places, parts in _batches_of_words(batch, length):
                (text, first, runs, anchor, kind), run_hashes = stretches(parts, length, seed)
                anchor = anchor.view(np.int64)
                keep = np.flatnonzero(_may_hold(again, anchor))
                if not len(keep):
                    continue
                text, first, runs, anchor, kind = text[keep], first[keep], runs[keep], anchor[keep], kind[keep].view(np.int64)
                shown = _may_hold(unlike, anchor)
                edges = np.concatenate(([0], np.cumsum(np.where(shown, runs, 0)))).astype(np.int32)
                hashes = run_hashes(keep[shown]).view(np.int64)
                yield _table({
                    "doc_id": ids[rows[text]], "uid": uids[rows[text]], "place": places[text] + first, "n": runs.astype(np.int32), "anchor": anchor, "kind": kind,
                    "runs": pa.ListArray.from_arrays(pa.array(edges), pa.array(hashes)),
                })

    return run


def repeated_words(docs: DataFrame, scratch: Scratch, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """documents (doc_id, text) as rows (doc_id, uid, text, starts, stops): the ranges of words, unmerged, that are
    covered by a run of `length` words that also starts anywhere else.

    Null texts have no words; texts are taken whole, however long; rows that repeat an id or have none are documents of
    their own; an empty table gives an empty one."""
    spark = docs.sparkSession
    rows, ids, number = numbered(docs.select("doc_id", "text"), "doc_id", scratch)
    ids = ["doc_id", "uid"][: len(ids)]
    texts = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col(number).alias("uid"), "text", F.col("doc_id").isNull().alias("nameless"))
    long_enough = texts.where(F.length("text") >= 2 * length - 1).select("doc_id", "uid", "text")
    counts = long_enough.select("text").mapInArrow(_anchors(length, seed), "anchor long, n long, least long, most long")
    counts = counts.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    again = scratch.keep(counts.where("n > 1").select("anchor", (F.col("least") != F.col("most")).alias("unlike")), "anchors")
    tables = spark.sparkContext.broadcast((_bit_table(again), _bit_table(again.where("unlike"))))
    sent = long_enough.mapInArrow(_send_stretches(tables, length, seed), _SENT)
    met = scratch.keep(sent.join(again, "anchor"), "met")
    alike = met.where("not unlike").select("doc_id", "uid", "place", F.col("n").cast("long").alias("n"))
    place = F.struct("doc_id", "uid", "place")
    unlike = met.where("unlike").drop("unlike")
    kinds = scratch.keep(unlike.groupBy("anchor", "kind").agg(F.count("*").alias("copies"), F.min(place).alias("shown")), "kinds")
    joined = unlike.join(kinds, ["anchor", "kind"]).select("doc_id", "uid", "place", "n", "anchor", "copies", F.when(F.col("shown") == place, F.col("runs")).alias("runs"))
    told = scratch.keep(joined, "told")
    copied = told.where("copies > 1").select("doc_id", "uid", "place", F.col("n").cast("long").alias("n"))
    runs = told.where("runs is not null").select("doc_id", "uid", "anchor", "place", "copies", F.posexplode("runs").alias("k", "run"))
    often = scratch.keep(runs.groupBy("anchor", "run").agg(F.count("*").alias("times")).where("times > 1").select("anchor", "run"), "often")
    extended = runs.where("copies = 1").join(often, ["anchor", "run"]).select("doc_id", "uid", (F.col("place") + F.col("k")).alias("place"), F.lit(1).cast("long").alias("n"))
    found = alike.unionByName(copied).unionByName(extended).select(*ids, F.struct("place", (F.col("place") + F.col("n") + (length - 1)).alias("stop")).alias("range"))
    ranges = found.groupBy(*ids).agg(F.collect_list("range").alias("ranges"))
    out = texts.join(ranges, ids, "left")
    return out.select(F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "uid", "text", F.col("ranges.place").alias("starts"), F.col("ranges.stop").alias("stops"))


def maximal_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, starts, stops, kept): per document the maximal runs of repeated words, which do not touch, and
    the words that are left, joined by one space. See repeated_words."""
    return repeated_words(docs, scratch, length, seed).mapInArrow(_cut, "doc_id long, n_words long, starts array<long>, stops array<long>, kept string")


def _cut(batches):
    for batch in batches:
        out = []
        for text, starts, stops in zip(batch["text"], batch["starts"], batch["stops"]):
            words = WORD.findall(text.as_py() or "")
            a, b = (x.tolist() for x in _spans(starts.as_py(), stops.as_py()))
            left = words
            if a:
                left = [w for x, y in zip([0, *b], [*a, len(words)]) for w in words[x:y]]
            out.append((len(words), a, b, " ".join(left)))
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", "n_words", "starts", "stops", "kept"])


def digests(repeats: DataFrame) -> DataFrame:
    """Of maximal repeats: doc_id, n_words, n_removed, kept_sha256."""
    removed = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return repeats.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 35 words over all documents; `repeated_words` states nulls, long texts, repeated rows and empty tables.
    Texts that tie keep none of a shared run; columns besides doc_id and text, whatever their names, are not read."""
    return digests(maximal_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "seeds")))
