"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of the ids that meet.

A transducer reads both token strings at once. Its state is which side leads and the bytes by which it does; the side
behind gives the next token. What a token does to a state is worked out once and remembered by residual and token; when
nothing is left over, both sides end at one place and a group closes.

Texts are cut where neither tokenizer can have a token across: before a space that follows a character other than
white space. A stretch between cuts begins and ends with nothing left over, so its groups are remembered as well.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import MOST_VOCABULARY_BYTES, PATTERN, _once, in_chunks
from .scratch import Scratch

#: Places where texts may be cut: a space after a character that no engine counts as white space, unless only spaces
#: follow; ends, besides white space, after which no stretch may be put; and what a text has if it can't be cut at all
#: its spaces.
OPEN_ENDS = ("", "\u180e", "\u200b", "\u2581", "\ufeff")
LOOSE = rf"\s{''.join(OPEN_ENDS)}"
CUT, UNEVEN = re.compile(f"(?<=[^{LOOSE}])(?= +[^ ])"), re.compile(f"[{LOOSE}] ")
#: Transitions and bytes of stretches that a Python worker remembers, the stretches in two halves of which the older is
#: dropped when the newer is full. Longer stretches than LONGEST_REMEMBERED characters are worked out whenever they occur.
MOST_TRANSITIONS, REMEMBERED_BYTES, LONGEST_REMEMBERED = 1_000_000, 128 << 20, 100
STRETCH_OVERHEAD, CHAR_OVERHEAD = 400, 16  # bytes, about, besides the stretch, and for each of its characters
#: Characters of texts whose new stretches are worked out together, and stretches that are encoded as one text.
CHUNK_CHARS, JOINED = 500_000, 1_000
#: Characters that engines may class differently, and the length from which a text is long.
UNSETTLED, SHORT = re.compile("[^\x00-\u052f\u2000-\u206f]"), 100_000
#: Groups with more links than this are summed by distinct ids before links are written out.
LARGE_GROUP = 1 << 10
#: Pairs of ids whose counts are sent to every task; the counts of the others are joined.
MOST_SENT_PAIRS = 1 << 20


# ---- the two sides


class ByteLevelTokenizer:
    """A byte-level BPE file of the tokenizers library; special tokens' strings in texts are plain text.

    Where the file's merges stand in the order of their ids, the ids are ranks, and texts of long-settled characters are
    encoded by the faster library of ranks; all others, and long ones, by the file's own."""

    def __init__(self, raw: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(raw.decode())
        self.model.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        model = json.loads(raw)["model"]
        vocabulary = model["vocab"]
        self.bytes = [b""] * (max(vocabulary.values()) + 1)  # ids without bytes stay empty
        for token, i in vocabulary.items():
            if all(c in byte_of for c in token):
                self.bytes[i] = bytes(byte_of[c] for c in token)
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        ranks = {x: i for i, x in enumerate(self.bytes) if x}
        self.ranked = None
        if merged == sorted(merged) and len(ranks) == 256 + len(merged):
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.ranked is not None and len(text) <= SHORT and not UNSETTLED.search(text):
            return self.ranked.encode_ordinary(text)
        return self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids


class PieceTokenizer:
    """A sentencepiece model, which puts a space before what it encodes; a text must begin with that space."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece goes on after the end of a word, so texts can't be cut before spaces")
        self.bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text[1:])


# ---- the transducer


class DanglingSuffix:
    """Groups of tokens of two sides, given each side's bytes by id."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.sides = a_bytes, b_bytes
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple[int, bytes]] = [(0, b"")]  # (the side that leads, its unmatched bytes); 0: none
        self.names = {(0, b""): 0, (1, b""): 0}
        self.moves: dict[int, int] = {}  # by state << 32 | token of the side behind
        self.openings: dict[int, int] = {}  # from nothing left over, by token of a << 32 | token of b

    def _state(self, side: int, residual: bytes) -> int:
        name = self.names.get((side, residual))
        if name is None:
            name = self.names[side, residual] = len(self.states)
            self.states.append((side, residual))
        return name

    def _move(self, state: int, token: int) -> int:
        """The next state; -1 where the token's bytes contradict the residual."""
        side, residual = self.states[state]
        added = self.sides[1 - side][token]
        if residual.startswith(added):
            return self._state(side, residual[len(added) :])
        if added.startswith(residual):
            return self._state(1 - side, added[len(residual) :])
        return -1

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """Where each group ends in a, and where in b; None if the two sides' bytes differ. No token is without bytes."""
        if len(self.moves) + len(self.openings) > MOST_TRANSITIONS:
            self.forget()
        moves, openings, states = self.moves, self.openings, self.states
        a_ends, b_ends, i, j = [], [], 0, 0
        try:
            while i < len(a):
                key = a[i] << 32 | b[j]  # a group opens with a token of either side: two moves in one
                i += 1
                j += 1
                state = openings.get(key)
                if state is None:
                    state = openings[key] = self._move(self._state(0, self.sides[0][key >> 32]), key & 0xFFFFFFFF)
                while state:
                    if state < 0:
                        return None
                    if states[state][0]:  # side b leads
                        token = a[i]
                        i += 1
                    else:
                        token = b[j]
                        j += 1
                    key = state << 32 | token
                    state = moves.get(key)
                    if state is None:
                        state = moves[key] = self._move(key >> 32, token)
                a_ends.append(i)
                b_ends.append(j)
        except IndexError:  # one side ends before the other
            return None
        return (a_ends, b_ends) if j == len(b) else None


def stretches_of(text: str) -> list[str]:
    """The stretches of a space and a text that is not empty, each without the space that it begins with."""
    if text[0] == " " or text[-1] == " " or UNEVEN.search(text):
        return [s[1:] for s in CUT.split(" " + text)]
    return text.split(" ")


class Aligner:
    """Texts to groups and links, stretch by stretch. Stretches go without their first space."""

    def __init__(self, a, b):
        self.sides, self.transducer = (a, b), DanglingSuffix(a.bytes, b.bytes)
        self.sizes = [np.array([len(x) for x in side.bytes]) for side in self.sides]
        self.seen: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}  # remembered before `seen`; what is met again is taken over
        self.held = 0

    def _worked_out(self, stretches: list[str]) -> list[tuple | None]:
        """For each stretch (groups as text, tokens of a, tokens of b, groups, id pairs of the links, large groups' pairs
        with their numbers or None), or None where a side does not give back the bytes. The stretches are encoded as one
        text; where that does not give back the bytes, halves of them are, down to the one at fault."""
        whole = " " + " ".join(stretches)
        raw = whole.encode()
        ids = [side.encode(whole) for side in self.sides]
        arrays = [np.array(tokens, np.int64) for tokens in ids]
        sizes = [size[tokens] for size, tokens in zip(self.sizes, arrays)]
        # side b gives back the bytes, and so does side a if the transducer finds nothing that differs
        same = b"".join(map(self.sides[1].bytes.__getitem__, ids[1])) == raw and all(size.all() for size in sizes)
        ends = self.transducer.groups(*ids) if same else None
        if ends:
            stops = np.cumsum(np.fromiter((len(x.encode()) + 1 for x in stretches), np.int64, len(stretches)))
            stop, places = np.array(ends, np.int64), np.cumsum(sizes[0])
            places = places[stop[0] - 1]
            groups = np.searchsorted(places, stops)
            if (places[np.minimum(groups, len(places) - 1)] == stops).all():
                return self._linked(*ids, *arrays, stop, groups + 1)
        if len(stretches) == 1:
            return [None]
        half = len(stretches) // 2
        return self._worked_out(stretches[:half]) + self._worked_out(stretches[half:])

    @staticmethod
    def _linked(a_ids: list[int], b_ids: list[int], a: np.ndarray, b: np.ndarray, stop: np.ndarray, stops: np.ndarray) -> list[tuple]:
        """The ids twice; stop: where groups end in both; stops: how many groups end with each stretch or before."""
        shown, i, j = [], 0, 0
        for i2, j2 in zip(*stop.tolist()):
            if i2 - i == 1 == j2 - j:
                shown.append(f"{a_ids[i]}|{b_ids[j]}")
            else:
                shown.append(f"{','.join(map(str, a_ids[i:i2]))}|{','.join(map(str, b_ids[j:j2]))}")
            i, j = i2, j2
        start = np.concatenate((np.zeros((2, 1), np.int64), stop[:, :-1]), axis=1)
        n, m = stop - start
        large = np.flatnonzero(n * m > LARGE_GROUP)
        links = n * m
        links[large] = 0
        group, past = np.repeat(np.arange(len(n)), links), np.cumsum(links)
        k = np.arange(len(group)) - (past - links)[group]
        width = m[group]
        left = k // width
        listed = (a[start[0][group] + left] << 32 | b[start[1][group] + k - left * width]).tobytes()
        summed: dict[int, list] = {}
        for g in large.tolist():
            (x, p), (y, q) = (np.unique(side[start[c, g] : stop[c, g]], return_counts=True) for c, side in enumerate((a, b)))
            summed.setdefault(int(np.searchsorted(stops, g, "right")), []).append((((x << 32)[:, None] | y).ravel(), (p[:, None] * q).ravel()))
        last, first = stops - 1, np.concatenate(([0], stops[:-1]))
        n_a, n_b = (stop[:, last] - start[:, first]).tolist()
        ends = (8 * past[last]).tolist()
        return [
            (";".join(shown[g:h]), x, y, h - g, listed[p:q], summed.get(k))
            for k, (g, h, x, y, p, q) in enumerate(zip(first.tolist(), stops.tolist(), n_a, n_b, [0, *ends], ends))
        ]

    def _learn(self, new: set[str]) -> list[str]:
        """Takes over old stretches and works out new ones; returns those that are too long to be remembered."""
        seen, old = self.seen, self.old
        known = new.intersection(old)
        seen.update((s, old[s]) for s in known)
        new = new.difference(known)
        alone = [s for s in new if s[-1:].isspace() or s[-1:] in OPEN_ENDS]
        joined = list(new.difference(alone))
        for some in [*(joined[k : k + JOINED] for k in range(0, len(joined), JOINED)), *([s] for s in alone)]:
            seen.update(zip(some, self._worked_out(some)))
        self.held += STRETCH_OVERHEAD * (len(new) + len(known)) + CHAR_OVERHEAD * (sum(map(len, new)) + sum(map(len, known)))
        return [s for s in new if len(s) > LONGEST_REMEMBERED]

    def align(self, texts: list[str]):
        """A row for each text: (n_a, n_b, n_groups, sha256 of the groups, distinct id pairs, links of each)."""
        if self.held > REMEMBERED_BYTES // 2:
            self.old, self.seen, self.held = self.seen, {}, 0
        split = [stretches_of(text) if text else [] for text in texts]
        names, seen = set(chain.from_iterable(split)), self.seen
        long = self._learn(names.difference(seen))
        empty, at = ("", 0, 0, 0, b"", None), dict(zip(names, range(len(names))))
        known = list(map(seen.__getitem__, names))
        fails = {k for k, found in enumerate(known) if found is None}
        shown, n_a, n_b, n_groups, listed, summed = zip(*(found or empty for found in known)) if known else ((),) * 6
        large = {k for k, found in enumerate(summed) if found}
        counts, none = np.array([n_a, n_b, n_groups], np.int64), np.empty(0, np.int64)
        for stretches in split:
            here = list(map(at.__getitem__, stretches))
            if not here or not fails.isdisjoint(here):
                yield 0, 0, 0, "", none, none
                continue
            pairs, times = np.unique(np.frombuffer(b"".join(map(listed.__getitem__, here)), np.int64), return_counts=True)
            more = [x for k in here if k in large for x in summed[k]] if large else []
            if more:
                both = np.concatenate([pairs, *(p for p, _ in more)])
                weight = np.concatenate([times, *(m for _, m in more)])
                pairs, place = np.unique(both, return_inverse=True)
                times = np.zeros(len(pairs), np.int64)
                np.add.at(times, place.reshape(-1), weight)
            sha = hashlib.sha256(";".join(map(shown.__getitem__, here)).encode()).hexdigest()
            yield *counts[:, here].sum(axis=1).tolist(), sha, pairs, times
        for stretch in long:
            del seen[stretch]


# ---- Spark stages

_ALIGNED = "doc_id long, uid long, n_a long, n_b long, n_groups long, groups_sha256 string, a array<int>, b array<int>, n array<long>"
_PAIRS = "uid long, a int, b int, n long"


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *parts]).astype(kind)))


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(raw) > MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to be sent to every executor")
    return raw


def aligned(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """documents (doc_id, text) as rows (doc_id, uid, n_a, n_b, n_groups, groups_sha256, a, b, n): the last three are the
    text's distinct linked id pairs and how often each is linked. byte_level and pieces are paths of vocabulary files,
    which the driver reads and sends once. No shuffle; uid is only fixed once the table is written."""
    files = _read(byte_level), _read(pieces)
    sent, key = docs.sparkSession.sparkContext.broadcast(files), hashlib.sha256(b"\0".join(files)).hexdigest()

    def run(batches):
        aligner = _once("align", key, lambda: Aligner(ByteLevelTokenizer(sent.value[0]), PieceTokenizer(sent.value[1])))
        for batch in batches:
            at = 0
            for texts in in_chunks(batch["text"], CHUNK_CHARS):
                gc.disable()  # nothing here refers to itself, and collections would go through all that is remembered
                n_a, n_b, groups, sha, pairs, times = zip(*aligner.align(texts))
                gc.enable()
                here = slice(at, at := at + len(texts))
                longs = [pa.array(x, pa.int64()) for x in (n_a, n_b, groups)]
                ids = [batch[c][here.start : here.stop] for c in ("doc_id", "uid")]
                lists = [_lists([p >> 32 for p in pairs], np.int32), _lists([p & 0xFFFFFFFF for p in pairs], np.int32), _lists(times, np.int64)]
                yield pa.RecordBatch.from_arrays([*ids, *longs, pa.array(sha, pa.string()), *lists], names=[c.split()[0] for c in _ALIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("uid"), "text").mapInArrow(run, _ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, count) of each id pair: how many documents hold it linked."""
    return found.select(F.explode(F.arrays_zip("a", "b")).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("count"))


def digests(found: DataFrame, scratch: Scratch, most_sent: int = MOST_SENT_PAIRS) -> DataFrame:
    """Rows of `aligned`, kept in a table, with links counted over the corpus.

    The commonest pairs, most_sent at most, are sent to every task, with each id of side a's highest count, which are no
    more than its vocabulary; links of all other pairs are joined by pair. Only these are shuffled."""
    spark = found.sparkSession
    counts = scratch.keep(pair_counts(found), "counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    # pairs by the binary digits of their counts: 64 rows at most; as many of the commonest classes as may be sent
    classes = counts.groupBy(F.floor(F.log2("count")).alias("digits")).agg(F.count("*").alias("n")).orderBy(F.desc("digits")).collect()
    least, total = 1 << 62, 0
    for r in classes:
        total += r["n"]
        if total > most_sent:
            break
        least = 1 << r["digits"]
    graded = counts.join(F.broadcast(highest), "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    head = graded.where(F.col("count") >= least).toArrow()
    code = (head["a"].to_numpy().astype(np.int64) << 32) | head["b"].to_numpy().astype(np.int64)
    by = np.argsort(code)
    sent = spark.sparkContext.broadcast((code[by], head["count"].to_numpy().astype(np.int64)[by], head["best"].to_numpy().astype(np.int64)[by]))

    def looked_up(a, b):
        code, count, best = sent.value
        want = (a.flatten().to_numpy().astype(np.int64) << 32) | b.flatten().to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(code, want), max(len(code) - 1, 0))
        there = code[at] == want if len(code) else np.zeros(len(want), bool)
        return at, there, count, best

    @F.arrow_udf("struct<n_links: long, n_best: long, count_sum: long>")
    def sums(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
        at, there, count, best = looked_up(a, b)
        times, edges = n.flatten().to_numpy(), n.offsets.to_numpy() - n.offsets[0].as_py()
        out = []
        for x in (times, np.where(there, best[at] if len(best) else 0, 0) * times, np.where(there, count[at] if len(count) else 0, 0) * times):
            total = np.concatenate(([0], np.cumsum(x)))
            out.append(pa.array(total[edges[1:]] - total[edges[:-1]], pa.int64()))
        return pa.StructArray.from_arrays(out, names=["n_links", "n_best", "count_sum"])

    def others(batches):
        for batch in batches:
            a, b, n = batch["a"], batch["b"], batch["n"]
            _, there, _, _ = looked_up(a, b)
            uid = np.repeat(batch["uid"].to_numpy(), np.diff(a.offsets.to_numpy()))
            rest = ~there
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid[rest], *(c.flatten().to_numpy()[rest] for c in (a, b, n)))], names=["uid", "a", "b", "n"])

    out = found.select("doc_id", "uid", "n_a", "n_b", "n_groups", sums("a", "b", "n").alias("s"), "groups_sha256")
    n_best, count_sum = F.col("s.n_best"), F.col("s.count_sum")
    if total > most_sent:
        rare = found.select("uid", "a", "b", "n").mapInArrow(others, _PAIRS).join(graded.where(F.col("count") < least), ["a", "b"])
        sums_rare = rare.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_count"))
        out = out.join(sums_rare, "uid", "left")
        n_best, count_sum = n_best + F.coalesce("more_best", F.lit(0)), count_sum + F.coalesce("more_count", F.lit(0))
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("s.n_links").alias("n_links"), n_best.alias("n_best"), count_sum.alias("count_sum"), "groups_sha256")


def alignment(docs: DataFrame, byte_level: str, pieces: str, scratch: Scratch) -> DataFrame:
    """Per document (doc_id, text): tokens of both sides, groups, links, and how common its links are in the corpus.

    Texts that are null or empty, or that a side does not give back byte for byte, have no tokens: zeros and an empty
    digest. Long texts are taken whole; a stretch without a place to cut is encoded in one piece. Rows that repeat, or
    that share an id or have none, are documents of their own and count as such; an empty table gives an empty one;
    further columns, whatever their names, are not read."""
    found = scratch.keep(aligned(docs.select("doc_id", "text"), byte_level, pieces), "aligned")
    return digests(found, scratch)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`alignment` over all documents; its docstring states nulls, odd texts, repeated rows and empty tables."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), Scratch(spark, "alignment"))
