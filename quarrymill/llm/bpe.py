"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece there is exactly one token that its BPE encoding ends with. Storing that token for each
prefix makes encoding a single left-to-right pass, lets text be appended exactly, and lets an edit be re-encoded from
the last unchanged prefix on.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before merging, and the same pattern in the terms of Python's own engine,
#: equal wherever the two engines class every character alike.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""

#: Bytes of pieces, ids and their overhead that a Python worker remembers, and pairs of tokens; beyond them the memory
#: starts afresh. Longer pieces than LONGEST_REMEMBERED characters are worked out whenever they occur.
REMEMBERED_BYTES, PIECE_OVERHEAD, LONGEST_REMEMBERED = 48 << 20, 200, 200
REMEMBERED_PAIRS = 300_000
#: Characters whose pieces are encoded together.
CHUNK_CHARS = 1_000_000
MOST_VOCABULARY_BYTES = 64 << 20


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class PrefixEncoder:
    """Encodes pieces of bytes by the ranks of a vocabulary, as repeated lowest-rank merging would."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.known: dict[int, bool] = {}  # by left token << 32 | right token: whether they stay side by side
        self.usable: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.parts[rank] = (rank, rank)
                self.usable[token] = rank
                continue
            for cut in range(1, len(token)):
                a, b = self.usable.get(token[:cut]), self.usable.get(token[cut:])
                if a is not None and b is not None and a < rank and b < rank and self._meets(a, b):
                    self.parts[rank] = (a, b)
                    self.pairs[a, b] = rank
                    self.usable[token] = rank
                    break
        # any two usable tokens whose bytes join to a token merge, whatever that token's own parts are
        for token, rank in self.usable.items():
            for cut in range(1, len(token)):
                a, b = self.usable.get(token[:cut]), self.usable.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank

    def _meets(self, a: int, b: int) -> bool:
        """Whether the tokens a, b stay side by side. Undoes merges on both sides of the seam, latest first; a merge
        across the seam that would have come before those still to be undone rules the pair out."""
        bound = 1 << 60
        while True:
            joined = self.pairs.get((a, b))
            if joined is not None and joined < bound:
                return False
            undone_left = a > b
            for _ in range(2):
                if undone_left:
                    bound, inner = a, self.parts[a][1]
                    if inner != a:
                        a = inner
                        break
                else:
                    bound, inner = b + 1, self.parts[b][0]
                    if inner != b:
                        b = inner
                        break
                undone_left = not undone_left
            else:
                return True

    def extend(self, piece: bytes, last: list[int], back: list[int]) -> None:
        """last[i], back[i]: the last token of the piece's first i bytes and its length; grows both to the whole."""
        if len(self.known) > REMEMBERED_PAIRS:
            self.known.clear()
        usable, known, longest = self.usable, self.known, self.longest
        for end in range(len(last), len(piece) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = usable.get(piece[start:end])
                if token is not None:
                    if start:
                        pair = last[start] << 32 | token
                        fits = known.get(pair)
                        if fits is None:
                            fits = known[pair] = self._meets(last[start], token)
                        if not fits:
                            continue
                    last.append(token)
                    back.append(end - start)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte of the piece")

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        table = PrefixTable(self)
        table.append(piece)
        return table.tokens()


class PrefixTable:
    """The stored prefixes of one piece: append() and cut() keep the encoding exact without starting over."""

    def __init__(self, encoder: PrefixEncoder):
        self.encoder, self.piece, self.last, self.back = encoder, b"", [-1], [0]

    def append(self, more: bytes) -> None:
        self.piece += more
        self.encoder.extend(self.piece, self.last, self.back)

    def cut(self, length: int) -> None:
        self.piece = self.piece[:length]
        del self.last[length + 1 :], self.back[length + 1 :]

    def replace(self, start: int, end: int, by: bytes) -> None:
        """Edits bytes start:end; only prefixes that reach past `start` are worked out again."""
        tail = self.piece[end:]
        self.cut(start)
        self.append(by + tail)

    def tokens(self) -> list[int]:
        out, at = [], len(self.piece)
        while at:
            out.append(self.last[at])
            at -= self.back[at]
        return out[::-1]


class TextEncoder:
    """Splits text by a pattern and encodes the matches; remembers the pieces it has seen."""

    def __init__(self, raw: bytes, pattern: str):
        self.encoder = PrefixEncoder(read_ranks(raw))
        self.exact = regex.compile(pattern)
        self.seen: dict[str, bytes] = {}  # ids as 32-bit integers
        self.held = 0  # about how many bytes `seen` takes
        self.plain = self.odd = None
        if pattern == PATTERN:
            every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
            unlike: set[str] = set()
            for ours, theirs in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s")):
                unlike |= set(re.findall(ours, every)) ^ set(regex.findall(theirs, every))
            self.plain = re.compile(PLAIN_PATTERN)
            self.odd = re.compile("[" + "".join(map(re.escape, sorted(unlike))) + "\U00010000-\U0010ffff]")

    def pieces(self, text: str) -> list[str]:
        if self.plain is not None and (text.isascii() and not re.search("[\x1c-\x1f]", text) or not self.odd.search(text)):
            return self.plain.findall(text)
        return self.exact.findall(text)

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """New pieces are taken in byte order through one prefix table, so that what neighbours begin with alike is
        worked out once."""
        seen, ranks, table = self.seen, self.encoder.ranks, PrefixTable(self.encoder)
        if self.held > REMEMBERED_BYTES:
            seen.clear()
            self.held = 0
        split, long = [self.pieces(text) for text in texts], []
        new = {piece.encode(): piece for piece in set().union(*split).difference(seen)}
        for piece in sorted(new):
            whole = ranks.get(piece)
            if whole is None:
                table.cut(shared(table.piece, piece))
                table.append(piece[len(table.piece) :])
            seen[new[piece]] = ids = array("i", table.tokens() if whole is None else (whole,)).tobytes()
            if len(piece) > LONGEST_REMEMBERED:
                long.append(new[piece])
            else:
                self.held += len(piece) + len(ids) + PIECE_OVERHEAD
        out = [np.frombuffer(b"".join(map(seen.__getitem__, pieces)), np.int32) for pieces in split]
        for piece in long:
            del seen[piece]
        return out


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    if a[:4] != b[:4]:
        return 0
    least = min(len(a), len(b))
    for at in range(min(4, least), least):
        if a[at] != b[at]:
            return at
    return least


def in_chunks(texts: pa.Array, most_chars: int):
    """Lists of the column's texts, null as empty, of about so many characters."""
    held, n = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        n += len(held[-1])
        if n >= most_chars:
            yield held
            held, n = [], 0
    if held:
        yield held


_held: dict = {}


def _once(kind: str, key, make):
    """One object for a Python worker's life."""
    if (kind, key) not in _held:
        _held[kind, key] = make()
    return _held[kind, key]


class BytePairCodec:
    """Encodes and decodes columns. The vocabulary file is read by the driver and sent to the executors once, after a
    check of its size; its path is the only parameter that names a place."""

    def __init__(self, spark: SparkSession, vocabulary: str, pattern: str = PATTERN):
        with open(vocabulary, "rb") as f:
            raw = f.read(MOST_VOCABULARY_BYTES + 1)
        if len(raw) > MOST_VOCABULARY_BYTES:
            raise ValueError("the vocabulary is too large to be sent to every executor")
        self.sent, self.pattern = spark.sparkContext.broadcast(raw), pattern
        self.key = hashlib.sha256(raw).hexdigest()

    def _coder(self):
        """Functions for tasks: a column of texts to ids, and ids to bytes."""
        sent, key, pattern = self.sent, self.key, self.pattern

        def ids_of(texts: pa.Array) -> pa.ListArray:
            coder = _once("encode", (key, pattern), lambda: TextEncoder(sent.value, pattern))
            kept, offsets = [], [0]
            for some in in_chunks(texts, CHUNK_CHARS):
                for row in coder.encode_many(some):
                    kept.append(row)
                    offsets.append(offsets[-1] + len(row))
            flat = pa.array(np.concatenate(kept) if kept else np.empty(0, np.int32))
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

        def bytes_of(rows: pa.ListArray) -> pa.Array:
            table = _once("decode", key, lambda: {rank: token for token, rank in read_ranks(sent.value).items()})
            return pa.array([b"".join(map(table.__getitem__, row.values.to_numpy(zero_copy_only=False).tolist())) if row.is_valid else b"" for row in rows], pa.binary())

        return ids_of, bytes_of

    def encode(self, text: Column) -> Column:
        """array<int> of token ids; a null text is encoded like an empty one, as no ids."""
        ids_of, _ = self._coder()

        @F.arrow_udf("array<int>")
        def ids(texts: pa.Array) -> pa.Array:
            return ids_of(texts)

        return ids(text)

    def decode(self, ids: Column) -> Column:
        """binary; ids null: no bytes. An id outside the vocabulary fails."""
        _, bytes_of = self._coder()

        @F.arrow_udf("binary")
        def decoded(rows: pa.Array) -> pa.Array:
            return bytes_of(rows)

        return decoded(ids)

    def round_trip(self, text: Column) -> Column:
        """struct<ids, decoded>: encode(text), and what these ids decode to. One call for both, as Spark encodes
        twice where a query reads both encode(text) and decode(encode(text))."""
        ids_of, bytes_of = self._coder()

        @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
        def both(texts: pa.Array) -> pa.Array:
            ids = ids_of(texts)
            return pa.StructArray.from_arrays([ids, bytes_of(ids)], names=["ids", "decoded"])

        return both(text)


def digests(docs: DataFrame, codec: BytePairCodec) -> DataFrame:
    """Of documents (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256. Null and empty texts have no tokens
    and the digests of nothing; very long texts and pieces are encoded whole; repeated rows give repeated rows, null ids
    stay; an empty table gives an empty table."""
    both = docs.select("doc_id", codec.round_trip(F.col("text")).alias("both")).select("doc_id", "both.ids", "both.decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`digests` over all documents; its docstring states nulls, long texts, repeated rows and empty tables. Columns besides
    doc_id and text, whatever their names, are not read."""
    import public_tokenizers

    codec = BytePairCodec(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), codec)
