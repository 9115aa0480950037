"""Lexical and vector retrieval, fusion, boosts and diversification over any corpus of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp, tokens

K1, B = 1.2, 0.75
#: Vectors in a block, and blocks of either side that meet under one key.
BLOCK, SIDE = 4096, 4
#: Different words, and pairs of a query and a word, that may be sent to every task.
MOST_SENT, MOST_ASKED = 2_000_000, 500_000
#: Bytes that words are made of, capitals as small letters and all others as spaces; bytes of texts that are cut together.
_WORD = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else 32 for c in range(256))
PIECE = 4 << 20


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """tokens() of all texts of a batch in one row, and their number in each (null: none); texts come from _bytes."""
    raw = [t or b"" for t in texts.to_pylist()]
    ends = [*(np.flatnonzero(np.diff(np.cumsum([len(t) for t in raw]) // PIECE)) + 1), len(raw)]
    words, counts = [], []
    for a, b in zip([0, *ends], ends):
        x = np.frombuffer(b" ".join([b"", *raw[a:b], b""]).translate(_WORD), np.uint8)
        held = x != 32
        edges = np.flatnonzero(held[1:] != held[:-1]) + 1  # where words begin and end in turn, as spaces are around each text
        at = np.cumsum(edges[1::2] - edges[::2], dtype=np.int32)
        words.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(np.int32(0), at)), pa.py_buffer(x[held])]))
        counts.append(np.diff(np.searchsorted(edges[::2], np.cumsum([1, *(len(t) + 1 for t in raw[a:b])]))))
    return pa.concat_arrays(words), np.concatenate(counts)


def _places(words: pa.Array, known: pa.Array | None) -> tuple[np.ndarray, pa.Array]:
    """Each word's place in known, -1 if it is not there, and known; without known, all different words take its place."""
    if known is None:
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary
    return pc.index_in(words, value_set=known).fill_null(-1).to_numpy(), known


def _bytes(docs: DataFrame, text: str, *more: str) -> DataFrame:
    """Texts in UTF-8. Only two letters beyond ASCII have an ASCII letter in lower case; texts with these are lowered here."""
    t = F.col(text)
    return docs.select(*more, F.when(t.contains("\u0130") | t.contains("\u212a"), F.lower(t)).otherwise(t).cast("binary").alias("_text"))


def _sent(words: DataFrame) -> bytes | None:
    """The different words of a table (word), to be known in every task; None where there are more than MOST_SENT."""
    few = words.select("word").distinct().limit(MOST_SENT + 1).toArrow()["word"]
    return None if len(few) > MOST_SENT else " ".join(few.to_pylist()).encode()


def asked_words(docs: DataFrame, key: str, text: str, asks: Column, keep=None) -> tuple[DataFrame, DataFrame]:
    """(key, word) of the rows that ask, and (word, df) of these words by the rows, asking or not, that have them.

    Few rows ask, so their words are found first, and words that none of them has are dropped where they are read, if the
    asked ones are few enough to be known there; what a task has counted is then summed.
    `keep` (table, step) writes a table and reads it back; without it these words are found again by each reader."""
    keep = keep or (lambda df, step: df)
    asked = keep(docs.where(asks).select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("word")), "asked")
    sent = _sent(asked)

    def count(batches):
        known = None if sent is None else pa.array(sent.split(), pa.binary())
        of = lambda names, n: pa.RecordBatch.from_arrays([names.take(pa.array(had := np.flatnonzero(n[:-1]))).cast(pa.string()), pa.array(n[had])], names=["word", "n"])
        names, n = known, None if known is None else np.zeros(len(known) + 1, np.int64)  # the last for unknown words
        for batch in batches:
            words, lens = _cut(batch["_text"])
            ids, names = _places(words, known)
            n = np.zeros(len(names) + 1, np.int64) if known is None else n
            end = np.cumsum(lens)
            for a, b in zip(end - lens, end):
                n[ids[a:b]] += 1  # numpy adds 1 once for equal places
            if known is None:
                yield of(names, n)
        if known is not None:
            yield of(names, n)

    df = _bytes(docs, text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("df"))
    return asked, df.join(asked.select("word"), "word", "left_semi") if sent is None else df


def rare_words(docs: DataFrame, key: str, text: str, asks: Column, k: int = 3, keep=None) -> DataFrame:
    """(query_id, terms) of the rows that ask: their k rarest words that another row has too, ties in code point order."""
    asked, df = asked_words(docs, key, text, asks, keep)
    ranked = top(asked.join(df.where("df > 1"), "word"), [key], ["df", "word"], k)
    return ranked.groupBy(F.col(key).alias("query_id")).agg(F.array_sort(F.collect_list("word")).alias("terms"))


def _read(docs: DataFrame, key: str, text: str, queries: DataFrame) -> DataFrame:
    """(word, key, len, tf) of the words that queries (query_id, terms) hold, and for every row of docs one without a word,
    so that lengths need no reading of their own; len is null if the text is."""
    wanted = queries.select(F.explode("terms").alias("word"))
    sent = _sent(wanted)

    def read(batches):
        known = None if sent is None else pa.array(sent.split(), pa.binary())
        for batch in batches:
            words, lens = _cut(batch["_text"])
            ids, names = _places(words, known)
            met = np.flatnonzero(ids >= 0)
            pairs, tf = np.unique(np.searchsorted(np.cumsum(lens), met, "right") * len(names) + ids[met], return_counts=True)
            row, place = np.divmod(pairs, max(len(names), 1))
            at = pa.array(np.concatenate([np.arange(len(lens)), row]))
            lens = pa.array(lens.astype(np.int32), mask=batch["_text"].is_null().to_numpy(zero_copy_only=False))
            words = pa.concat_arrays([pa.nulls(len(lens), pa.string()), names.take(pa.array(place)).cast(pa.string())])
            yield pa.RecordBatch.from_arrays([words, batch[key].take(at), lens.take(at), pa.array(np.concatenate([np.zeros(len(lens), np.int64), tf]))], names=["word", key, "len", "tf"])

    read_ = _bytes(docs, text, key).mapInArrow(read, f"word string, `{key}` {docs.schema[key].dataType.simpleString()}, len int, tf long")
    if sent is not None:
        return read_
    return read_.where("word is null").unionByName(read_.join(wanted, "word", "left_semi"))


def _postings(read: DataFrame, key: str) -> DataFrame:
    """Postings of what _read gives, those of a key in one place."""
    return read.where("word is not null").repartition(key).groupBy("word", key, "len").agg(F.sum("tf").alias("tf"))


def postings(docs: DataFrame, key: str, text: str, queries: DataFrame) -> DataFrame:
    """(word, key, len, tf) of the words that queries (query_id, terms) hold: words are matched and counted where a text is
    read, and a document's length travels with its postings."""
    return _postings(_read(docs, key, text, queries), key)


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, keep=None) -> DataFrame:
    """query_id, key, score of documents that hold all words of a query.

    queries: (query_id, terms array). Queries meet documents by word, so that no document is scored that lacks all of a
    query's words; few enough queries are sent to where a document's postings are, so that what they have in common is
    counted there and not shuffled. `keep` (table, step) writes a table and reads it back: with it the texts are read for
    their words and the hits found once, else by each reader of the result."""
    keep = keep or (lambda df, step: df)
    read = keep(_read(docs, key, text, queries), "read")
    stats = read.where("word is null").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    wanted = queries.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("word"))
    tf = _postings(read, key)
    few = wanted.limit(MOST_ASKED + 1).count() <= MOST_ASKED
    wanted = wanted.join(tf.groupBy("word").agg(F.count("tf").alias("df")), "word")  # of all columns of tf, so that these are shuffled once
    wanted = F.broadcast(wanted) if few else wanted
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = tf.join(wanted, "word").crossJoin(F.broadcast(stats)).select("query_id", key, "n_terms", part.alias("part"))  # stats is one row
    hits = scored.groupBy("query_id", key, "n_terms").agg(F.count("*").alias("found"), F.sum("part").alias("score"))
    return keep(hits.where("found = n_terms").select("query_id", key, F.round("score", 6).alias("score")), "hits")


def linear(docs: DataFrame, key: str, text: str, queries: DataFrame) -> DataFrame:
    """query_id, key, score by share of words matched, whole phrase and density, of documents with any of the words."""
    wanted = queries.select("query_id", "terms", F.explode("terms").alias("word"))
    met = postings(docs, key, text, queries).join(wanted, "word").groupBy("query_id", key, "terms").agg(F.count("*").alias("found"), F.sum("tf").alias("n"), F.max("len").alias("len"))
    phrase = F.lower(text).contains(F.array_join("terms", " ")).cast("int")
    score = 0.58 * F.col("found") / F.size("terms") + 0.24 * F.coalesce(phrase, F.lit(0)) + 0.18 * F.least(F.lit(1.0), 10 * F.col("n") / F.col("len"))
    return met.join(docs.select(key, text), key).select("query_id", key, F.round(F.greatest(F.lit(0.05), score), 6).alias("score"))


def min_max(rows: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """(x - min) / (max - min) within `by`; 1 where all are equal and positive."""
    lows = rows.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise((F.col(value) > 0).cast("double"))
    return rows.join(lows, by).withColumn(out, F.round(x, 6)).drop("_lo", "_hi")


def top(rows: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def best(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The k first rows of the whole table, with their rank: each task keeps k, and only these are ranked together."""
    few = rows.orderBy(*order).limit(k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def _packed(rows: DataFrame, key: str, vector: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of about BLOCK vectors of one dimension: (dim, name, name_ids, name_x), numbers as bytes; and (dim, blocks)."""

    def pack(group, table):
        x = np.ascontiguousarray(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
        ids = table["i"].to_numpy().astype(np.int64)
        return pa.table({"dim": pa.array([group[0].as_py()], pa.int32()), name: pa.array([group[1].as_py()], pa.int64()), f"{name}_ids": pa.array([ids.tobytes()], pa.binary()), f"{name}_x": pa.array([x.tobytes()], pa.binary())})

    good = rows.select(F.col(key).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where(F.col("i").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    sizes = good.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = good.withColumn("dim", F.size("v")).join(sizes, "dim").withColumn(name, F.pmod(F.xxhash64("i"), "blocks"))
    return dealt.groupBy("dim", name).applyInArrow(pack, f"dim int, {name} long, {name}_ids binary, {name}_x binary"), sizes


def knn(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """query_id, key, similarity, rank: cosine top-k of a stated query set against all rows, itself left out. Null
    vectors and vectors with null components take no part, zero vectors have a cosine of 0, and vectors of unlike
    dimension are not compared.

    Queries (query_id, vector) and vectors are packed into blocks of bounded size; each pair of blocks keeps k results
    of each query. SIDE blocks of queries and SIDE of vectors meet at a time, so that what one task reads for a key does
    not grow with the table, and each block is sent once for every SIDE blocks of the other kind."""
    unit = lambda raw, dim: (x := np.frombuffer(raw, np.float64).reshape(-1, dim)) / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch[c][at].as_py() for c in batch.schema.names}
                qi, ci = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
                qv, cv = unit(row["q_x"], row["dim"]), unit(row["c_x"], row["dim"])
                a, b, s = [], [], []
                for from_ in range(0, len(qi), 512):
                    sims = np.round(qv[from_ : from_ + 512] @ cv.T, 6)
                    for r, mine in enumerate(sims, from_):
                        ok = np.flatnonzero((ci != qi[r]) & (mine >= least))
                        if len(ok) > k:
                            ok = ok[mine[ok] >= np.partition(mine[ok], len(ok) - k)[len(ok) - k]]
                        ok = ok[np.lexsort((ci[ok], -mine[ok]))][:k]
                        a.append(np.full(len(ok), qi[r]))
                        b.append(ci[ok])
                        s.append(mine[ok])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, s)], names=["query_id", key, "similarity"])

    (q, q_sizes), (c, c_sizes) = _packed(queries, "query_id", "vector", "q"), _packed(vectors, key, vector, "c")
    # each block of one kind is sent to every tile of the other
    tiles = lambda sizes, name: sizes.select("dim", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / SIDE).cast("int"))).alias(f"{name}_tile"))
    own = lambda rows, name: rows.withColumn(f"{name}_tile", F.floor(F.col(name) / SIDE).cast("int"))
    q, c = own(q, "q").join(tiles(c_sizes, "c"), "dim"), own(c, "c").join(tiles(q_sizes, "q"), "dim")
    found = q.join(c.hint("merge"), ["dim", "q_tile", "c_tile"]).select("dim", "q_ids", "q_x", "c_ids", "c_x").mapInArrow(run, f"query_id long, {key} long, similarity double")
    return top(found, ["query_id"], [F.desc("similarity"), key], k)


def fuse(lexical: DataFrame, semantic: DataFrame, key: str, alpha: float = 0.7) -> DataFrame:
    """alpha of the semantic and the rest of the lexical score; a hit without semantic score is rescued by its lexical
    score and rank."""
    both = lexical.select("query_id", key, "lex", "lex_rank").join(semantic.select("query_id", key, "sem"), ["query_id", key], "full_outer")
    lex, sem = F.coalesce("lex", F.lit(0.0)), F.coalesce("sem", F.lit(0.0))
    mixed = alpha * sem + (1 - alpha) * lex
    rescued = F.when((sem == 0) & (lex > 0), F.greatest(mixed, 0.82 * lex, 0.84 - 0.04 * (F.col("lex_rank") - 1))).otherwise(mixed)
    return both.select("query_id", key, F.round(lex, 6).alias("lex"), F.round(sem, 6).alias("sem"), F.round(clamp(rescued) + 1e-9, 6).alias("score"))  # 0.7 of six digits often ends in a 5, which doubles round either way


def duplicate_parent_penalty(rows: DataFrame, by: str, parent: str, score: str, key: str) -> DataFrame:
    """Takes min(0.45, 0.32 * n) off the n-th further hit of a parent."""
    n = F.row_number().over(Window.partitionBy(by, parent).orderBy(F.desc(score), key)) - 1
    return rows.withColumn("dup_rank", n).withColumn("penalised", F.round(F.col(score) - F.least(F.lit(0.45), 0.32 * F.col("dup_rank")), 6))


def round_robin(rows: DataFrame, by: str, parent: str, score: str, key: str) -> DataFrame:
    """Positions that take parents in turn, in the order of their best hits."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key))
    depth = F.row_number().over(Window.partitionBy(by, parent).orderBy(F.desc(score), key))
    placed = rows.withColumn("_rank", rank).withColumn("_depth", depth).withColumn("_first", F.min("_rank").over(Window.partitionBy(by, parent)))
    return placed.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("_depth", "_first"))).drop("_rank", "_depth", "_first")


def field_score(term: str, weights: dict[str, float]) -> Column:
    """Sum of the weights of the fields that contain a term."""
    return sum((F.when(F.lower(c).contains(term), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
