"""The ten operators against brute force on small tables, and their SQL where there is one."""

import hashlib
import itertools
import random
import re
import string
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from quarrymill.llm import bpe, chat, cover_tree, mixing, near_copies, quality, queries, sharding, simhash, suffix, topk, toxicity, training
from quarrymill.llm.scratch import Scratch

from compare import database, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == rows_of_sql(con, queries.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and ids, and characters of several bytes."""
    rng = random.Random(5)
    words = ["the", "of", "ÄÖ", "漢字", "🙂", "x" * 40, "Zebra", "and so", "1,234.5"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(None, "no id " + passage, None, None, None), (None, None, "en", "a", 0), (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, passage, "en", "b", 1), (3, passage, "en", "b", 1), (3, "other", "en", None, 5)]
    rows += [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) + (passage if k % 3 == 0 else ""), "en", rng.choice("abc"), k) for k in range(4, 40)]
    rows += [(50, "long " * 40_000, "en", "c", 9), (51, "ab" * 3_000, "en", "c", 9)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(df):
    return df.where("false")


# ---- byte-level BPE


@pytest.fixture(scope="module")
def codec(spark):
    return bpe.BytePairCodec(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def test_bpe_equals_the_library_and_decodes(spark, odd_docs, codec):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = odd_docs.select("text", codec.encode(F.col("text")).alias("ids")).withColumn("back", codec.decode(F.col("ids"))).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["back"]).decode() == (r["text"] or "")
    assert bpe.digests(empty(odd_docs), codec).collect() == []
    few = bpe.digests(odd_docs.where("doc_id = 2"), codec).first()
    assert few["n_tokens"] == 0 and few["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_prefix_table_appends_and_edits_exactly():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        encoder = bpe.PrefixEncoder(bpe.read_ranks(f.read()))
    rng = random.Random(2)
    for _ in range(60):
        text = bytes(rng.choice(b"abcdeeee thing") for _ in range(30))
        table, fresh = bpe.PrefixTable(encoder), bpe.PrefixTable(encoder)
        table.append(text[:17])
        table.append(text[17:])
        fresh.append(text)
        assert table.tokens() == fresh.tokens()
        table.replace(12, 15, b"QQ")
        fresh = bpe.PrefixTable(encoder)
        fresh.append(text[:12] + b"QQ" + text[15:])
        assert table.tokens() == fresh.tokens()


# ---- SimHash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_prints_and_components(spark, odd_docs):
    got = simhash.near_duplicates(odd_docs, Scratch(spark, "t")).collect()
    texts = odd_docs.collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in got) == Counter((r["doc_id"], brute_print(r["text"])) for r in texts)
    assert simhash.near_duplicates(empty(odd_docs), Scratch(spark, "t")).collect() == []


@pytest.mark.parametrize("block", [4, 2048])
def test_simhash_links_connect_all_near_prints(spark, monkeypatch, block):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    flips = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(6)]
    prints = sorted({x for x in flips})
    monkeypatch.setattr(simhash, "BLOCK", block)  # local mode forks its workers with the driver's modules unchanged; kernels are tested below
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    found = {(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.links(df, Scratch(spark, "t")).collect()}
    assert all(bin(a ^ b).count("1") <= 4 for a, b in found)
    for a, b in found:
        root[find(a)] = find(b)
    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 4:
                assert find(a) == find(b)


def test_simhash_large_cells_overflow_into_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "BLOCK", 4)
    fp = np.arange(10, dtype=np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(10, 7)), pa.array(fp.view(np.int64))], names=["cell", "fp"])
    out = pa.Table.from_batches(list(simhash._compare(iter([batch.slice(0, 3), batch.slice(3, 7)])))).to_pylist()
    deferred = [r for r in out if r["cell"] is not None]
    assert sorted(r["u"] for r in deferred) == list(range(10)) and {r["block"] for r in deferred} == {0, 1, 2}


def test_simhash_keeps_one_of_each_group(spark, odd_docs):
    kept = simhash.keep_one(odd_docs, Scratch(spark, "t"))
    assert kept.columns == odd_docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.where("doc_id is not null").collect()]
    ids = [i for i, _ in rows]
    assert len(rows) == len(set(rows)) and sorted(t for i, t in rows if i == 3)[0] == "other" and ids.count(3) == 2 and 1 in ids and 2 not in ids


def test_simhash_drops_near_copies_only(spark):
    """Ids that are there more than once, or missing, decide neither that a row leaves nor that it stays."""
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(rng.choice(string.ascii_lowercase) * rng.randint(1, 9) for _ in range(60)) for _ in range(5))
    rows = [(2, a), (5, a), (5, b), (5, c), (5, c), (7, c), (None, d), (None, d), (None, b), (None, e), (9, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], DOCS).repartition(3)
    kept = simhash.keep_one(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(2, a), (5, b), (5, c), (None, d), (9, e)])


@pytest.mark.parametrize("rounds", [1, 3])
def test_near_copies_equal_brute_force(spark, monkeypatch, rounds):
    """Texts with some words replaced, most of them too different for 4 bits of 64: the groups of all pairs of likeness
    0.8 or more."""
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    rng = random.Random(6)
    words = ["w" + str(k) for k in range(400)]
    texts = ["", "one", "One ", "a b c d", "a b c d e f"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([40, 100, 300]))]
        for _ in range(6):
            copy = list(base)
            for at in rng.sample(range(len(base)), rng.randint(0, len(base) // 40)):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    sets = [set(near_copies.set_of(t.encode()).tolist()) for t in texts]
    least = list(range(len(texts)))
    linked = [(a, b) for a in least for b in range(a) if texts[a] and texts[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = near_copies.near_copies(docs, Scratch(spark, "t"), "doc_id").collect()
    assert sorted(map(tuple, found)) == list(enumerate(least))
    wide = [p for p in linked if bin(simhash.fingerprint_of(texts[p[0]].encode()) ^ simhash.fingerprint_of(texts[p[1]].encode())).count("1") > 4]
    assert len(wide) > len(linked) // 4
    kept = simhash.keep_one(docs, Scratch(spark, "t"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least))


# ---- suffix arrays


def test_suffix_array_and_windows():
    rng = random.Random(3)
    for _ in range(150):
        t = np.array([rng.randint(1, rng.choice([2, 3, 20])) for _ in range(rng.randint(1, 60))] + [0])
        assert suffix.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t.tolist()[i:])


def test_suffix_array_of_many_symbols_and_deep_recursion():
    rng = np.random.default_rng(1)
    for t in (rng.integers(1, 2000, 3000), np.tile(rng.integers(1, 5, 40), 30), np.ones(500, int), np.tile([1, 2], 300)):
        t = np.append(t, 0)
        assert suffix.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t.tolist()[i:])


def test_suffix_halves_cover_every_window():
    rng = random.Random(5)
    seg = bytes(rng.choice(b"abcd") for _ in range(168))
    todo, seen = [(seg, 0, 68, 32)], set()
    while todo:
        part, start, x, size = todo.pop()
        assert part == seg[start : start + len(part)]
        if size == 100:
            assert x == 0 and len(part) == 100
            seen.add(start)
            continue
        for _, low, more, at, n in suffix._halves(part, x, size):
            assert 0 <= at and at + n <= 100 + len(more) - 100 and all(s <= at and s + 100 >= at + n for s in range(len(more) - 99))
            todo.append((more, start + low, at, n))
    assert seen == set(range(69))


@pytest.mark.parametrize("bound", [{}, {"SHARD": 400}, {"HOT": 2}, {"SHARD": 400, "HOT": 2}])
def test_suffix_dedup_of_one_gram_with_many_segments(spark, monkeypatch, bound):
    """One line in all documents with other text around it, and some shared text across its ends."""
    for name, value in bound.items():
        monkeypatch.setattr(suffix, name, value)
    rng = random.Random(7)
    line = "".join(rng.choice(string.ascii_letters) for _ in range(140))
    tails = ["".join(rng.choice(string.ascii_letters) for _ in range(80)) for _ in range(4)]
    rows = [(k, "".join(rng.choice(string.ascii_letters) for _ in range(rng.randint(0, 90))) + rng.choice(tails)[-rng.randint(1, 80) :] + line + rng.choice(tails)[: rng.randint(1, 80)] + str(k)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix.digests(suffix.repeated_spans(docs, Scratch(spark, "t"))).collect()
    assert sorted(map(tuple, got)) == brute_cut(rows)


def test_suffix_holds_no_gram_whole():
    """200,000 different segments of one gram: what a task holds stays small, and no segment is lost."""
    import pyarrow as pa

    gram, n = bytes(range(32, 64)), 200_000
    names = suffix._GONE.split()

    def batches():
        for at in range(0, n, 10_000):
            k = range(at, at + 10_000)
            cols = ([1] * 10_000, [b"%068d" % i + gram + b"%068d" % i for i in k], list(k), [0] * 10_000, [0] * 10_000, [0] * 10_000, [68] * 10_000, [32] * 10_000)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    tracemalloc.start()
    out = sum(b.num_rows for b in suffix._cut_repeats(1 << 20)(batches()))
    assert out == 2 * n and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def brute_cut(rows):
    """Of rows (id, text) in order: what suffix dedup leaves, as (id, bytes, removed, spans, digest)."""
    seen, out = set(), []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(left).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = brute_cut(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    got = suffix.digests(suffix.repeated_spans(docs, Scratch(spark, "t"))).collect()
    assert sorted(map(tuple, got)) == expected


def test_suffix_dedup_of_odd_rows(spark, odd_docs):
    some = odd_docs.where("doc_id is null or doc_id <> 50 or n_chars <> 9")
    got = suffix.digests(suffix.repeated_spans(some, Scratch(spark, "t"))).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    brute = brute_cut(sorted(((r["doc_id"], r["text"]) for r in some.collect()), key=key))
    assert sum(r["n_removed"] for r in got) == sum(r[2] for r in brute)
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((r[0], r[1]) for r in brute)
    assert suffix.digests(suffix.repeated_spans(empty(odd_docs), Scratch(spark, "t"))).collect() == []
    cut = suffix.without_repeats(some, Scratch(spark, "t"))
    assert cut.columns == some.columns and cut.count() == some.count()
    assert cut.where("length(text) <> n_chars").isEmpty()


# ---- embeddings


def vectors(spark, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 8))
    rows = [(int(k), [float(x) for x in base[k % 12] + rng.normal(size=8) * rng.choice([0.02, 0.2, 1.0])]) for k in range(150)]
    rows += [(150, rows[3][1]), (151, rows[3][1]), (151, rows[4][1]), (152, None), (153, [0.0] * 8), (154, [float("nan")] + [1.0] * 7), (155, [1.0, None] + [0.0] * 6), (156, []), (157, [1.0, 2.0]), (158, [2.0, 4.0]), (159, [float("inf")] + [0.0] * 7), (None, rows[5][1])]
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string"), rows


def test_cover_tree_links_all_pairs(spark):
    df, rows = vectors(spark)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(df, "vec_id", "embedding", Scratch(spark, "t")).collect())
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    link = np.zeros((len(rows), len(rows)), bool)
    for i, (_, v) in enumerate(rows):
        for j, (_, w) in enumerate(rows):
            if i != j and ok[i] and ok[j] and len(v) == len(w):
                link[i, j] = np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95
    reach = link | np.eye(len(rows), dtype=bool)
    for _ in range(8):
        reach = reach @ reach
    expected = Counter()
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(reach[i]) if rows[j][0] is not None]
        expected[k, int(link[i].sum()), min(ids) if ids else None] += 1
    assert got == expected
    assert cover_tree.near_duplicates(empty(df), "vec_id", "embedding", Scratch(spark, "t")).collect() == []


def test_cover_tree_ships_no_block_with_a_pair(spark, monkeypatch):
    # some 40 blocks of vectors that no centre parts: their pairs hold each block 40 times
    monkeypatch.setattr(cover_tree, "BLOCK", 64)
    monkeypatch.setattr(cover_tree, "SENT", 200 * 16 * 4, raising=False)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    x[1500:] = x[rng.integers(0, 300, 500)] + rng.normal(size=(500, 16)).astype(np.float32) * 0.05
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    wrote = lambda: spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = wrote()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(df, "vec_id", "embedding", Scratch(spark, "t")).collect()}
    assert wrote() - before < 16 * x.nbytes
    y = x.astype(np.float64)
    link = (y @ y.T) / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :] >= 0.95
    reach = link.copy()
    for _ in range(6):
        reach = reach @ reach
    assert got == {k: (int(link[k].sum()) - 1, int(np.flatnonzero(reach[k])[0])) for k in range(2000)} and max(n for n, _ in got.values()) > 1


def test_cover_tree_levels_keep_their_bounds():
    rng = np.random.default_rng(2)
    x = np.repeat(np.repeat(rng.normal(size=(4, 6)), 10, axis=0) + rng.normal(size=(40, 6)) * 0.3, 10, axis=0) + rng.normal(size=(400, 6)) * 0.03
    x /= np.linalg.norm(x, axis=1)[:, None]
    order, levels = cover_tree.build(x)
    y = x[order]
    assert len(levels) > 1
    for start, centre, radius in levels:
        for a, b, c, r in zip(start, np.append(start[1:], len(y)), centre, radius):
            assert np.linalg.norm(y[a:b] - y[c], axis=1).max() <= r + 1e-6


def test_topk_equals_brute_force(spark):
    df, _ = vectors(spark, 3)
    whole = df.where(topk.usable(F.col("embedding"))).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)).alias("vector"))
    rows = [(r["vec_id"], r["vector"]) for r in whole.collect()]
    got = topk.top_k(whole, "vec_id", "vector", F.col("vec_id") % 5 == 0, Scratch(spark, "t"), 7).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for i, (k, v) in enumerate(rows):
        if k is not None and k % 5 == 0:
            scores = sorted(((-int(np.dot(v, w)), j) for m, (j, w) in enumerate(rows) if m != i and len(w) == len(v) and j is not None))
            assert sorted(s for _, _, s in by.get(k, [])) == sorted(-s for s, _ in scores[:7]) or None in [j for j, _ in rows]
    assert topk.top_k(empty(whole), "vec_id", "vector", F.lit(True), Scratch(spark, "t")).collect() == []


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_topk_prunes_without_loss(spread):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 5)) * 20 + spread * 40).astype(np.int64)
    block = {"row": np.arange(300), "id": np.arange(300), "x": x, "wide": x.astype(float), "norm": np.linalg.norm(x, axis=1)}
    by = np.argsort(-block["norm"], kind="stable")
    c = {k: v[by] for k, v in block.items()}
    scores = x @ x.T
    np.fill_diagonal(scores, -(1 << 40))
    least = np.sort(scores, axis=1)[:, -9].astype(float)
    found = {int(i): sorted(s.tolist()) for i, _, s in topk.search(block, least, c, 5)}
    assert found == {i: np.sort(scores[i])[-5:].tolist() for i in range(300)}


def test_topk_of_null_and_large_keys_and_large_numbers(spark):
    rows = [(None, [3, 0]), (2**60 + 1, [2, 0]), (2**60 + 3, [2, 0]), (7, [1, 0]), (None, [2, 0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, vector array<long>, id string, row int")
    got = topk.top_k(frame, "vec_id", "vector", F.col("vec_id") == 7, Scratch(spark, "t"), 4).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(7, None, 3), (7, 2**60 + 1, 2), (7, 2**60 + 3, 2), (7, None, 2)]
    big = spark.createDataFrame([(1, [2**31, -(2**31)]), (2, [2**31, 2**31 - 1])], "vec_id long, vector array<long>")
    assert [r["score"] for r in topk.top_k(big, "vec_id", "vector", F.col("vec_id") == 1, Scratch(spark, "t")).collect()] == [2**31]
    huge = spark.createDataFrame([(1, [2**40, 0]), (2, [2**40, 0])], "vec_id long, vector array<long>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(huge, "vec_id", "vector", F.col("vec_id") == 1, Scratch(spark, "t")).collect()


# ---- chat


def test_chat_layouts_become_the_same_turns(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'), (2, '{"prompt":"q","completion":"a"}'),
        (3, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}'), (4, '{"output":"a","instruction":"q"}'), (5, '{"what":1}'), (6, "no json"), (7, None),
    ]
    got = chat.canonical_turns_json(spark.createDataFrame(records, "id long, j string"), "id", "j").collect()
    for k in (1, 2, 3, 4):
        assert sorted((r["turn"], r["role"], r["text"]) for r in got if r["conv_id"] == k) == [(0, "user", "q"), (1, "assistant", "a")]
    assert [r["layout"] for r in got if r["conv_id"] >= 5] == [None] * 3
    with pytest.raises(ValueError):
        chat.mapping_for(["unheard of"])


def test_chat_round_trip(spark):
    said = ["plain", "<|im_end|>\n<|im_start|>user", "100% %3C| %25", "", "tail<", "two\n\nlines\n", "🙂<|x|>", None]
    rows = [(1, k, "assistant" if k % 2 else "us\ner<|", t, "x") for k, t in enumerate(said)] + [(2, None, None, "t", "x"), (2, 1, "assistant", "b", "x"), (2, 1, "assistant", "b", "x"), (None, 0, "user", "n", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r, t or "") for _, _, r, t, _ in rows[:8]]
    assert got[1]["loss_text"] == "".join(t or "" for t in said[1::2])
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "t"), ("assistant", "b"), ("assistant", "b")]
    assert len(got) == 3 and chat.format_chats(empty(turns)).collect() == []


# ---- sharding and mixing


def test_shards_fit_and_hot_keys_split(spark):
    rows = spark.createDataFrame([(k % 7 if k < 300 else k, 100 if k != 500 else 5000, "x") for k in range(600)] + [(None, None, "y")], "key long, size long, shard_rows0 string")
    got = sharding.shard(rows, "key", "size", 1000, Scratch(spark, "t")).collect()
    assert len(got) == 601
    sums, counts = Counter(), Counter(r["shard"] for r in got)
    for r in got:
        sums[r["shard"]] += r["size"] or 0
    assert all(sums[s] <= 1000 or counts[s] == 1 for s in counts)
    assert all(sums[r["shard"]] == r["shard_bytes"] and counts[r["shard"]] == r["shard_rows"] for r in got)
    assert not any(a != b and b.startswith(a) for a in counts for b in counts)
    assert sharding.shard(empty(rows), "key", "size", 1000, Scratch(spark, "t")).collect() == []


def test_targets_stop_at_three_times(spark):
    own = spark.createDataFrame([("a", 10, 5.0), ("b", 1000, 2.0), (None, 5, 1.0)], "source string, words long, weight double")
    target = {r["source"]: r["target"] for r in mixing.targets(own, 1015).collect()}
    assert target["a"] == 30 and target[None] == 15 and abs(sum(target.values()) - 1015) < 1e-9


def test_places_are_in_order_of_code_points(spark):
    names = ["b", "a", None, "\U0001f642", "\uffff", "Z", "aa"]
    got = mixing.placed(spark.createDataFrame([(n,) for n in names], "source string").repartition(3), "source", Scratch(spark, "t"))
    assert [r["source"] for r in sorted(got.collect(), key=lambda r: r["place"])] == ["Z", "a", "aa", "b", "\uffff", "\U0001f642", None]
    assert sorted(r["place"] for r in got.collect()) == list(range(7))


def test_flow_costs_the_least_of_all_largest_flows():
    """Against every way to send whole words from each pattern to each of its sources."""
    rng = random.Random(12)
    patterns = [("a",), ("b",), ("a", "b"), ("b", "c")]
    for _ in range(25):
        capacity = {p: rng.randint(0, 2) for p in rng.sample(patterns, 3)}
        quota = {s: float(rng.randint(0, 4)) for s in "abc"}
        arcs = [(p, s) for p in capacity for s in p]
        best = None
        for flow in itertools.product(*(range(3 * capacity[p] + 1) for p, _ in arcs)):
            by = dict(zip(arcs, flow))
            used = {p: sum(v for (q, _), v in by.items() if q == p) for p in capacity}
            if any(used[p] > 3 * capacity[p] for p in capacity) or any(sum(v for (_, t), v in by.items() if t == s) > quota[s] for s in quota):
                continue
            key = (-sum(flow), sum(least_cost(capacity[p], used[p]) for p in capacity))
            best = key if best is None else min(best, key)
        flow = mixing.cheapest_flow(capacity, quota)
        used = {p: sum(v for (q, _), v in flow.items() if q == p) for p in capacity}
        assert abs(sum(flow.values()) + best[0]) < 1e-6 and abs(sum(least_cost(capacity[p], used[p]) for p in capacity) - best[1]) < 1e-6


def least_cost(words, used):
    return sum(c * min(words, max(0.0, used - k * words)) for k, c in enumerate(mixing.REPEAT_COST))


def test_overlapping_sources_are_solved_together(spark):
    docs = spark.createDataFrame([(k, 10, s) for k, s in enumerate([["a"], ["a", "b"], ["b"], ["c"], [None], [None, "d"], [], None] * 20)], "doc_id long, size long, sources array<string>")
    got = mixing.mix(docs, "doc_id", "sources", "size", Scratch(spark, "t")).collect()
    assert len(got) == 160 and all(r["taken"] == 0 for r in got if not r["sources"])
    assert all(r["taken"] % 10 == 0 and r["taken"] <= 30 for r in got)
    assert abs(sum(r["taken"] for r in got) - 1200) <= 40


def test_flow_serves_overlapping_sources_cheaply():
    capacity = {("a",): 10, ("a", "b"): 10, ("b",): 10}
    flow = mixing.cheapest_flow(capacity, {"a": 20.0, "b": 10.0})
    assert sum(v for (_, s), v in flow.items() if s == "a") == 20 and sum(v for (_, s), v in flow.items() if s == "b") == 10
    assert all(sum(v for (p, _), v in flow.items() if p == q) <= 10 for q in capacity)  # nothing need be repeated
    more = mixing.cheapest_flow(capacity, {"a": 45.0, "b": 45.0})
    assert abs(sum(more.values()) - 90) < 1e-6


def test_mixing_meets_targets(spark, odd_docs):
    got = mixing.op8_mixing(spark, SF).collect()
    again = mixing.op8_mixing(spark, SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"] or "")) for r in got)
    taken, target, most = Counter(), {}, Counter()
    for r in got:
        s = docs[r["doc_id"]]["source"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        most[s] = max(most[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1 for s in target)
    out = mixing.mixed(odd_docs, Scratch(spark, "t"))
    assert out.columns == odd_docs.columns and out.where("text is null or text = ''").isEmpty()
    assert mixing.mixed(empty(odd_docs), Scratch(spark, "t")).collect() == []


# ---- trained operators


def corpus(spark, n=400):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(string.ascii_lowercase[:9]) for _ in range(rng.randint(3, 8)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        bad, rude = k % 5 == 0, k % 7 == 0
        if bad:
            words = [w + "%%%" for w in words]
        if rude:
            words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwitto", "zorkish", "zorkling"]))
        rows.append((k, " ".join(words), int(not bad), int(rude)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_quality_learns(spark):
    df = corpus(spark)
    model = quality.fit(df.where("doc_id % 3 > 0").select("text", F.col("quality").alias("label")))
    got = df.where("doc_id % 3 = 0").select("quality", quality.score(spark, F.col("text"), model).alias("p")).collect()
    assert sum((r["p"] >= 0.5) == bool(r["quality"]) for r in got) / len(got) > 0.97
    odd = spark.createDataFrame([(None,), ("",), ("x " * 100_000,)], "text string").select(quality.score(spark, F.col("text"), model).alias("p")).collect()
    assert all(0 <= r["p"] <= 1 for r in odd) and odd[0]["p"] == odd[1]["p"]
    none = quality.fit(df.where("false").select("text", F.col("quality").alias("label")))
    assert df.select(quality.score(spark, F.col("text"), none).alias("p")).first()["p"] == 0.5


def test_ftrl_equals_a_plain_loop():
    """The updates, one feature at a time, of follow-the-regularised-leader."""
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 50, 8)), None, int(rng.integers(0, 2))) for _ in range(40)]
    rows = [(at, rng.random(len(at)) * 3, y) for at, _, y in rows]
    z, n, bias, bias_n = Counter(), Counter(), 0.1, 0.0
    a, b, l1, l2 = quality.ALPHA, quality.BETA, quality.L1, quality.L2
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((b + n[i] ** 0.5) / a + l2)
    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            w = {i: weight(i) for i in at}
            slope = 1 / (1 + np.exp(-(bias + sum(w[i] * v for i, v in zip(at, x))))) - y
            for i, v in zip(at, x):
                g = slope * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a * w[i]
                n[i] += g * g
            bias_n += slope * slope
            bias -= 0.1 * slope / (1 + bias_n) ** 0.5
    got = quality.train(rows, 0.1, 2)
    assert np.allclose(got[:50], [weight(i) for i in range(50)], atol=1e-5) and np.isclose(got[-1], bias, atol=1e-5)


def test_grams_hash_words_and_word_pairs():
    grams = quality.Grams()
    one, two, both = (set(grams.indices(t).tolist()) for t in ("alpha", "beta", "alpha beta"))
    assert len(both - one - two) >= 1 and one | two <= both | one
    assert set(grams.indices("beta alpha").tolist()) != both


def test_sample_is_bounded_and_repeats_no_id(spark):
    docs = spark.createDataFrame([(1, "x" * (k % 5)) for k in range(500)] + [(k, "t") for k in range(2, 30)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(30)] + [(1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = training.labelled_sample(docs, labels, "toxic", 4, 2, 10, Scratch(spark, "t")).collect()
    assert 0 < len(got) <= 10
    every = training.labelled_sample(docs, labels, "toxic", 4, 2, 1000, Scratch(spark, "t")).count()
    assert every == docs.where("doc_id is not null").select("doc_id").distinct().where(training.fold(F.col("doc_id"), 4) != 2).count()


def test_toxicity_learns_terms_and_misspellings(spark):
    df = corpus(spark)
    model = toxicity.fit(df.where("doc_id % 3 > 0").select("text", F.col("toxic").alias("label")), Scratch(spark, "t"))
    got = df.where("doc_id % 3 = 0").select("toxic", model.score(spark, F.col("text")).alias("p")).collect()
    assert sum((r["p"] >= 0.3) == bool(r["toxic"]) for r in got) / len(got) > 0.97
    odd = spark.createDataFrame([(None,), ("",), ("you blockhaed blockhea",)], "text string").select(model.score(spark, F.col("text")).alias("p")).collect()
    assert odd[0]["p"] == odd[1]["p"] < 0.3 and 0 <= odd[2]["p"] <= 1
    assert toxicity.fit(df.where("false").select("text", F.col("toxic").alias("label")), Scratch(spark, "t")).terms == []


def test_automaton_equals_edit_distance():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, last = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
        return d[-1]

    rng = random.Random(1)
    terms = ["abcabc", "bcaab", "aacbb", "cab"]
    lexicon = toxicity.Lexicon([(t, False, 1.0) for t in terms])
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
        near = [distance(w, t) for t in terms]
        expected = 0 if min(near) == 0 else 1 if min(d for d, t in zip(near, terms) if len(t) >= 5) == 1 else None
        got = lexicon.match(w)
        assert (got and got[1]) == expected, w
        assert got is None or lexicon.may_match(w)
    stems = toxicity.Lexicon([("abc", True, 1.0)])
    assert stems.match("abcxyz") == (1.0, 0) and stems.match("xabc") is None


def test_quotation_weakens_a_hit():
    lexicon = toxicity.Lexicon([("blockhead", False, 2.0)])
    assert toxicity.features("you blockhead", lexicon)[0] > 0 == toxicity.features("you blockhead", lexicon)[1]
    quoted = toxicity.features('he was called "blockhead" there', lexicon)
    assert quoted[0] == 0 and quoted[1] > 0


def test_held_out_accuracy(spark):
    for query, label, least in ((quality.op9_quality, "quality", 0.95), (toxicity.op7_toxicity, "toxic", 0.9)):
        got = query(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
        assert sum(r["predicted"] == r[label] for r in got) / len(got) >= least


def test_columns_of_any_name_stay(spark):
    """Extra columns named like an operator's own neither clash nor change what it returns."""
    docs = spark.range(40).selectExpr("id as doc_id", "id * 10 as size", "array('a') as sources")
    own = dict.fromkeys("leaf _row _rest _kept _key _bytes _prefix _first _order _p _bin _cut _once b n".split(), F.lit("x"))
    more = docs.withColumns(own | {"shard": F.lit("old"), "taken": F.lit(-1), "target": F.lit(None)})
    plain, clashing = (sharding.shard(d, "doc_id", "size", 2000, Scratch(spark, "test")) for d in (docs, more))
    assert set(own) < set(clashing.columns)
    shown = ["doc_id", "shard", "depth", "shard_bytes", "shard_rows"]
    assert sorted(plain.select(shown).collect()) == sorted(clashing.select(shown).collect())
    plain, clashing = (mixing.mix(d, "doc_id", "sources", "size", Scratch(spark, "test")) for d in (docs, more))
    assert set(own) < set(clashing.columns)
    shown = ["doc_id", "size", "pattern_size", "target", "taken"]
    assert sorted(plain.select(shown).collect()) == sorted(clashing.select(shown).collect())


@pytest.mark.parametrize("n_tasks", [1, 7])
def test_components_of_chains_stars_and_repeated_links(spark, n_tasks):
    from quarrymill.llm.components import components

    rng = np.random.default_rng(5)
    chain = [(int(a), int(b)) for a, b in zip(rng.permutation(300), rng.permutation(300))]
    star = [(1000, k) for k in range(1001, 1400)]
    pairs = [(2000 + 2 * k, 2001 + 2 * k) for k in range(50)] + [(2001, 2000), (5, 5), (9000, 9000)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in chain + star + pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    links = spark.createDataFrame(chain + star + pairs, "u long, v long").repartition(n_tasks)
    found = components(links, Scratch(spark, "test")).collect()
    linked = {x for a, b in chain + star + pairs if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in found} == {x: root(x) for x in linked} and len(found) == len(linked)
    assert components(links.where("false"), Scratch(spark, "test")).isEmpty()
