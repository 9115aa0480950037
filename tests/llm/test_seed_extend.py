"""Runs of repeated words against counting every run of every text."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import seed_extend as S
from quarrymill.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


def counted(texts, length):
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    runs = Counter(tuple(w[k : k + length]) for w in split for k in range(len(w) - length + 1))
    out = []
    for words in split:
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            if runs[tuple(words[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def found(spark, texts, length=S.LENGTH, seed=S.SEED, parts=3):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    return [tuple(r)[1:] for r in S.digests(S.maximal_repeats(docs, Scratch(spark, "test"), length, seed)).orderBy("doc_id").collect()]


def made(seed, n=60):
    """Texts of few words that share passages at odd places, some cut short or changed."""
    rng = random.Random(seed)
    words = ["the", "of", "Äö", "漢字", "x" * 60, "a\x00b", " nbsp", "é"] + [f"w{k}" for k in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.choice([34, 35, 36, 60, 120]))] for _ in range(6)]
    out = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += [rng.choice(words) for _ in range(rng.randint(0, 40))]
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = rng.choice(words)
            if rng.random() < 0.3:
                p = p[rng.randrange(len(p)) :]
            text += p
        out.append(rng.choice([" ", "\n", " \t ", "\x0b"]).join(text) + rng.choice(["", " ", "\r\n"]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_counting(spark, seed):
    texts = made(seed) + [None, "", " \n", "one", "word " * 34, "again " * 35, "once " * 36, "ab cd " * 400, "\u001c".join("pq" for _ in range(80))]
    got = found(spark, texts)
    assert got == counted(texts, S.LENGTH)
    assert sum(r[1] > 0 for r in got) > 20 and sum(0 < r[1] < r[0] for r in got) > 10


def test_repeats_of_the_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert found(spark, texts) == counted(texts, S.LENGTH)


def test_periods_and_few_words(spark):
    """Words of a tiny alphabet: anchors tie and recur within texts."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(40)] + [" ".join("ab"[k // 7 % 2] for k in range(200))]
    assert found(spark, texts, 12, 3) == counted(texts, 12)
    assert found(spark, texts, 12, 12) == counted(texts, 12)


def test_long_texts_in_parts(spark, monkeypatch):
    """Parts cut stretches in two; tables of anchors too small to tell any apart change nothing."""
    monkeypatch.setattr(S, "PART", 50)
    words = [f"w{k}" for k in range(30)]
    rng = random.Random(6)
    texts = [" ".join(rng.choices(words, k=700)) for _ in range(3)]
    texts += [texts[0][400:1500], " ".join(texts[1].split()[13:60]), " ".join(rng.choices(words, k=20) + texts[2].split()[100:141])]
    held = [(place, list(w)) for place, w in S._parts(texts[0], 35)]
    assert all(len(w) <= 50 for _, w in held) and [w for place, ws in held for w in ws[34 if place else 0 :]] == texts[0].split()
    parts = [S.WordHasher()(t.split()) for t in texts]
    pieces = [(k, place, S.WordHasher()(w)) for k, t in enumerate(texts) for place, w in S._parts(t, 35)]
    (text, first, runs, _, _), _ = S.stretches([p for *_, p in pieces])
    covered = Counter((pieces[t][0], pieces[t][1] + f + k) for t, f, n in zip(text, first, runs) for k in range(n))
    assert set(covered.values()) == {1} and len(covered) == sum(max(0, len(p) - 34) for p in parts)
    assert found(spark, texts) == counted(texts, S.LENGTH)


def test_equal_runs_have_equal_anchors():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    (_, first, runs, anchor, _), hashes = S.stretches([words], 12, 4)
    of = {}
    for a, n, g, h in zip(first, runs, np.repeat(anchor, 1), np.split(hashes(np.arange(len(runs))), np.cumsum(runs)[:-1])):
        for k in range(n):
            assert of.setdefault(tuple(words[a + k : a + k + 12]), (g, h[k])) == (g, h[k])


def test_a_hot_passage_and_copies(spark):
    """A third of the texts are one text, many others hold one passage among words of their own."""
    rng = random.Random(8)
    passage, same = [f"p{k}" for k in range(38)], " ".join(f"s{k}" for k in range(90))
    texts = [same] * 80 + [" ".join([f"u{k}-{j}" for j in range(rng.randint(0, 30))] + passage + [f"v{k}-{j}" for j in range(rng.randint(0, 30))]) for k in range(80)]
    texts += [same.replace(f"s{k}", f"changed{k}") for k in range(0, 90, 3)] + [" ".join(passage[:34])]
    assert found(spark, texts, parts=7) == counted(texts, S.LENGTH)


def test_odd_tables(spark):
    text = " ".join(f"w{k}" for k in range(50))
    schema = "doc_id long, text string, uid string, place int, anchor string"
    rows = [(None, text, "x", 1, "y"), (None, text + " more", "x", 1, "y"), (4, text, "x", 1, "y"), (4, text, "x", 1, "y"), (5, "alone " + text.upper(), "x", 1, "y"), (6, None, "x", 1, "y")]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(map(str, (tuple(r) for r in S.digests(S.maximal_repeats(docs, Scratch(spark, "test"))).collect())))
    assert got == sorted(str((r[0], *c)) for r, c in zip(rows, counted([r[1] for r in rows], S.LENGTH)))
    assert S.digests(S.maximal_repeats(docs.where("false"), Scratch(spark, "test"))).collect() == []
    spans = {tuple(r) for r in S.maximal_repeats(docs.where("doc_id is null"), Scratch(spark, "test")).select("doc_id", "n_words", "starts", "stops", "kept").where("n_words > 50").select("n_words", F.col("starts")[0], F.col("stops")[0], "kept").collect()}
    assert spans == {(51, 0, 50, "more")}
