"""Token alignment against a plain alignment by offsets, on whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarrymill.llm import token_alignment as T
from quarrymill.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def raw(path):
    with open(path, "rb") as f:
        return f.read()


def byte_table():
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def by_offsets(texts):
    """The contract on whole texts with the libraries, by cumulative ends; counts over all texts."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    table = byte_table()

    def b_bytes(i):
        p = b_model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    rows, counts = [], Counter()
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        a_parts, b_parts = [bytes(table[c] for c in a_model.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
        if not text or b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            rows.append(None)
            continue
        groups, i, j, ai, bj = [], 0, 0, 0, 0
        while i < len(a):
            left, right = [a[i]], [b[j]]
            ai, bj, i, j = ai + len(a_parts[i]), bj + len(b_parts[j]), i + 1, j + 1
            while ai != bj:
                if ai < bj:
                    left.append(a[i])
                    ai, i = ai + len(a_parts[i]), i + 1
                else:
                    right.append(b[j])
                    bj, j = bj + len(b_parts[j]), j + 1
            groups.append((left, right))
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        counts.update(links.keys())
        rows.append((a, b, groups, links))
    highest = {}
    for (x, _), n in counts.items():
        highest[x] = max(n, highest.get(x, 0))
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = row
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for (x, y), n in links.items() if counts[x, y] == highest[x])
        out.append((len(a), len(b), len(groups), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def checked(spark, texts, most_sent=T.MOST_SENT_PAIRS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = Scratch(spark, "test").keep(T.aligned(docs, A, B), "aligned")
    got = sorted(tuple(r) for r in T.digests(found, Scratch(spark, "test"), most_sent).collect())
    assert got == [(k, *row) for k, row in enumerate(by_offsets(texts))]
    return got


ODD = [
    None, "", " ", "  ", "a", "trailing ", "trailing   ", "  leading", "\n", "\t\n x  \n\n y ", "<|endoftext|> plain <s> </s> <unk>", "▁ mark", "ab▁cd ef", "é é ﬁ Ω", "　wide  space​ x᠎ y﻿ z",
    "漢字 かな \U0001f642\U0001f642 \U0001f468‍\U0001f469‍\U0001f467", "\x00\x01 \x1c \x1f \x85 end", "it's we'll I'd 's", "x" * 3000, "ab" * 2000 + " " + "!" * 500, " " * 700 + "q" + " " * 33, "12345 67,890.12", "\r\n\r\n  \r\n",
]


@pytest.mark.parametrize("most_sent", [T.MOST_SENT_PAIRS, 40, 0])
def test_alignment_of_odd_texts(spark, most_sent):
    rng = random.Random(3)
    words = ["the", "of", "ÄÖ", "漢字", "\U0001f642", "x" * 40, "Zebra", "and so", "1,234.5", "\n", "  "]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    got = checked(spark, ODD + made + made[:7], most_sent)
    assert sum(row[1] == 0 for row in got) >= 3 and max(row[5] for row in got) > 0


def test_alignment_of_the_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    checked(spark, texts)


def test_parts_of_a_batch_and_forgetting(spark, monkeypatch):
    """The same rows when texts are taken a few at a time and what was worked out is forgotten in between."""
    aligner = T.Aligner(T.ByteLevelTokenizer(raw(A)), T.PieceTokenizer(raw(B)))
    texts = [t or "" for t in ODD]
    once = [(*r[:4], r[4].tolist(), r[5].tolist()) for r in aligner.align(texts)]
    for name, value in (("MOST_TRANSITIONS", 5), ("REMEMBERED_BYTES", 50), ("LONGEST_REMEMBERED", 2), ("LARGE_GROUP", 1), ("JOINED", 3)):
        monkeypatch.setattr(T, name, value)
    again = [(*r[:4], r[4].tolist(), r[5].tolist()) for t in texts for r in aligner.align([t])]
    assert once == again


def test_stretches_make_the_text():
    for text in filter(None, ODD + ["plain words here", "two  spaces", "tab\t after", "x ", " y"]):
        stretches = T.stretches_of(text)
        assert "".join(" " + s for s in stretches) == " " + text
        assert stretches == [s[1:] for s in T.CUT.split(" " + text)]


def test_transducer_closes_groups_only_on_nothing_left():
    side_a, side_b = [b"ab", b"c", b"abc"], [b"a", b"bc", b"abc", b"x"]
    t = T.DanglingSuffix(side_a, side_b)
    assert t.groups([0, 1, 2], [0, 1, 2]) == ([2, 3], [2, 3])
    assert t.groups([0, 1], [3, 1]) is None and t.groups([0], [0]) is None and t.groups([2], [2, 0]) is None
    assert t.groups([], []) == ([], [])


def test_odd_tables(spark):
    schema = "doc_id long, text string, uid string, a int, n_a int"
    docs = spark.createDataFrame([(None, "no id", "x", 1, 2), (None, "no id", "x", 1, 2), (5, "twice here", "x", 1, 2), (5, "twice here", "x", 1, 2), (5, None, "x", 1, 2)], schema)
    got = T.alignment(docs, A, B, Scratch(spark, "test")).collect()
    want = by_offsets(["no id", "no id", "twice here", "twice here", None])
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *w)) for i, w in zip((None, None, 5, 5, 5), want))
    assert T.alignment(docs.where("false"), A, B, Scratch(spark, "test")).collect() == []
