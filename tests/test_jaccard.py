"""Pairs of like word sets against all pairs, whatever share of the words is counted."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import jaccard as J
from quarrymill.plans import records
from quarrymill.sources.shared import keeper


@pytest.mark.parametrize("counted", [records.MOST_COUNTED, 3, 0])
def test_pairs_equal_all_pairs(spark, monkeypatch, tmp_path, counted):
    monkeypatch.setattr(records, "MOST_COUNTED", counted)
    rng = random.Random(4)
    texts = [" ".join(f"w{x}" for x in rng.sample(range(14), rng.randint(9, 14))) for _ in range(60)] + [None, "", "w1", "w1", "w1 w1"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first, copies = {}, {}
    for k, t in enumerate(texts):
        if s := frozenset((t or "").split()):
            copies[s] = copies.get(s, 0) + 1
            first.setdefault(s, k)
    expected = {(i, j, copies[x], copies[y], round(len(x & y) / len(x | y), 6)) for x, i in first.items() for y, j in first.items() if i < j and 5 * len(x & y) >= 4 * len(x | y)}
    assert {tuple(r) for r in records.near_duplicate_jaccard(spark, str(tmp_path)).collect()} == expected and len(expected) > 50


def test_signatures_never_tell_sets_farther_apart_than_they_are():
    rng = random.Random(5)
    far = 0
    for _ in range(400):
        pool = [rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(1, 700))]
        a, b = (rng.sample(pool, rng.randint(1, len(pool))) for _ in "ab")
        apart = len(set(a) ^ set(b))
        least = J.least_apart(J.signature(np.array(a)), J.signature(np.array(b)))
        assert least <= apart and (least - apart) % 2 == 0
        far += least > len(a) // 9 + len(b) // 9
    assert far > 200


@pytest.mark.parametrize("pairs", [J.PAIRS, 3])
def test_a_set_does_not_travel_with_each_pair(spark, monkeypatch, tmp_path, pairs):
    monkeypatch.setattr(J, "PAIRS", pairs)
    # 120 near copies of one set are 7,140 pairs, and each met another group as well, whose sets are unlike
    rng = random.Random(6)
    words = [rng.getrandbits(63) for _ in range(300)]
    rows = [(k, k // 2 * 2 if k >= 236 else k, sorted({*words[:100], words[100 + k % 7]} if k < 120 else {*rng.sample(words, 90)}), 1 + k % 3) for k in range(240)]
    sets = spark.createDataFrame(rows, "set long, id long, s array<long>, copies long")
    met = spark.range(240).select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id"), F.lit(239))).alias("b")).where("a < b")
    sent, keep = {}, keeper(spark, "test")
    got = {tuple(r) for r in J.verified(met, sets, lambda df, k: sent.setdefault(k, keep(df, k))).collect()}
    by = {k: (i, set(s), n) for k, i, s, n in rows}
    every = [(*sorted((by[x], by[y]), key=lambda v: v[0]),) for x in by for y in by if x < y and by[x][0] != by[y][0]]
    assert got == {(x[0], y[0], x[2], y[2], len(x[1] & y[1]), len(x[1] | y[1])) for x, y in every if 5 * len(x[1] & y[1]) >= 4 * len(x[1] | y[1])} and len(got) >= 7140
    assert 7140 <= sent["near"].count() < 8000 and sent["pairs"].select("home").distinct().count() < 20
