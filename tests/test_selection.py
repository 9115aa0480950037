"""Constrained orders and selections against plain loops and literal cases."""

import random
from collections import defaultdict

import pytest

from quarrymill.operators import selection as S


def test_guard_keeps_listed_ones_down():
    # the third and second are best now; the third may not rise
    assert S.guard([(3, True), (2, False), (1, False)]) == [2, 1, 3]
    assert S.guard([(3, False), (2, False), (1, False)]) == [3, 2, 1]
    assert S.guard([(2, True), (3, True), (1, False)]) == [1, 2, 3]
    assert S.guard([(1, True), (3, False), (2, True)]) == [1, 3, 2]
    rng = random.Random(1)
    for _ in range(300):
        listed = set(rng.sample(range(1, 9), rng.randint(0, 2)))
        order = [(k, k in listed) for k in rng.sample(range(1, 9), 8)]
        out = S.guard(order)
        assert sorted(out) == list(range(1, 9)) and all(out.index(rank) + 1 >= rank for rank, guarded in order if guarded)
        free = [rank for rank, guarded in order if not guarded]
        assert [rank for rank in out if rank in free] == free


def test_rerank_equals_a_plain_loop(spark):
    rng = random.Random(2)
    hits = [(q, 100 * q + k, k + 1, rng.choice([None, 0.1, 0.2, 0.3, rng.random()]), rng.choice([None, True, False])) for q in range(12) for k in range(rng.randint(1, 9))] + [(None, 1, 1, 0.5, True)]
    got = {(r["query_id"], r["item"]): (r["rank"], r["new_rank"], r["delta"]) for r in S.guarded_rerank(spark.createDataFrame(hits, "query_id long, item long, rank int, score double, guarded boolean").repartition(3), 6).collect()}
    expected = {}
    for q in range(12):
        own = [h for h in hits if h[0] == q][:6]
        new = S.guard([(h[2], bool(h[4])) for h in sorted(own, key=lambda h: (h[3] is None, -(h[3] or 0), h[2]))])
        expected |= {(q, h[1]): (h[2], new.index(h[2]) + 1, new.index(h[2]) + 1 - h[2]) for h in own}
    assert got == expected and any(d < 0 for _, _, d in got.values())


def test_a_missing_role_evicts_the_least():
    selected = [(1, "a", 3.0, False), (2, "b", 1.0, False), (3, "a", 1.0, False)]
    outsiders = [(4, "c", 0.5, False), (5, "d", 9.0, True), (6, "d", 9.0, False), (7, "e", 0.1, False)]
    assert S.cover(selected, outsiders, ["a", "c"], 3) == ([(1, "a", 3.0, False), (3, "a", 1.0, False), (4, "c", 0.5, False)], [(2, "b", 1.0, False)])
    assert S.cover(selected, outsiders, ["c"], 4)[1] == []
    assert S.cover(selected, outsiders, ["d", "z"], 3) == (selected, [])  # the first of role d is pruned, none has z
    kept, gone = S.cover(selected, outsiders, ["c", "e"], 3)
    assert [r[0] for r in kept] == [1, 3, 7] and [r[0] for r in gone] == [2, 4]


@pytest.mark.parametrize("limit", [1, 3, 6])
def test_selection_equals_folding_all_candidates(spark, limit):
    rng = random.Random(limit)
    rows = [(t, 1000 * k + ord(t), k + 1, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, rng.random()]), rng.choice([None, False, False, True])) for t in "pqr" for k in range(25)]
    frame = spark.createDataFrame([*rows, (None, 1, 1, "b", 1.0, False)], "topic string, item long, rank int, role string, score double, pruned boolean").repartition(4)
    roles, got = ["b", "c", "d"], defaultdict(list)
    for r in S.covering_selection(frame, roles, limit).collect():
        got[r["topic"]].append((r["rank"], r["verdict"]))
    for topic in "pqr":
        own = [(r[2], r[3] or "", r[4] or 0.0, bool(r[5])) for r in rows if r[0] == topic]
        chosen = [r for r in own if not r[3]][:limit]
        kept, gone = S.cover(chosen, [r for r in own if r not in chosen], roles, limit)
        assert sorted(got[topic]) == sorted([(r[0], "kept" if r in chosen else "added") for r in kept] + [(r[0], "demoted") for r in gone if r in chosen])
    assert limit > 1 or any(v == "added" for found in got.values() for _, v in found)


def test_empty_tables(spark):
    assert S.guarded_rerank(spark.createDataFrame([], "query_id long, item long, rank int, score double, guarded boolean"), 3).collect() == []
    assert S.covering_selection(spark.createDataFrame([], "topic string, item long, rank int, role string, score double, pruned boolean"), ["a"], 3).collect() == []
