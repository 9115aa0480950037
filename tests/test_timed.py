"""Captions, chapters and windows against plain loops and literal cases."""

import random

import pytest

from quarrymill.operators import timed as V

VTT = """﻿WEBVTT
Kind: captions

NOTE a comment

00:01.000 --> 00:03.500
Hello <b>there</b>&nbsp;friend

1:00:00,250 --> 1:00:02.000 align:start
second  line
goes on
00:05.000 --> 00:06.000
third without blank

stray text
00:07.000 --> 00:08.000

"""


def test_captions_are_parsed(spark):
    rows = spark.createDataFrame([(1, VTT), (2, None), (3, "no captions")], "id long, raw string")
    got = {r["id"]: [tuple(c) for c in r["c"]] for r in rows.select("id", V.parse_captions(rows["raw"]).alias("c")).collect()}
    assert got == {1: [(1.0, 3.5, "Hello there friend"), (3600.25, 3602.0, "second line goes on"), (5.0, 6.0, "third without blank")], 2: [], 3: []}


def test_segments_merge_with_the_one_kept_before():
    assert list(V.merged([(1, 2, "a b"), (2, 3, "a b"), (2.5, 2.0, "x a b y"), (0.5, 9, "b"), (10, None, "other"), (None, 1, "lost"), (11, 12, "  "), (12, 13, "<i>other</i>")])) == [(0.5, 9, "x a b y"), (10, 13, "other")]


def made(seed, n):
    rng = random.Random(seed)
    words = ["one", "two", "three", "<i>four</i>", "", "five " * 40]
    return [(rng.choice([1, 1, 1, 2, 3, None]), k, rng.choice([None, *[k * 2.0 + rng.random()] * 9]), rng.choice([None, k * 2.0 + 2, 0.5]), " ".join(rng.choices(words, k=rng.randint(0, 6)))) for k in range(n)]


def test_chunks_equal_plain_loops(spark):
    rows = made(3, 700)
    chapters = [(1, 0, 0.0, 300.0, "a"), (1, 1, 250.0, 600.0, " b "), (1, 2, 900.0, None, "c"), (2, 0, None, 9.0, "never"), (2, 1, 400.0, 500.0, None), (9, 0, 0.0, None, "other")]
    segments = spark.createDataFrame(rows, "video long, at long, start double, end double, text string").repartition(5)
    frame = spark.createDataFrame(chapters, "video long, chapter long, start double, end double, title string")
    got = sorted(tuple(r) for r in V.caption_chunks(segments, frame, "video", "at").collect())
    expected = []
    for video in (1, 2, 3):
        kept = list(V.merged(r[2:] for r in sorted((r for r in rows if r[0] == video), key=lambda r: r[1])))

        def chapter(t):
            return next((c for v, c, a, b, _ in chapters if v == video and a is not None and a <= t and (b is None or t < b)), -1)

        here, out = [], []
        for s in kept:
            if here and chapter(here[0][0]) != chapter(s[0]):
                out.append(here)
                here = []
            here = [*here, s]
            if len(here) > 1 and (max(0, here[-1][1] - here[0][0]) >= 60 or sum(len(x[2]) for x in here) + len(here) - 1 >= 1200):
                out.append(here)
                here = here[-1:]
        out += [here] if here else []
        expected += [(video, n, c[0][0], c[-1][1], chapter(c[0][0]), "\n".join(x[2] for x in c)) for n, c in enumerate(out)]
    assert got == expected and {r[4] for r in got} == {-1, 0, 1, 2} and len(got) > 20


def test_first_open_chapter_counts(spark):
    chapters = spark.createDataFrame([(1, 0, 0.0, 10.0, "a"), (1, 1, 5.0, None, " b "), (1, 2, 6.0, 7.0, "c")], "video long, chapter long, start double, end double, title string")
    points = spark.createDataFrame([(1, -1.0), (1, 0.0), (1, 6.5), (1, 10.0), (1, 99.0), (2, 1.0), (1, None)], "video long, start double")
    got = {(r["video"], r["start"]): (r["chapter"], r["chapter_title"]) for r in V.with_chapters(points, chapters, "video").collect()}
    assert got == {(1, -1.0): (-1, ""), (1, 0.0): (0, "a"), (1, 6.5): (0, "a"), (1, 10.0): (1, "b"), (1, 99.0): (1, "b"), (2, 1.0): (-1, ""), (1, None): (-1, "")}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9])
def test_windows_equal_a_plain_loop(spark, size):
    rng = random.Random(size)
    chunks = [("p", k, f"t{k}", None) for k in (0, 1, 2, 5, 6, 9)] + [("q", k, f"q{k}", "sec") for k in range(3)] + [("r", 4, "only", ""), (None, 1, "x", None)]
    hits = [(k, rng.choice("pqr"), rng.choice([None, *range(-1, 12)])) for k in range(40)] + [(90, "none", 1), (91, None, 1), (None, "p", 1)]
    got = {r["hit_id"]: (r["parent"], r["first"], r["last"], r["passage"]) for r in V.parent_windows(spark.createDataFrame(hits, "hit_id long, parent string, chunk int"), spark.createDataFrame(chunks, "parent string, chunk int, text string, section string"), size).collect()}
    expected = {}
    for hit, parent, chunk in hits:
        own = [c for c in chunks if c[0] == parent and parent]
        if hit is None or not own:
            continue
        at = min(range(len(own)), key=lambda k: abs(own[k][1] - (chunk or 0)))
        left = max(0, at - size // 2)
        right = min(len(own), left + size)
        own = own[max(0, right - size) : right]
        expected[hit] = (parent, own[0][1], own[-1][1], "\n\n".join(f"[chunk {c[1]}]{' [' + c[3] + ']' if c[3] else ''}\n{c[2]}" for c in own))
    assert got == expected


def test_empty_tables(spark):
    segments = spark.createDataFrame([], "video long, at long, start double, end double, text string")
    chapters = spark.createDataFrame([], "video long, chapter long, start double, end double, title string")
    assert V.caption_chunks(segments, chapters, "video", "at").collect() == []
    assert V.parent_windows(spark.createDataFrame([], "hit_id long, parent long, chunk int"), spark.createDataFrame([], "parent long, chunk int, text string")).collect() == []
