"""Timed text: caption files to segments, segments to chunks within chapters; and windows of neighbouring chunks.

What a caption merges with, and where a chunk ends, depends on what was kept before. Both folds read the rows of a video
in order and hold one segment or one open chunk, so that a video of any length takes no more memory than a short one.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands in caption files.
STAMPS = re.compile(r"(?P<start>(?:\d+:)?\d{2}:\d{2}[.,]\d{3})\s+-->\s+(?P<end>(?:\d+:)?\d{2}:\d{2}[.,]\d{3})")
HEADS = ("Kind:", "Language:", "NOTE")
TARGET_CHARS, MOST_CHARS, TARGET_SECONDS, MOST_SECONDS = 1200, 1400, 60, 90
SEGMENT = "start double, end double, text string"


def clean_caption(text: str | None) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text or "").replace("&nbsp;", " ")).strip()


def seconds(stamp: str) -> float:
    *hours, minutes, rest = stamp.replace(",", ".").split(":")
    return int(hours[0] if hours else 0) * 3600 + int(minutes) * 60 + float(rest)


def cues(raw: str | None) -> list[tuple[float, float, str]]:
    """(start, end, text) of each cue: the lines behind its time stamps, up to a blank line or the next stamps."""
    out, times, lines = [], None, []
    for line in [*(x.strip("\ufeff").strip() for x in (raw or "").splitlines()), ""]:
        if line.upper().startswith("WEBVTT") or line.startswith(HEADS):
            continue
        stamps = STAMPS.search(line)
        if stamps or not line:
            if times and (text := clean_caption(" ".join(lines))):
                out.append((*times, text))
            times, lines = (tuple(round(seconds(stamps[k]), 3) for k in ("start", "end")) if stamps else None), []
        elif times:
            lines.append(line)
    return out


def parse_captions(raw: Column) -> Column:
    """array<struct<start, end, text>> of a caption file; null and other texts have none."""

    @F.arrow_udf("array<struct<start: double, end: double, text: string>>")
    def parsed(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("text", pa.string())]))
        return pa.array([[dict(zip(("start", "end", "text"), c)) for c in cues(t)] for t in texts.to_pylist()], kind)

    return parsed(raw)


def merged(segments):
    """(start, end, text) in order, each merged into the one kept before where one text holds the other: the longer text,
    the earlier start, the later end. Without a start or text a segment is left out; an end before the start is the start."""
    kept = None
    for start, end, text in segments:
        text = clean_caption(text)
        if not text or start is None:
            continue
        end = start if end is None or end < start else end
        start, end = round(start, 3), round(end, 3)
        if kept is not None and text == kept[2]:
            kept = (kept[0], max(kept[1], end), text)
        elif kept is not None and (text in kept[2] or kept[2] in text):
            kept = (min(kept[0], start), max(kept[1], end), text if len(text) >= len(kept[2]) else kept[2])
        else:
            if kept is not None:
                yield kept
            kept = (start, end, text)
    if kept is not None:
        yield kept


def packed(segments, overlap: int = 1):
    """(start, end, chapter, text) of chunks of segments (start, end, text, chapter): a chunk ends where the chapter
    changes, or with the segment that brings it to the wanted seconds or characters; its last `overlap` segments then
    begin the next one, and are a chunk of their own where nothing follows."""
    here: list = []

    def chunk():
        return here[0][0], here[-1][1], here[0][3], "\n".join(s[2] for s in here)

    for segment in segments:
        if here and segment[3] != here[0][3]:
            yield chunk()
            here = []
        here.append(segment)
        if len(here) == 1:
            continue
        long = max(0.0, here[-1][1] - here[0][0])
        chars = sum(len(s[2]) for s in here) + len(here) - 1
        if long >= min(TARGET_SECONDS, MOST_SECONDS) or chars >= min(TARGET_CHARS, MOST_CHARS):
            yield chunk()
            here = here[-overlap:] if overlap else []
    if here:
        yield chunk()


def _folded(rows: DataFrame, video: str, order: list[str], columns: list[str], fold, out: str) -> DataFrame:
    """fold (rows to rows) over each video's rows in order, a row at a time; the results are numbered within a video."""
    kinds = dict(rows.dtypes)
    names = [video, "n", *[c.split()[0] for c in out.split(", ")]]

    def run(batches):
        def read():
            for batch in batches:
                yield from zip(batch[video].to_pylist(), *(batch[c].to_pylist() for c in columns))

        source, held = read(), []
        ahead = next(source, None)
        while ahead is not None:
            now = ahead[0]

            def own():
                nonlocal ahead
                while ahead is not None and ahead[0] == now:
                    row, ahead = ahead, next(source, None)
                    yield row[1:]

            for n, row in enumerate(fold(own())):
                held.append((now, n, *row))
                if len(held) >= 5_000:
                    yield batch_of(held)
                    held = []
        if held:
            yield batch_of(held)

    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array(c) if k != len(names) - 1 else pa.array(c, pa.string()) for k, c in enumerate(zip(*held))], names=names)

    ordered = rows.repartition(video).sortWithinPartitions(video, *order)
    return ordered.select(video, *columns).mapInArrow(run, f"{video} {kinds[video]}, n long, {out}")


def merge_segments(segments: DataFrame, video: str, *order: str) -> DataFrame:
    """(video, n, start, end, text) of segments (video, start, end, text) in the order of the columns named."""
    rows = segments.where(F.col(video).isNotNull()).withColumns({"start": F.col("start").cast("double"), "end": F.col("end").cast("double")})
    return _folded(rows, video, list(order), ["start", "end", "text"], merged, SEGMENT)


def with_chapters(segments: DataFrame, chapters: DataFrame, video: str, point: str = "start") -> DataFrame:
    """segments with chapter (-1: none) and chapter_title: the first chapter (video, chapter, start, end, title) that has
    begun and not ended at the point; a chapter without an end goes on, one without a start counts for nothing. Points
    meet only their own video's chapters, which travel with them as one list."""
    chapter = F.struct("chapter", F.col("start").cast("double").alias("a"), F.col("end").cast("double").alias("b"), F.coalesce(F.trim("title"), F.lit("")).alias("title"))
    listed = chapters.where("start is not null").groupBy(video).agg(F.array_sort(F.collect_list(chapter)).alias("_chapters"))
    at = F.col(point).cast("double")
    open_ = F.filter("_chapters", lambda c: (c["a"] <= at) & (c["b"].isNull() | (at < c["b"])))
    rows = segments.join(listed, video, "left").withColumn("_c", F.get(open_, F.lit(0)))
    return rows.withColumns({"chapter": F.coalesce(F.col("_c.chapter"), F.lit(-1)), "chapter_title": F.coalesce(F.col("_c.title"), F.lit(""))}).drop("_chapters", "_c")


def caption_chunks(segments: DataFrame, chapters: DataFrame, video: str, *order: str) -> DataFrame:
    """(video, n, start, end, chapter, text): chunks of merged segments that end with their chapter."""
    rows = with_chapters(merge_segments(segments, video, *order), chapters, video)
    return _folded(rows.withColumn("chapter", F.col("chapter").cast("long")), video, ["n"], ["start", "end", "text", "chapter"], packed, "start double, end double, chapter long, text string")


# ---- windows of neighbouring chunks


def parent_windows(hits: DataFrame, chunks: DataFrame, size: int = 3) -> DataFrame:
    """(hit_id, parent, first, last, passage) for hits (hit_id, parent, chunk): the `size` chunks of the parent around the
    one nearest to the hit's, the earlier of two as near. At an edge the window is moved, not cut; a parent of fewer
    chunks is taken whole. chunks: parent, chunk, text and, if there, section. Hits of parents without chunks have no row.

    Chunks are numbered within their parent, hits put among them by number, and the window's places joined by equality."""
    section = F.coalesce(F.trim("section"), F.lit("")) if "section" in chunks.columns else F.lit("")
    inside = Window.partitionBy("parent")
    order = inside.orderBy("chunk", "text")
    placed = chunks.where("parent is not null").select("parent", "chunk", F.coalesce("text", F.lit("")).alias("text"), section.alias("section"))
    placed = placed.withColumns({"place": F.row_number().over(order) - 1, "n": F.count("*").over(inside)})
    marks = placed.groupBy("parent", "chunk").agg(F.min("place").alias("place"), F.max("n").alias("n")).withColumn("hit_id", F.lit(None).cast(dict(hits.dtypes)["hit_id"]))
    asked = hits.where("parent is not null and hit_id is not null").select("parent", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("n"), "hit_id")
    known = F.when(F.col("place").isNotNull(), F.struct("chunk", "place", "n"))
    up = inside.orderBy(F.col("chunk"), F.col("place").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    down = inside.orderBy(F.col("chunk"), F.col("place").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    among = marks.select("parent", "chunk", "place", "n", "hit_id").unionByName(asked).withColumns({"below": F.last(known, ignorenulls=True).over(up), "above": F.first(known, ignorenulls=True).over(down)})
    here, below, above = F.col("chunk"), F.col("below"), F.col("above")
    near = F.when(above.isNull() | (here - below["chunk"] <= above["chunk"] - here), below).otherwise(above)
    found = among.where("hit_id is not null").select("hit_id", "parent", near.alias("near")).where("near is not null")
    last = F.least(F.col("near.n"), F.greatest(F.lit(0), F.col("near.place") - size // 2) + size)
    spans = found.select("hit_id", "parent", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), last - size), last - 1)).alias("place"))
    shown = F.concat(F.lit("[chunk "), F.col("chunk"), F.lit("]"), F.when(F.col("section") != "", F.concat(F.lit(" ["), F.col("section"), F.lit("]"))).otherwise(""), F.lit("\n"), F.col("text"))
    rows = spans.join(placed.withColumn("place", F.col("place").cast("long")), ["parent", "place"]).select("hit_id", "parent", "place", "chunk", shown.alias("shown"))
    passage = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "shown"))), lambda x: x["shown"]), "\n\n")
    return rows.groupBy("hit_id", "parent").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"), passage.alias("passage"))
