"""Cutting texts into chunks and sections; cut places depend on earlier ones, so these run in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

DELIMITERS = ("\n\n", "\n", ". ", "? ", "! ")


def chunk_spans(body: str, size: int = 1200, overlap: int = 200) -> list[tuple[int, int]]:
    """Spans of a stripped text that end behind the last delimiter beyond half the size, or at the size if there is
    none; the next span begins `overlap` before that end. The least size is 32, an overlap is at most half the size."""
    size, at, out = max(32, size), 0, []
    overlap = max(0, min(overlap, size // 2))
    while at < len(body):
        piece, end = body[at : at + size], min(len(body), at + size)
        if end < len(body):
            places = [place + len(d) for d in DELIMITERS if (place := piece.rfind(d)) > 0]
            end = at + max((p for p in places if p > size * 0.5), default=size)
        if not body[at:end].strip():
            break
        out.append((at, end))
        if end == len(body):
            break
        at = end - overlap
    return out


def chunks(docs: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """key, chunk, start, stop, text of every chunk; places count in the stripped text; null and blank texts have none."""

    def run(batches):
        for pdf in batches:
            bodies = zip(pdf[key], (t.strip() if t else "" for t in pdf[text]))
            rows = [(k, n, a, b, t[a:b].strip()) for k, t in bodies for n, (a, b) in enumerate(chunk_spans(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "start", "stop", "text"])

    return docs.select(key, text).mapInPandas(run, f"{key} long, chunk int, start int, stop int, text string")


def sections(text: str) -> list[tuple[str, str, str]]:
    """(title, path of titles, body) of each heading; text before the first is dropped."""
    out, stack, title, body = [], [], None, []
    for line in [*text.split("\n"), "# "]:
        marks = len(line) - len(line.lstrip("#"))
        if 0 < marks <= 6 and line[marks : marks + 1] == " ":
            if title is not None:
                out.append((title, " > ".join(t for _, t in stack), "\n".join(body).strip()))
            title, body = line[marks:].strip(), []
            stack = [(m, t) for m, t in stack if m < marks] + [(marks, title)]
        else:
            body.append(line)
    return out
