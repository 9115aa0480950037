"""Queries of the library's own operators and the SQL that each is checked against."""

from __future__ import annotations

from . import entities, events, graph, knowledge, memory, mentions, notes, records, retrieval, selection, text, timed

_ALL = {**retrieval.QUERIES, **text.QUERIES, **graph.QUERIES, **events.QUERIES, **records.QUERIES, **knowledge.QUERIES, **memory.QUERIES, **entities.QUERIES, **mentions.QUERIES, **timed.QUERIES, **notes.QUERIES, **selection.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
