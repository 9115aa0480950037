"""Conversations as timed text, and passages around hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions import text as T
from ..operators import timed as V
from ..sources.tables import table
from .memory import MOST_DOCUMENTS, shared_words
from .text import CHUNK_CTES

WINDOW = 3


def caption_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a recording: a line of a turn is a segment that lasts as long as it takes to say, four turns
    are a chapter. Where a chunk ends depends on the one before, so this is tested against plain loops and has no SQL."""
    turns = table(spark, d, "conversations").where("conv_id is not null")
    lines = turns.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    until = Window.partitionBy("conv_id").orderBy("turn", "line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("end", F.round(F.sum(F.length("text") / 15).over(until), 3)).withColumn("start", F.round(F.col("end") - F.length("text") / 15, 3))
    chapters = lines.groupBy("conv_id", F.floor(F.col("turn") / 4).alias("chapter")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.concat(F.lit("turns from "), F.min("turn")).alias("title"))
    chunks = V.caption_chunks(lines, chapters, "conv_id", "turn", "line")
    return chunks.select("conv_id", "n", "start", "end", "chapter", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def parent_context(spark: SparkSession, d: str) -> DataFrame:
    """Three chunks around every chunk that holds a word asked for by a document whose id is divisible by 100, that
    document left out."""
    docs = table(spark, d, "documents")
    chunks = chunking.chunks(docs, "doc_id", "text").select(F.col("doc_id").alias("parent"), "chunk", "text")
    asked = shared_words(docs).select("query_id", F.explode(F.split("query", " ")).alias("word"))
    words = chunks.select("parent", "chunk", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    hits = words.join(asked, "word").where("parent <> query_id").select("query_id", "parent", "chunk").distinct()
    found = V.parent_windows(hits.select(F.struct("query_id", "chunk").alias("hit_id"), "parent", "chunk"), chunks, WINDOW)
    return found.select("hit_id.query_id", "parent", "hit_id.chunk", "first", "last", F.md5(F.col("passage").cast("binary")).alias("passage_md5"))


_ENDS = f"^{T.SPACE}+|{T.SPACE}+$"
PARENT_SQL = rf"""
WITH RECURSIVE {CHUNK_CTES},
k AS (SELECT doc_id AS parent, chunk, regexp_replace(substr(body, place + 1, stop - place), '{_ENDS}', '', 'g') AS text FROM e),
w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z]+'))) AS word FROM documents),
df AS (SELECT word, count(*) AS df FROM w GROUP BY word HAVING count(*) BETWEEN 2 AND {MOST_DOCUMENTS}),
q AS (SELECT doc_id AS query_id, word FROM w JOIN df USING (word) WHERE doc_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df DESC, word) <= 3),
h AS (SELECT DISTINCT query_id, parent, chunk FROM (SELECT parent, chunk, unnest(list_distinct(regexp_extract_all(lower(text), '[0-9a-z]+'))) AS word FROM k) JOIN q USING (word) WHERE parent <> query_id),
n AS (SELECT parent, count(*) AS n FROM k GROUP BY parent),
p AS (SELECT *, greatest(0, least(n, greatest(0, chunk - {WINDOW // 2}) + {WINDOW}) - {WINDOW}) AS low, least(n, greatest(0, chunk - {WINDOW // 2}) + {WINDOW}) AS high FROM h JOIN n USING (parent))
SELECT query_id, p.parent, p.chunk, min(k.chunk) AS first, max(k.chunk) AS last, md5(string_agg('[chunk ' || k.chunk || ']' || chr(10) || k.text, chr(10) || chr(10) ORDER BY k.chunk)) AS passage_md5
FROM p JOIN k ON k.parent = p.parent AND k.chunk >= low AND k.chunk < high GROUP BY ALL
"""

QUERIES = {"caption_chunks": (caption_chunks, None), "parent_context": (parent_context, PARENT_SQL)}
