"""Queries over texts and pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions import text as T
from ..sources.tables import table


def url_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


URL_SQL = rf"""
WITH b AS (SELECT page_id, regexp_replace(url, '^{T.SPACE}+|{T.SPACE}+$', '', 'g') AS stripped, regexp_replace(stripped, '#.*$', '') AS u FROM pages),
r AS (SELECT page_id, stripped, lower(coalesce(nullif(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), ''), 'https')) AS scheme,
  regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM b),
q AS (SELECT page_id, stripped, scheme, lower(regexp_extract(rest, '^([^/?]*)', 1)) AS host,
  coalesce(nullif(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', ''), ''), '/') AS path,
  list_sort(list_filter(list_transform(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.')),
    lambda p: {{'k': url_decode(replace(regexp_extract(p, '^([^=]*)=', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))}}),
    lambda p: NOT regexp_matches(lower(p.k), '^({"|".join(T.TRACKING)})'))) AS kept FROM r)
SELECT page_id, CASE WHEN stripped = '' THEN '' ELSE scheme || '://' || host || path || CASE WHEN len(kept) > 0
  THEN '?' || array_to_string(list_transform(kept, lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&') ELSE '' END END AS canonical FROM q
"""


def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of each page with their number of occurrences."""
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


LINKS_SQL = """SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL"""


def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Title and visible length of each page, scripts and tags taken out."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    body = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.md5(body.cast("binary")).alias("text_md5"), F.length(body).cast("long").alias("chars"))


HTML_SQL = r"""
WITH b AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ') AS body FROM pages)
SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, md5(body) AS text_md5, length(body) AS chars FROM b
"""


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    clean = T.clean_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(clean).cast("long").alias("chars"), F.md5(clean.cast("binary")).alias("clean_md5"))


def _clean(text: str) -> str:
    return rf"""array_to_string(list_filter(list_transform(regexp_split_to_array({text}, '\r?\n'), lambda x: trim(regexp_replace(x, '{T.SPACE}+', ' ', 'g'), ' ')),
  lambda x: length(x) > 2 AND NOT regexp_matches(x, '{T.BOILERPLATE_LINE}')), chr(10) || chr(10))"""


CLEAN_SQL = f"WITH c AS (SELECT doc_id, {_clean('text')} AS c FROM documents) SELECT doc_id, length(c) AS chars, md5(c) AS clean_md5 FROM c"


def assess_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))
    return T.with_quality(docs, "clean").select("doc_id", "n_tokens", "unique_ratio", "signal_hits", "noise_ratio", "score", "approved", "reasons")


_QUALITY = rf"""
t AS (SELECT doc_id, source, lower({_clean("text")}) AS low FROM documents),
p AS (SELECT doc_id, source, low, regexp_extract_all(low, '{T.QUALITY_TOKEN}') AS toks, len(toks) AS n,
  CASE WHEN n > 0 THEN len(list_distinct(toks)) / n ELSE 0.0 END AS uniq, {" + ".join(f"CAST(contains(low, '{t}') AS INT)" for t in T.SIGNAL_TERMS)} AS hits FROM t),
q AS (SELECT doc_id, source, CAST(n AS INTEGER) AS n_tokens, round(uniq, 4) AS unique_ratio, hits AS signal_hits, 0.0::DOUBLE AS noise_ratio, uniq,
  round(0.35 * least(1.0, n / 500) + 0.25 * greatest(0.0, least(1.0, (uniq - 0.2) / 0.5)) + 0.25 * least(1.0, hits / 6) + 0.15, 4)::DOUBLE AS score, n >= 40 AND score >= 0.5 AS approved FROM p)
"""
QUALITY_SQL = f"""WITH {_QUALITY}, r AS (SELECT *, concat_ws(',', CASE WHEN n_tokens < 40 THEN 'too_short' END, CASE WHEN signal_hits = 0 THEN 'no_ai_signal' END, CASE WHEN uniq < 0.28 THEN 'low_diversity' END) AS against FROM q)
SELECT doc_id, n_tokens, unique_ratio, signal_hits, noise_ratio, score, approved, CASE WHEN NOT approved AND against = '' THEN 'low_quality_score' ELSE against END AS reasons FROM r"""


def sample_gate(spark: SparkSession, d: str) -> DataFrame:
    """Of each source's 20 worst documents, the share that is approved; the gate asks for a half."""
    docs = table(spark, d, "documents").select("doc_id", "source", T.clean_text(F.col("text")).alias("clean"))
    scored = T.with_quality(docs, "clean").select("doc_id", "source", "score", "approved")
    worst = scored.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("score", "doc_id"))).where("r <= 20")
    rate = F.round(F.avg(F.col("approved").cast("int")), 6)
    return worst.groupBy("source").agg(F.count("*").alias("n"), rate.alias("pass_rate"), (rate >= 0.5).alias("passed"))


GATE_SQL = f"""WITH {_QUALITY}, w AS (SELECT *, CAST(approved AS INTEGER) AS ok FROM q QUALIFY row_number() OVER (PARTITION BY source ORDER BY score, doc_id) <= 20)
SELECT source, count(*) AS n, round(avg(ok), 6) AS pass_rate, round(avg(ok), 6) >= 0.5 AS passed FROM w GROUP BY source"""


def pii_classify(spark: SparkSession, d: str) -> DataFrame:
    """Sensitivity of every document and conversation turn, and the most sensitive level of each source."""
    docs = table(spark, d, "documents").select(F.col("source").alias("holder"), T.text_level(F.col("text")).alias("level"))
    turns = table(spark, d, "conversations").select(F.concat(F.lit("role:"), "role").alias("holder"), T.text_level(F.col("text")).alias("level"))
    return docs.unionByName(turns).groupBy("holder").agg(F.min("level").alias("most_sensitive"), *[F.sum((F.col("level") == k).cast("long")).alias(k.lower()) for k in ("P0", "P1", "P2", "P3")])


def _level(b: str) -> str:
    found = " OR ".join(f"regexp_matches({b}, '{p}')" for _, p in T.P0_PATTERNS)
    return f"CASE WHEN {found} THEN 'P0' WHEN {b} = '' OR regexp_matches({b}, '^https?://\\S+$') THEN 'P3' WHEN regexp_matches({b}, '^[\\[{{]') OR regexp_matches({b}, '\\|.*\\|') THEN 'P1' ELSE 'P2' END"


PII_SQL = f"""
WITH b AS (SELECT source AS holder, trim(coalesce(text, ''), ' ') AS b FROM documents UNION ALL SELECT 'role:' || role, trim(coalesce(text, ''), ' ') FROM conversations),
l AS (SELECT holder, {_level("b")} AS level FROM b)
SELECT holder, min(level) AS most_sensitive, CAST(count(*) FILTER (level = 'P0') AS BIGINT) AS p0, CAST(count(*) FILTER (level = 'P1') AS BIGINT) AS p1,
  CAST(count(*) FILTER (level = 'P2') AS BIGINT) AS p2, CAST(count(*) FILTER (level = 'P3') AS BIGINT) AS p3 FROM l GROUP BY holder
"""


def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(T.p0(F.col("text"))).select("doc_id", F.md5(T.redact(F.col("text")).cast("binary")).alias("redacted_md5"), F.regexp_count(T.redact(F.col("text")), F.lit(r"\[REDACTED\]")).cast("long").alias("n"))


def _redacted(text: str) -> str:
    for _, pattern in T.P0_PATTERNS:
        text = f"regexp_replace({text}, '{pattern}', '[REDACTED]', 'g')"
    return text


REDACT_SQL = f"""WITH r AS (SELECT doc_id, {_redacted("text")} AS r FROM documents WHERE {" OR ".join(f"regexp_matches(text, '{p}')" for _, p in T.P0_PATTERNS)})
SELECT doc_id, md5(r) AS redacted_md5, CAST(len(regexp_extract_all(r, '\\[REDACTED\\]')) AS BIGINT) AS n FROM r"""


def outbound_policy(spark: SparkSession, d: str) -> DataFrame:
    """Conversations whose text must not leave: any turn with personal data or secrets denies the whole."""
    turns = table(spark, d, "conversations").withColumn("bad", T.p0(F.col("text")).cast("int"))
    return turns.groupBy("conv_id").agg(F.count("*").alias("checked"), F.sum("bad").alias("blocked"), (F.max("bad") == 0).alias("allowed"), F.array_sort(F.collect_list(F.when(F.col("bad") == 1, F.col("turn")))).alias("blocked_turns"))


POLICY_SQL = f"""WITH t AS (SELECT conv_id, turn, CASE WHEN {" OR ".join(f"regexp_matches(text, '{p}')" for _, p in T.P0_PATTERNS)} THEN 1 ELSE 0 END AS bad FROM conversations)
SELECT conv_id, count(*) AS checked, CAST(sum(bad) AS BIGINT) AS blocked, max(bad) = 0 AS allowed, coalesce(list_sort(list(turn) FILTER (bad = 1)), []) AS blocked_turns FROM t GROUP BY conv_id"""


def keywords(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent longer words of each source and the share of its documents that have them."""
    words = table(spark, d, "documents").select("source", "doc_id", F.explode(T.tokens(F.col("text"))).alias("word")).where(F.length("word") >= 6)
    counts = words.groupBy("source", "word", "doc_id").agg(F.count("*").alias("c")).groupBy("source", "word").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))
    top = Window.partitionBy("source").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(top)).where("rank <= 5").select("source", "word", "n", "docs", "rank")


KEYWORDS_SQL = """
WITH w AS (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS word FROM documents),
c AS (SELECT source, word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w WHERE length(word) >= 6 GROUP BY ALL)
SELECT source, word, CAST(n AS BIGINT) AS n, docs, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS INTEGER) AS rank FROM c QUALIFY rank <= 5
"""


def unit_types(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of paragraphs in each language, with the direction their wording takes."""
    units = table(spark, d, "documents").select("lang", F.explode(F.split("text", "\n\n")).alias("u"))
    return units.groupBy("lang", T.unit_type(F.col("u")).alias("unit_type"), T.direction(F.col("u")).alias("direction")).agg(F.count("*").alias("n"))


UNITS_SQL = rf"""
WITH u AS (SELECT lang, unnest(string_split(text, chr(10) || chr(10))) AS u FROM documents),
f AS (SELECT lang, u, lower(u) AS l, regexp_replace(regexp_replace(u, '{T.SPACE}+', ' ', 'g'), '^ +| +$', '', 'g') AS flat FROM u),
h AS (SELECT lang, u, l, lower(CASE WHEN length(flat) <= 180 THEN flat ELSE substr(flat, 1, 177) END) AS h FROM f)
SELECT lang, CASE {" ".join(f"WHEN regexp_matches(h, '{w}') THEN '{n}'" for n, w in T.UNIT_WORDS)}
  WHEN regexp_matches(u, '(?m)^\s*[-*]\s+') THEN 'list_block' WHEN contains(u, '|') AND contains(u, chr(10)) THEN 'table_block' ELSE 'section' END AS unit_type,
  CASE WHEN regexp_matches(l, 'improv|outperform|better|higher') THEN 'better' WHEN regexp_matches(l, 'degrad|worse|lower|underperform') THEN 'worse'
  WHEN regexp_matches(l, 'same|no difference|comparable') THEN 'neutral' ELSE 'unknown' END AS direction, count(*) AS n FROM h GROUP BY ALL
"""


def metadata_quality(spark: SparkSession, d: str) -> DataFrame:
    """Completeness of each document's metadata: present fields by weight."""
    docs = table(spark, d, "documents")
    weights = {"text": 1.0, "lang": 0.5, "source": 1.0, "n_chars": 0.5}
    have = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    digest = F.sha2(F.concat_ws("\n", *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("lang", "source", "n_chars")]), 256)
    return docs.select("doc_id", F.round(have / sum(weights.values()), 6).alias("completeness"), digest.alias("source_hash"))


METADATA_SQL = """SELECT doc_id, round(((CASE WHEN coalesce(text, '') <> '' THEN 1.0 ELSE 0 END) + (CASE WHEN coalesce(lang, '') <> '' THEN 0.5 ELSE 0 END) + (CASE WHEN coalesce(source, '') <> '' THEN 1.0 ELSE 0 END)
  + (CASE WHEN n_chars IS NOT NULL THEN 0.5 ELSE 0 END)) / 3.0, 6)::DOUBLE AS completeness, sha256(concat_ws(chr(10), nullif(trim(lang), ''), nullif(trim(source), ''), CAST(n_chars AS VARCHAR))) AS source_hash FROM documents"""


def numbers(spark: SparkSession, d: str) -> DataFrame:
    """First number of each document and how many numbers it has."""
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", r"(\d+(?:\.\d+)?)", 1).alias("first_number"), F.regexp_count("text", F.lit(r"\d+(?:\.\d+)?")).cast("long").alias("n"))


NUMBERS_SQL = r"""SELECT doc_id, regexp_extract(text, '(\d+(?:\.\d+)?)', 1) AS first_number, CAST(len(regexp_extract_all(text, '\d+(?:\.\d+)?')) AS BIGINT) AS n FROM documents"""


def chunk_offsets(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk", "start", "stop", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_BEHIND = "CASE WHEN strpos(reverse(p), reverse({d})) BETWEEN 1 AND len(p) - len({d}) THEN len(p) - strpos(reverse(p), reverse({d})) + 1 END"
_ENDS = ", ".join(_BEHIND.format(d=d) for d in ("chr(10) || chr(10)", "chr(10)", "'. '", "'? '", "'! '"))
_END = f"place + coalesce(list_max(list_filter([{_ENDS}], lambda x: x > 600)), 1200)"
CHUNK_CTES = rf"""b AS (SELECT doc_id, regexp_replace(text, '^{T.SPACE}+|{T.SPACE}+$', '', 'g') AS body FROM documents),
c AS (SELECT doc_id, body, 0 AS chunk, CAST(0 AS BIGINT) AS place FROM b WHERE body <> ''
  UNION ALL SELECT doc_id, body, chunk + 1, stop - 200 FROM (SELECT *, {_END} AS stop FROM (SELECT *, substr(body, place + 1, 1200) AS p FROM c)) WHERE place + 1200 < len(body)),
e AS (SELECT *, CASE WHEN place + 1200 < len(body) THEN {_END} ELSE len(body) END AS stop FROM (SELECT *, substr(body, place + 1, 1200) AS p FROM c))"""
CHUNKS_SQL = rf"""
WITH RECURSIVE {CHUNK_CTES}
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(place AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, md5(regexp_replace(substr(body, place + 1, stop - place), '^{T.SPACE}+|{T.SPACE}+$', '', 'g')) AS text_md5 FROM e
"""


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as one episode: opening and closing words and its size."""
    turns = table(spark, d, "conversations")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t")))), lambda x: x["t"]), "\n")
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.substring(said, 1, 480).alias("summary"), F.sum((F.col("role") == "assistant").cast("long")).alias("answers"))


EPISODES_SQL = """SELECT conv_id, count(*) AS turns, substr(string_agg(role || ': ' || text, chr(10) ORDER BY turn), 1, 480) AS summary, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS answers FROM conversations GROUP BY conv_id"""


MOST_SENT = 2_000_000  # hashes that may be sent to every task


def benchmark_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share eight-word passages with benchmark items: shared passages and the share of the item's.

    Passages of documents are hashed where they are, and only those whose hash an item has are spelled out and
    shuffled. The items' hashes go to every task if they are few, which is counted first; else the join shuffles."""
    words = lambda name, key: table(spark, d, name).select(key, T.tokens(F.col("text")).alias("t")).where(F.size("t") >= 8)
    places = F.sequence(F.lit(1), F.size("t") - 7)
    spelled = lambda df, key: df.select(key, F.array_join(F.slice("t", F.col("at"), 8), " ").alias("g")).distinct()
    items = words("benchmark", "item_id").select("item_id", "t", F.explode(places).alias("at"))
    hashes = items.select(F.xxhash64(F.slice("t", F.col("at"), 8)).alias("h")).distinct()
    hashes = F.broadcast(hashes) if hashes.limit(MOST_SENT + 1).count() <= MOST_SENT else hashes
    docs = words("documents", "doc_id")
    near = docs.select("doc_id", F.posexplode(F.transform(places, lambda i: F.xxhash64(F.slice("t", i, 8)))).alias("at", "h")).join(hashes, "h", "left_semi")
    found = spelled(near.select("doc_id", (F.col("at") + 1).alias("at")).join(docs, "doc_id"), "doc_id")
    grams = spelled(items, "item_id")
    size = grams.groupBy("item_id").agg(F.count("*").alias("size"))
    shared = found.join(grams, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    return shared.join(size, "item_id").select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("size"), 6).alias("containment"))


OVERLAP_SQL = """
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z]+') AS t FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z]+') AS t FROM documents),
bg AS (SELECT DISTINCT item_id, array_to_string(t[i:i+7], ' ') AS g FROM b, range(1, len(t) - 6) AS r(i)), dg AS (SELECT DISTINCT doc_id, array_to_string(t[i:i+7], ' ') AS g FROM d, range(1, len(t) - 6) AS r(i)),
s AS (SELECT item_id, count(*) AS size FROM bg GROUP BY 1), h AS (SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (g) GROUP BY ALL)
SELECT doc_id, item_id, shared, round(shared / size, 6) AS containment FROM h JOIN s USING (item_id)
"""

QUERIES = {
    "url_canonicalize": (url_canonicalize, URL_SQL),
    "html_links": (html_links, LINKS_SQL),
    "html_text_extract": (html_text, HTML_SQL),
    "clean_text": (clean_text, CLEAN_SQL),
    "assess_quality": (assess_quality, QUALITY_SQL),
    "sample_gate": (sample_gate, GATE_SQL),
    "pii_classify": (pii_classify, PII_SQL),
    "pii_redact": (pii_redact, REDACT_SQL),
    "outbound_policy": (outbound_policy, POLICY_SQL),
    "keywords_topk": (keywords, KEYWORDS_SQL),
    "unit_types": (unit_types, UNITS_SQL),
    "metadata_quality": (metadata_quality, METADATA_SQL),
    "numeric_values": (numbers, NUMBERS_SQL),
    "chunk_offsets": (chunk_offsets, CHUNKS_SQL),
    "episode_build": (episodes, EPISODES_SQL),
    "benchmark_overlap": (benchmark_overlap, OVERLAP_SQL),
}
