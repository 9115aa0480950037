"""Queries over questions, evidence, learning graphs and links, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import queries as Q
from ..operators import evaluation as V
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import learning as L
from ..operators.retrieval import top
from ..sources.shared import keeper
from ..sources.tables import table


def query_intent(spark: SparkSession, d: str) -> DataFrame:
    """What each question of a conversation asks for, and for what time."""
    mode, year = Q.temporal(F.col("text"))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", Q.intent(F.col("text")).alias("intent"), mode.alias("temporal"), year.alias("target_year"))


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


INTENT_SQL = rf"""
WITH q AS (SELECT conv_id, turn, coalesce(text, '') AS x, lower(trim(coalesce(text, ''), ' ')) AS t FROM conversations WHERE role = 'user'),
m AS (SELECT *, CASE WHEN regexp_matches(x, '{Q.BEFORE}') THEN 'before' WHEN regexp_matches(x, '{Q.AFTER}') THEN 'after' WHEN regexp_matches(x, '{Q.LATEST}') THEN 'latest' ELSE 'none' END AS temporal,
  len(list_distinct(list_filter(regexp_extract_all(t, '[a-zA-Z][a-zA-Z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({list(Q.STOP)}, w)) || list_filter(regexp_extract_all(t, '[가-힣]{{2,}}'), lambda w: NOT list_contains({list(Q.STOP_KOREAN)}, w)))) AS n FROM q)
SELECT conv_id, turn, CASE WHEN t = '' THEN 'definition' WHEN {_any(Q.COMPARISON)} THEN 'comparison' WHEN regexp_matches(t, '{Q.PAPER_ID}') THEN 'paper_lookup'
  WHEN {_any(Q.PAPER)} AND {_any(Q.PAPER_TOPIC)} THEN 'paper_topic' WHEN {_any(Q.PAPER + Q.CITATION)} THEN 'paper_lookup' WHEN {_any(Q.IMPLEMENTATION)} THEN 'implementation'
  WHEN {_any(Q.EVALUATION)} THEN 'evaluation' WHEN {_any(Q.HOWTO)} THEN 'howto' WHEN {_any(Q.DEFINITION)} THEN 'definition' WHEN n <= 4 THEN 'topic_lookup' ELSE 'definition' END AS intent, temporal,
  CASE temporal WHEN 'before' THEN coalesce(nullif(regexp_extract(x, '{Q.BEFORE}', 2), ''), nullif(regexp_extract(x, '{Q.BEFORE}', 3), ''), nullif(regexp_extract(x, '{Q.BEFORE}', 4), ''), '')
  WHEN 'after' THEN coalesce(nullif(regexp_extract(x, '{Q.AFTER}', 2), ''), nullif(regexp_extract(x, '{Q.AFTER}', 3), ''), '') ELSE '' END AS target_year FROM m
"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Each source's 40 longest documents as evidence, by text and by kind."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars", F.md5("text").alias("citation"), F.concat_ws("::", "lang", F.floor(F.col("n_chars") / 10).cast("string")).alias("family"))
    return top(docs, ["source"], [F.desc("n_chars"), "doc_id"], 40)


_EVIDENCE = """
o AS (SELECT source, doc_id, md5(text) AS citation, lang || '::' || CAST(floor(n_chars / 10) AS BIGINT) AS family, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM documents QUALIFY rank <= 40),
w AS (SELECT source, 0 AS rank, [''] AS citations, [''] AS families, '' AS citation, '' AS family, false AS stays FROM o GROUP BY source
  UNION ALL SELECT source, rank, CASE WHEN stays THEN list_append(citations, citation) ELSE citations END, CASE WHEN stays THEN list_append(families, family) ELSE families END, citation, family, stays
  FROM (SELECT o.*, citations, families, NOT list_contains(citations, o.citation) AND NOT list_contains(families, o.family) AS stays FROM w JOIN o ON o.source = w.source AND o.rank = w.rank + 1))
"""


def evidence_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return E.dedupe(_evidence(spark, d), "source", "rank", "citation", "family")


DEDUPE_SQL = f"WITH RECURSIVE {_EVIDENCE} SELECT source, rank, citation, family FROM w WHERE stays"


def evidence_budget(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each source's evidence after its budget. The source's number stands for its type and the intent."""
    left = top(evidence_dedupe(spark, d), ["source"], ["rank"], 6, "place")
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    kind, intent = F.when(n % 3 == 0, "paper").otherwise("web"), F.when(n % 4 == 0, "definition").when(n % 4 == 1, "comparison").otherwise("evaluation")
    return left.withColumn("most", E.most_sources(kind, intent)).where("place <= most").select("source", "rank", "place", "most")


BUDGET_SQL = rf"""
WITH RECURSIVE {_EVIDENCE}, p AS (SELECT source, rank, CAST(row_number() OVER (PARTITION BY source ORDER BY rank) AS INT) AS place, CAST(regexp_extract(source, '(\d+)$', 1) AS INT) AS n FROM w WHERE stays),
b AS (SELECT source, rank, place, CASE WHEN n % 3 = 0 AND n % 4 = 0 THEN 2 WHEN n % 3 = 0 THEN 4 WHEN n % 4 = 1 THEN 5 ELSE 6 END AS most FROM p)
SELECT * FROM b WHERE place <= most
"""


def learning_edges(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers as nodes of a learning graph; the line number stands for the predicate."""
    names = F.array(*map(F.lit, ("requires", "part_of", "enables", "improves", "example_of", "related_to", "other")))
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("P"), "l_partkey").alias("source"), F.concat(F.lit("S"), "l_suppkey").alias("target"), F.element_at(names, F.col("l_linenumber") % 7 + 1).alias("predicate"), (F.col("l_discount") * 10).alias("confidence")
    )
    return L.relation_edges(rows).groupBy("source", "target", "edge_type").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 6).alias("confidence"))


_RULES = " ".join(f"WHEN '{p}' THEN {{'kind': '{k}', 'turned': {str(t).lower()}, 'least': {m}}}" for p, k, t, m in L.RELATION_RULES)
LEARNING_SQL = f"""
WITH l AS (SELECT 'P' || l_partkey AS p, 'S' || l_suppkey AS s, l_discount * 10 AS c, CASE ['requires', 'part_of', 'enables', 'improves', 'example_of', 'related_to', 'other'][l_linenumber % 7 + 1] {_RULES} END AS r FROM lineitem)
SELECT CASE WHEN r.turned THEN s ELSE p END AS source, CASE WHEN r.turned THEN p ELSE s END AS target, r.kind AS edge_type, count(*) AS n, round(max(least(1.0, greatest(c, r.least))), 6)::DOUBLE AS confidence FROM l WHERE r IS NOT NULL GROUP BY 1, 2, 3
"""


def _cycles(spark: SparkSession, d: str) -> DataFrame:
    """Nations that lead to the nation of twice their number, and to that of their region's."""
    nation = table(spark, d, "nation")
    return nation.select(F.col("n_nationkey").alias("a"), F.explode(F.array(F.col("n_nationkey") * 2 % 10, F.col("n_regionkey"))).alias("b")).where("a <> b")


def strong_components(spark: SparkSession, d: str) -> DataFrame:
    closed = G.closure(_cycles(spark, d), "a", "b", keeper(spark, "strong"))
    return L.strong_components(closed, table(spark, d, "nation").select("n_nationkey"), "a", "b", "n_nationkey")


STRONG_SQL = """
WITH RECURSIVE g AS (SELECT n_nationkey AS a, unnest([n_nationkey * 2 % 10, n_regionkey]) AS b FROM nation), r AS (SELECT a, b FROM g WHERE a <> b UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a WHERE g.a <> g.b),
m AS (SELECT x.a, min(x.b) AS m FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT n_nationkey, CAST(least(n_nationkey, coalesce(m, n_nationkey)) AS INT) AS component FROM nation LEFT JOIN m ON a = n_nationkey
"""


def link_graph(spark: SparkSession, d: str) -> DataFrame:
    """Pages as notes: their links resolved by path, by a stem or by a title's first word that only one page has, and
    how many lead out of and into each; orphans have none."""
    pages = table(spark, d, "pages")
    path = F.lower(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1))
    notes = pages.select(F.col("page_id").alias("id"), path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("stem"), F.lower(F.regexp_extract("html", r"<title>(\S+)", 1)).alias("alias"))
    links = pages.select(F.col("page_id").alias("id"), F.explode(F.regexp_extract_all("html", F.lit(r'href="/([^"#^]*)'), 1)).alias("key")).withColumn("key", F.lower(F.trim("key")))
    found = L.resolve_links(notes, links)
    out, into = found.groupBy("id").agg(F.count("*").alias("leads")), found.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("led"))
    both = notes.select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0, ["leads", "led"])
    return both.select(F.col("id").alias("page_id"), F.col("leads").alias("outbound"), F.col("led").alias("inbound"), ((F.col("leads") == 0) & (F.col("led") == 0)).alias("orphan"))


LINK_SQL = r"""
WITH n AS (SELECT page_id AS id, lower(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)) AS path, string_split(path, '/')[-1] AS stem, lower(regexp_extract(html, '<title>(\S+)', 1)) AS alias FROM pages),
l AS (SELECT page_id AS id, lower(trim(unnest(regexp_extract_all(html, 'href="/([^"#^]*)', 1)), ' ')) AS key FROM pages),
p AS (SELECT path AS k, min(id) AS t FROM n GROUP BY 1), s AS (SELECT stem AS k, min(id) AS t FROM n WHERE stem <> '' GROUP BY 1 HAVING count(DISTINCT id) = 1),
a AS (SELECT alias AS k, min(id) AS t FROM n WHERE alias <> '' GROUP BY 1 HAVING count(DISTINCT id) = 1),
f AS (SELECT DISTINCT l.id, coalesce(p.t, s.t, a.t) AS target FROM l LEFT JOIN p ON p.k = l.key LEFT JOIN s ON s.k = string_split(l.key, '/')[-1] LEFT JOIN a ON a.k = l.key WHERE coalesce(p.t, s.t, a.t) IS NOT NULL),
o AS (SELECT id, count(*) AS n FROM f GROUP BY id), i AS (SELECT target, count(*) AS n FROM f GROUP BY target)
SELECT n.id AS page_id, coalesce(o.n, 0) AS outbound, coalesce(i.n, 0) AS inbound, o.n IS NULL AND i.n IS NULL AS orphan FROM n LEFT JOIN o ON o.id = n.id LEFT JOIN i ON i.target = n.id
"""


def stage_b_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answers, judged by their labels, by source. Their numbers stand for the kind of question."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rows = docs.select(
        "source", (F.col("n_chars") > 0).alias("top1"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("answerable"), (F.col("n_chars") >= 200).alias("substantive"),
        (F.col("doc_id") % 4 == 0).alias("temporal"), F.regexp_count("text", F.lit(r"\b(19|20)\d{2}\b")).cast("long").alias("grounded"),
        F.when(F.col("quality") == 1, "good").when(F.col("toxic") == 0, "partial").when(F.col("quality") == 0, "bad").alias("label"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("abstains"), (F.col("doc_id") % 20 == 0).alias("wrong_era"), (F.col("doc_id") % 10 == 0).alias("must_abstain"),
    )
    return V.answer_stage(rows, "source")


_B = V.STAGE_B_LIMITS
STAGE_B_SQL = rf"""
WITH r AS (SELECT source, n_chars > 0 AS top1, coalesce(quality = 1, false) AS answerable, n_chars >= 200 AS substantive, d.doc_id % 4 = 0 AS temporal, len(regexp_extract_all(text, '\b(19|20)\d{{2}}\b')) AS grounded,
  CASE WHEN quality = 1 THEN 'good' WHEN toxic = 0 THEN 'partial' WHEN quality = 0 THEN 'bad' END AS label, coalesce(toxic = 1, false) AS abstains, d.doc_id % 20 = 0 AS wrong_era, d.doc_id % 10 = 0 AS must_abstain
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT source, count(*) FILTER (top1) AS results, count(*) FILTER (top1 AND label IS NOT NULL) AS judged, count(*) FILTER (top1 AND temporal) AS t, count(*) FILTER (top1 AND label IS NOT NULL AND temporal) AS jt,
  count(*) FILTER (top1 AND label IS NOT NULL AND must_abstain) AS ja, coalesce(round(avg(CAST(answerable AS INT)) FILTER (top1), 6), 0.0) AS answerable, coalesce(round(avg(CAST(NOT substantive AS INT)) FILTER (top1), 6), 0.0) AS non_substantive,
  coalesce(round(avg(CAST(grounded > 0 AS INT)) FILTER (top1 AND temporal), 6), 0.0) AS grounded, coalesce(round(avg(CAST(label IN ('good', 'partial') AS INT)) FILTER (top1 AND label IS NOT NULL), 6), 0.0) AS good_or_partial,
  coalesce(round(avg(CAST(wrong_era AS INT)) FILTER (top1 AND label IS NOT NULL AND temporal), 6), 0.0) AS wrong_era, coalesce(round(avg(CAST(abstains AS INT)) FILTER (top1 AND label IS NOT NULL AND must_abstain), 6), 0.0) AS abstention FROM r GROUP BY source)
SELECT source, results, judged, answerable, non_substantive, grounded, good_or_partial, wrong_era, abstention, results > 0 AND answerable >= {_B["answerable"]} AND non_substantive <= {_B["non_substantive"]} AND t > 0 AND grounded >= {_B["grounded"]}
  AND judged > 0 AND good_or_partial >= {_B["good_or_partial"]} AND jt > 0 AND wrong_era <= {_B["wrong_era"]} AND ja > 0 AND abstention >= {_B["abstention"]} AS passed FROM s
"""

QUERIES = {
    "query_intent": (query_intent, INTENT_SQL),
    "evidence_dedupe": (evidence_dedupe, DEDUPE_SQL),
    "evidence_budget": (evidence_budget, BUDGET_SQL),
    "learning_edges": (learning_edges, LEARNING_SQL),
    "strong_components": (strong_components, STRONG_SQL),
    "link_graph": (link_graph, LINK_SQL),
    "stage_b_metrics": (stage_b_metrics, STAGE_B_SQL),
}
