"""Search queries, each with its SQL. Documents serve as passages, their sources as parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clamp, freshness, importance, jaccard, tokens
from ..operators import retrieval as R
from ..sources.shared import keeper
from ..sources.tables import table

def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Every document whose id is divisible by 100 asks for its three rarest words that another document has too."""
    keep = keeper(spark, "queries")
    return keep(R.rare_words(_docs(spark, d), "doc_id", "text", F.col("doc_id") % 100 == 0, keep=keep), "terms")


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(_docs(spark, d), "doc_id", "text", _queries(spark, d), keeper(spark, "bm25"))


def lexical_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = R.min_max(_bm25(spark, d), "query_id", "score", "normalised")
    return R.top(hits, ["query_id"], [F.desc("score"), "doc_id"], 20)


_WORDS = """
w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[0-9a-z]+') AS w FROM documents),
dw AS (SELECT doc_id, unnest(list_distinct(w)) AS word FROM w),
adf AS (SELECT word, count(*) AS df FROM dw GROUP BY word),
q AS (SELECT query_id, list_sort(list(word)) AS terms FROM (SELECT doc_id AS query_id, word FROM dw JOIN adf USING (word) WHERE doc_id % 100 = 0 AND df > 1
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df, word) <= 3) GROUP BY query_id),
qt AS (SELECT query_id, terms, len(terms) AS n_terms, unnest(terms) AS word FROM q),
tf AS (SELECT word, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS word FROM w) WHERE word IN (SELECT word FROM qt) GROUP BY ALL)"""
_BM25 = f"""{_WORDS},
st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM w),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
h AS (SELECT query_id, doc_id, n_terms, count(*) AS found, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM tf JOIN df USING (word) JOIN qt USING (word), st GROUP BY ALL HAVING count(*) = n_terms),
n AS (SELECT query_id, doc_id, score, round(CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE CAST(score > 0 AS INT) END, 6)::DOUBLE AS normalised FROM h WINDOW p AS (PARTITION BY query_id))
"""
BM25_SQL = f"WITH {_BM25} SELECT query_id, doc_id, score, normalised, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM n QUALIFY rank <= 20"


def linear_lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.top(R.linear(_docs(spark, d), "doc_id", "text", _queries(spark, d)), ["query_id"], [F.desc("score"), "doc_id"], 15)


LINEAR_SQL = f"""
WITH {_WORDS}, m AS (SELECT query_id, doc_id, terms, count(*) AS found, sum(tf) AS n, max(len) AS len FROM tf JOIN qt USING (word) GROUP BY ALL),
s AS (SELECT query_id, m.doc_id, round(greatest(0.05, 0.58 * found / len(terms) + 0.24 * coalesce(CAST(contains(lower(text), array_to_string(terms, ' ')) AS INT), 0) + 0.18 * least(1.0, 10 * n / len)), 6)::DOUBLE AS score FROM m JOIN w ON m.doc_id = w.doc_id)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 15
"""


def weighted_field_search(spark: SparkSession, d: str) -> DataFrame:
    score = sum((R.field_score(t, {"p_name": 6.0, "p_type": 3.0, "p_brand": 2.0}) for t in ("steel", "part", "brand", "1")), F.lit(0.0))
    hits = table(spark, d, "part").select("p_partkey", score.alias("score")).where("score > 0")
    return R.best(hits, [F.desc("score"), "p_partkey"], 50)


FIELD_SQL = f"""WITH s AS (SELECT p_partkey, {" + ".join(f"(CASE WHEN contains(lower({c}), '{t}') THEN {w} ELSE 0.0 END)" for t in ("steel", "part", "brand", "1") for c, w in (("p_name", 6.0), ("p_type", 3.0), ("p_brand", 2.0)))} AS score FROM part)
SELECT p_partkey, score::DOUBLE AS score, CAST(row_number() OVER (ORDER BY score DESC, p_partkey) AS INT) AS rank FROM s WHERE score > 0 QUALIFY rank <= 50"""


def vector_knn_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.knn(rows, "vec_id", "embedding", asked, 10).withColumn("score", clamp(F.col("similarity")))


_KNN = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.e, c.e), 6) AS similarity FROM v q JOIN v c ON q.vec_id <> c.vec_id {where})
"""
KNN_SQL = f"WITH {_KNN.format(where='WHERE q.vec_id % 100 = 0')} SELECT *, greatest(0.0, least(1.0, similarity)) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 10"


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Lexical hits of every document whose id is divisible by 100, fused with the neighbours of the vector of that id: the
    forty best of each kind take part."""
    lex = R.min_max(_bm25(spark, d), "query_id", "score", "lex")
    lex = R.top(lex, ["query_id"], [F.desc("score"), "doc_id"], 40, "lex_rank")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = rows.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    sem = R.knn(rows, "doc_id", "embedding", asked, 40).select("query_id", "doc_id", clamp(F.col("similarity")).alias("sem"))
    return R.top(R.fuse(lex, sem, "doc_id"), ["query_id"], [F.desc("score"), F.desc("lex"), "doc_id"], 20)


FUSION_SQL = f"""
WITH {_BM25}, l AS (SELECT query_id, doc_id, normalised AS lex, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS lex_rank FROM n QUALIFY lex_rank <= 40),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_cosine_similarity(q.e, c.e), 6) AS sem FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY sem DESC, c.vec_id) <= 40),
f AS (SELECT query_id, doc_id, coalesce(lex, 0.0) AS lex, greatest(0.0, least(1.0, coalesce(sem, 0.0))) AS sem, lex_rank FROM l FULL JOIN s USING (query_id, doc_id)),
g AS (SELECT query_id, doc_id, round(lex, 6) AS lex, round(sem, 6) AS sem, round(greatest(0.0, least(1.0, CASE WHEN sem = 0 AND lex > 0 THEN greatest(0.7 * sem + 0.3 * lex, 0.82 * lex, 0.84 - 0.04 * (lex_rank - 1)) ELSE 0.7 * sem + 0.3 * lex END)) + 1e-9, 6) AS score FROM f)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lex DESC, doc_id) AS INT) AS rank FROM g QUALIFY rank <= 20
"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """All hits of every query, with their sources; what is kept of them is decided by the queries below."""
    hits = R.min_max(_bm25(spark, d), "query_id", "score", "normalised")
    return hits.join(_docs(spark, d).select("doc_id", "source", "lang"), "doc_id")


_HITS = _BM25 + ", hits AS (SELECT query_id, n.doc_id, score, normalised, source, lang, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n.doc_id) AS rank FROM n JOIN documents USING (doc_id))"


def parent_diversify(spark: SparkSession, d: str) -> DataFrame:
    return R.round_robin(_hits(spark, d), "query_id", "source", "score", "doc_id").select("query_id", "doc_id", "source", "position")


DIVERSIFY_SQL = f"""
WITH {_HITS}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS depth, min(rank) OVER (PARTITION BY query_id, source) AS first FROM hits)
SELECT query_id, doc_id, source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY depth, first) AS INT) AS position FROM p
"""


def duplicate_parent_penalty(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicate_parent_penalty(_hits(spark, d), "query_id", "source", "normalised", "doc_id").select("query_id", "doc_id", "dup_rank", "penalised")


PENALTY_SQL = f"""
WITH {_HITS}, p AS (SELECT query_id, doc_id, normalised, row_number() OVER (PARTITION BY query_id, source ORDER BY normalised DESC, doc_id) - 1 AS r FROM hits)
SELECT query_id, doc_id, CAST(r AS INT) AS dup_rank, round(normalised - least(0.45, 0.32 * r), 6) AS penalised FROM p
"""


def source_budget_topk(spark: SparkSession, d: str) -> DataFrame:
    """At most two hits of a source, then the ten best."""
    hits = _bm25(spark, d).join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    within = R.top(hits, ["query_id", "source"], [F.desc("score"), "doc_id"], 2, "in_source")
    return R.top(within, ["query_id"], [F.desc("score"), "doc_id"], 10).select("query_id", "doc_id", "source", "rank")


BUDGET_SQL = f"""
WITH {_HITS}, b AS (SELECT query_id, doc_id, source, score FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) <= 2)
SELECT query_id, doc_id, source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM b QUALIFY rank <= 10
"""


def feature_boost_rank(spark: SparkSession, d: str) -> DataFrame:
    """Hits with boosts of importance, freshness, density and quality, less a toxicity penalty."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 60).alias("age"))
    support = docs.join(table(spark, d, "labels"), "doc_id", "left")
    density = clamp(F.col("n_chars") / 5000)
    trust = F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.3).otherwise(0.6)
    weight = importance(trust, F.col("doc_id") % 10, F.col("doc_id") % 15, density)
    flag = F.when(F.col("quality") == 1, 0.04).when(F.col("quality") == 0, -0.05).otherwise(0.0)
    boosts = support.select("doc_id", (0.15 * weight + 0.12 * freshness(F.col("age")) + 0.08 * density + flag - 0.15 * F.coalesce("toxic", F.lit(0))).alias("boost"))
    return _hits(spark, d).join(boosts, "doc_id").select("query_id", "doc_id", F.round(clamp(F.col("normalised") + F.col("boost")), 6).alias("boosted"))


BOOST_SQL = f"""
WITH {_HITS}, f AS (SELECT d.doc_id, least(1.0, n_chars / 5000) AS density, CASE quality WHEN 1 THEN 0.9 WHEN 0 THEN 0.3 ELSE 0.6 END AS trust, d.doc_id % 60 AS age, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
b AS (SELECT doc_id, 0.15 * least(1.0, 0.3 * trust + 0.25 * least(1.0, (doc_id % 10) / 8) + 0.25 * least(1.0, (doc_id % 15) / 12) + 0.2 * density) + 0.12 * least(1.0, 0.15 + 0.85 * exp(-age / 30)) + 0.08 * density
  + CASE quality WHEN 1 THEN 0.04 WHEN 0 THEN -0.05 ELSE 0 END - 0.15 * coalesce(toxic, 0) AS boost FROM f)
SELECT query_id, doc_id, round(greatest(0.0, least(1.0, normalised + boost)), 6)::DOUBLE AS boosted FROM hits JOIN b USING (doc_id)
"""


def related_parents(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of sources by the likeness of their 200 most frequent words of four letters and more; each keeps its three
    nearest."""
    words = table(spark, d, "documents").select("source", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w")).where(F.length("w") >= 4)
    common = R.top(words.groupBy("source", "w").agg(F.count("*").alias("n")), ["source"], [F.desc("n"), "w"], 200)
    sets = common.groupBy("source").agg(F.collect_set("w").alias("s"))
    pairs = sets.select(F.col("source").alias("a"), F.col("s").alias("sa")).join(sets.select(F.col("source").alias("b"), F.col("s").alias("sb")), F.col("a") != F.col("b"))
    return R.top(pairs.select("a", "b", F.round(jaccard(F.col("sa"), F.col("sb")), 6).alias("likeness")), ["a"], [F.desc("likeness"), "b"], 3)


RELATED_SQL = """
WITH w AS (SELECT source, unnest(list_distinct(regexp_extract_all(lower(text), '[0-9a-z]+'))) AS w FROM documents),
c AS (SELECT source, w FROM w WHERE length(w) >= 4 GROUP BY source, w QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, w) <= 200),
z AS (SELECT source, count(*) AS n FROM c GROUP BY source), i AS (SELECT x.source AS a, y.source AS b, count(*) AS shared FROM c x JOIN c y ON x.w = y.w AND x.source <> y.source GROUP BY ALL),
p AS (SELECT za.source AS a, zb.source AS b, round(coalesce(shared, 0) / (za.n + zb.n - coalesce(shared, 0)), 6) AS likeness FROM z za JOIN z zb ON za.source <> zb.source LEFT JOIN i ON i.a = za.source AND i.b = zb.source)
SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY likeness DESC, b) AS INT) AS rank FROM p QUALIFY rank <= 3
"""

QUERIES = {
    "lexical_bm25_topk": (lexical_bm25_topk, BM25_SQL),
    "linear_lexical_topk": (linear_lexical_topk, LINEAR_SQL),
    "weighted_field_search": (weighted_field_search, FIELD_SQL),
    "vector_knn_topk": (vector_knn_topk, KNN_SQL),
    "hybrid_fusion": (hybrid_fusion, FUSION_SQL),
    "parent_diversify": (parent_diversify, DIVERSIFY_SQL),
    "duplicate_parent_penalty": (duplicate_parent_penalty, PENALTY_SQL),
    "source_budget_topk": (source_budget_topk, BUDGET_SQL),
    "feature_boost_rank": (feature_boost_rank, BOOST_SQL),
    "related_parents": (related_parents, RELATED_SQL),
}
