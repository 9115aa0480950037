"""Graph queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.retrieval import knn, top
from ..sources.shared import keeper
from ..sources.tables import table

NEAR, LEAST = 4, 0.3


def _edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    near = knn(rows, "vec_id", "embedding", rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), NEAR, LEAST)
    return G.mutual(near.select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), F.col("similarity").alias("weight")), "a", "b", "weight")


_EDGES = f"""
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.e, y.e), 6) AS w FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE w >= {LEAST} QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) <= {NEAR}),
e AS (SELECT s.a, s.b, greatest(s.w, t.w) AS weight FROM s JOIN s t ON s.a = t.b AND s.b = t.a WHERE s.a < s.b)
"""


def mutual_knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def knn_components(spark: SparkSession, d: str) -> DataFrame:
    keep = keeper(spark, "components")
    nodes = table(spark, d, "embeddings").select("vec_id")
    found = G.components(nodes, keep(_edges(spark, d), -1), "vec_id", "a", "b", keep)
    size = F.count("*").over(Window.partitionBy("component"))
    return found.select("vec_id", "component", F.when(size > 1, "cluster").otherwise("singleton").alias("kind"))


COMPONENTS_SQL = f"""
WITH RECURSIVE {_EDGES}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT vec_id, vec_id AS to_ FROM embeddings UNION SELECT r.vec_id, u.b FROM r JOIN u ON r.to_ = u.a),
c AS (SELECT vec_id, min(to_) AS component FROM r GROUP BY vec_id)
SELECT vec_id, component, CASE WHEN count(*) OVER (PARTITION BY component) > 1 THEN 'cluster' ELSE 'singleton' END AS kind FROM c
"""


def bridge_scores(spark: SparkSession, d: str) -> DataFrame:
    return G.bridge_scores(_edges(spark, d), table(spark, d, "embeddings"), "vec_id", "label", "a", "b", "weight")


BRIDGE_SQL = f"""
WITH {_EDGES}, u AS (SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e),
x AS (SELECT u.a, weight, p.label <> q.label AS out, q.label AS g FROM u JOIN v p ON p.vec_id = u.a JOIN v q ON q.vec_id = u.b)
SELECT a AS vec_id, round(least(1.0, sum(CASE WHEN out THEN weight ELSE 0 END) / sum(weight) + 0.12 * greatest(0, count(DISTINCT CASE WHEN out THEN g END) - 1)), 6)::DOUBLE AS bridge, count(DISTINCT CASE WHEN out THEN g END) AS groups FROM x GROUP BY a
"""


def node_importance(spark: SparkSession, d: str) -> DataFrame:
    """Weighted degree, and rank within the label."""
    weight = G.undirected(_edges(spark, d), "a", "b").groupBy(F.col("a").alias("vec_id")).agg(F.round(F.sum("weight"), 5).alias("importance"))
    return top(weight.join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id"), ["label"], [F.desc("importance"), "vec_id"], 5)


IMPORTANCE_SQL = f"""
WITH {_EDGES}, i AS (SELECT a AS vec_id, round(sum(weight), 5) AS importance FROM (SELECT a, weight FROM e UNION ALL SELECT b, weight FROM e) GROUP BY 1)
SELECT vec_id, importance, label, CAST(row_number() OVER (PARTITION BY label ORDER BY importance DESC, vec_id) AS INT) AS rank FROM i JOIN v USING (vec_id) QUALIFY rank <= 5
"""


def centroid_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the unit vectors of each label, by component."""
    rows = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("label", norm.alias("n"), F.posexplode("e").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg(F.col("x") / F.col("n")), 6).alias("mean"))


CENTROID_SQL = """WITH v AS (SELECT label, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim, sqrt(list_dot_product(e, e)) AS n FROM v)
SELECT label, CAST(dim AS INT) AS dim, round(avg(x / n), 6) AS mean FROM x GROUP BY ALL"""


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Edges region -> nation -> supplier as text names."""
    region, nation, supplier = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("R:"), "r_name").alias("a"), F.concat(F.lit("N:"), "n_name").alias("b"))
    down = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("N:"), "n_name").alias("a"), F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("b"))
    return up.unionByName(down)


_PLACES = """g AS (SELECT 'R:' || r_name AS a, 'N:' || n_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'N:' || n_name, 'S:' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def undirected_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return G.undirected(_places(spark, d), "a", "b").groupBy("a").agg(F.countDistinct("b").alias("neighbours"), F.min("b").alias("first"))


NEIGHBOURS_SQL = f"WITH {_PLACES} SELECT a, count(DISTINCT b) AS neighbours, min(b) AS first FROM (SELECT a, b FROM g UNION ALL SELECT b, a FROM g) GROUP BY a"


def prereq_closure(spark: SparkSession, d: str) -> DataFrame:
    return G.closure(_places(spark, d), "a", "b", keeper(spark, "closure"))


CLOSURE_SQL = f"WITH RECURSIVE {_PLACES}, r AS (SELECT a, b, 1 AS depth FROM g UNION SELECT r.a, g.b, depth + 1 FROM r JOIN g ON r.b = g.a) SELECT a, b, CAST(min(depth) AS INT) AS depth FROM r GROUP BY a, b"


def topo_levels(spark: SparkSession, d: str) -> DataFrame:
    edges = _places(spark, d)
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    return G.levels(G.closure(edges, "a", "b", keeper(spark, "levels")), nodes, "a", "b", "node")


LEVELS_SQL = f"""WITH RECURSIVE {_PLACES}, r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a), n AS (SELECT a AS node FROM g UNION SELECT b FROM g)
SELECT node, count(DISTINCT a) AS level FROM n LEFT JOIN r ON r.b = node GROUP BY node"""


def isolated_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers without any urgent order."""
    edges = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("a"), F.col("o_custkey").alias("b"))
    return G.isolated(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), edges, "c_custkey", "a", "b")


ISOLATED_SQL = "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"

QUERIES = {
    "mutual_knn_edges": (mutual_knn_edges, f"WITH {_EDGES} SELECT a, b, weight FROM e"),
    "knn_components": (knn_components, COMPONENTS_SQL),
    "bridge_scores": (bridge_scores, BRIDGE_SQL),
    "node_importance": (node_importance, IMPORTANCE_SQL),
    "centroid_vectors": (centroid_vectors, CENTROID_SQL),
    "undirected_neighbors": (undirected_neighbors, NEIGHBOURS_SQL),
    "prereq_closure": (prereq_closure, CLOSURE_SQL),
    "topo_levels": (topo_levels, LEVELS_SQL),
    "isolated_nodes": (isolated_customers, ISOLATED_SQL),
}
