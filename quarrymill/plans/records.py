"""Queries over stored records: evaluation, comparison, deduplication, upkeep. Each with its SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as V
from ..operators.jaccard import verified
from ..operators.retrieval import best, top
from ..sources import tables as S
from ..sources.shared import keeper
from ..sources.tables import table
from .text import URL_SQL

#: Words whose frequency orders a document's words; all others are ordered by a hash.
MOST_COUNTED = 500_000


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its labels, if any."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Each source's documents as results of one query per language, longest first, judged by their quality label."""
    docs = table(spark, d, "documents").withColumn("query", F.concat_ws(":", "source", "lang"))
    return top(docs, ["query"], [F.desc("n_chars"), "doc_id"], 10).join(table(spark, d, "labels"), "doc_id", "left")


_JUDGED = """j AS (SELECT d.*, source || ':' || lang AS query, quality, toxic, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, d.doc_id) AS rank FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id QUALIFY rank <= 10)"""


def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return V.precision_at_k(_judged(spark, d), "query", "rank", "quality", 5, ["source"])


PRECISION_SQL = f"""
WITH {_JUDGED}, e AS (SELECT source, query, coalesce(avg(quality) FILTER (rank <= 5), 0.0) AS p, coalesce(max(quality) FILTER (rank <= 3), 0) AS h FROM j GROUP BY ALL)
SELECT source, count(*) AS queries, round(avg(p), 6) AS precision_at_k, round(avg(h), 6) AS hit_at_3 FROM e GROUP BY source
"""


def stage_a_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Hit, no-result and route rates of all documents, overall and by source, and the gate over them."""
    found = V.rates(_labelled(spark, d), "source", {"hit": F.col("quality") == 1, "no_result": F.col("quality").isNull(), "route": F.col("lang") == "en"})
    return V.gate(found, {"hit": F.col("hit") >= 0.6, "no_result": F.col("no_result") <= 0.4, "route": F.col("route") >= 0.6})


STAGE_SQL = f"""
WITH f AS (SELECT d.*, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) AS n, round(avg(CAST(quality = 1 AS INT)), 6) AS hit, round(avg(CAST(quality IS NULL AS INT)), 6) AS no_result, round(avg(CAST(lang = 'en' AS INT)), 6) AS route FROM f GROUP BY ROLLUP (source)),
c AS (SELECT *, concat_ws(',', CASE WHEN coalesce(hit >= 0.6, false) THEN NULL ELSE 'hit' END, CASE WHEN no_result <= 0.4 THEN NULL ELSE 'no_result' END, CASE WHEN route >= 0.6 THEN NULL ELSE 'route' END) AS failed FROM r)
SELECT *, failed = '' AS passed FROM c
"""


def delta_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    """English against German documents as candidate and baseline, by source."""
    judged = _labelled(spark, d)
    flags = {"good": F.col("quality") == 1, "toxic_rate": F.col("toxic") == 1}
    return V.delta(V.rates(judged.where("lang = 'en'"), "source", flags), V.rates(judged.where("lang = 'de'"), "source", flags), "source", ["good", "toxic_rate"])


_RATE = "SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, round(avg(CAST(quality = 1 AS INT)), 6) AS g, round(avg(CAST(toxic = 1 AS INT)), 6) AS t FROM j WHERE lang = '{}' GROUP BY ROLLUP (source)"
DELTA_SQL = f"WITH j AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), a AS ({_RATE.format('en')}), b AS ({_RATE.format('de')}) SELECT source, round((a.g - b.g) * 100, 3) AS good_delta, round((a.t - b.t) * 100, 3) AS toxic_rate_delta FROM a FULL JOIN b USING (source)"


def upper_median_age(spark: SparkSession, d: str) -> DataFrame:
    """Upper median of order ages by priority, in days before 1999."""
    age = F.datediff(F.lit("1999-01-01"), F.col("o_orderdate"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY datediff('1999-01-01', o_orderdate) DESC)").cast("long").alias("median_age"), F.max(age).cast("long").alias("oldest"))


MEDIAN_SQL = """SELECT o_orderpriority, count(*) AS n, CAST(list_sort(list(a), 'DESC')[CAST(ceil(count(*) * 0.5) AS INT)] AS BIGINT) AS median_age, max(a) AS oldest FROM (SELECT o_orderpriority, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS a FROM orders) GROUP BY 1"""


def dedupe_two_pass(spark: SparkSession, d: str) -> DataFrame:
    """Pages that survive first-wins by canonical URL, then, of these, by content."""
    pages = table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("u"), F.md5(F.col("html").cast("binary")).alias("h"))
    one = top(pages, ["u"], ["page_id"], 1, "r").drop("r")
    return top(one, ["h"], ["page_id"], 1, "r").select("page_id", "u")


DEDUPE_SQL = f"""
WITH c AS ({URL_SQL.strip().replace("SELECT page_id, scheme ||", "SELECT q.page_id, scheme ||")}), p AS (SELECT c.page_id, canonical AS u, md5(html) AS h FROM c JOIN pages USING (page_id)),
o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY u ORDER BY page_id) = 1)
SELECT page_id, u FROM o QUALIFY row_number() OVER (PARTITION BY h ORDER BY page_id) = 1
"""


def near_duplicate_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Documents by likeness of their word sets: pairs at 0.8 or more of representatives, each of a set that n_a or n_b
    documents have, and met through a rare word.

    Words are known by 64-bit hashes and ordered by how many sets have them, as far as they are among the MOST_COUNTED
    commonest, whose counts are sent to tasks, before these by hash. Two sets at 0.8 share a word among the first
    n - ceil(0.8 n) + 1 of both, so only these are matched, between sets of lengths that allow 0.8 and where enough words
    are left behind the match; what meets is verified on the sets, first by signatures."""
    keep = keeper(spark, "jaccard")
    words = F.array_sort(F.array_distinct(F.transform(T.tokens(F.col("text")), lambda w: F.xxhash64(w))))
    sets = table(spark, d, "documents").select("doc_id", words.alias("s")).where(F.size("s") > 0)
    sets = keep(sets.groupBy("s").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")).where("id is not null").withColumn("set", F.monotonically_increasing_id()), "sets")
    often = sets.select(F.explode("s").alias("w")).groupBy("w").agg(F.count("*").alias("df")).where("df > 1").orderBy(F.desc("df"), "w").limit(MOST_COUNTED).toArrow()
    counted = np.array(often["w"], np.int64)
    order = np.argsort(counted)
    sent = spark.sparkContext.broadcast((counted[order], np.array(often["df"], np.int64)[order]))

    def first(batches):
        known, df = sent.value
        for batch in batches:
            s, ids = batch["s"], batch["set"].to_numpy()
            n = np.diff(s.offsets.to_numpy())
            w = s.flatten().to_numpy()
            times = np.zeros(len(w), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, w), len(known) - 1)
                times = np.where(known[at] == w, df[at], 0)
            row = np.repeat(np.arange(len(n)), n)
            w = w[np.lexsort((w, times, row))]
            place = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + 1
            few = place <= np.repeat(n - -(-4 * n // 5) + 1, n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[few]]), pa.array(n[row[few]].astype(np.int32)), pa.array(place[few].astype(np.int32)), pa.array(w[few])], names=["id", "n", "at", "w"])

    found = sets.select("set", "s").mapInArrow(first, "id long, n int, at int, w long")
    left, right = (found.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("at").alias(f"at{k}"), "w") for k in ("a", "b"))
    left_over = "9 * (1 + least(na - ata, nb - atb)) >= 4 * (na + nb)"  # holds at least for the first word that two sets share
    met = left.join(right.hint("merge"), "w").where(f"a < b and 5 * least(na, nb) >= 4 * greatest(na, nb) and {left_over}").select("a", "b").distinct()
    return verified(met, sets, keep).select("a", "b", "n_a", "n_b", F.round(F.col("both") / F.col("any"), 6).alias("likeness"))


JACCARD_SQL = """
WITH t AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[0-9a-z]+'))) AS s FROM documents),
r AS (SELECT s, min(doc_id) AS id, count(*) AS copies, len(s) AS n FROM t WHERE len(s) > 0 GROUP BY s), w AS (SELECT id, n, copies, unnest(s) AS w FROM r),
p AS (SELECT x.id AS a, y.id AS b, x.copies AS n_a, y.copies AS n_b, x.n + y.n - count(*) AS any_, count(*) AS both_ FROM w x JOIN w y ON x.w = y.w AND x.id < y.id GROUP BY x.id, y.id, x.n, y.n, x.copies, y.copies)
SELECT a, b, n_a, n_b, round(both_ / any_, 6) AS likeness FROM p WHERE 5 * both_ >= 4 * any_
"""


def store_diff(spark: SparkSession, d: str) -> DataFrame:
    """Documents against labels as two stores: counts of each side and whether 'value' agrees."""
    active = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("v"))
    backup = table(spark, d, "labels").select("doc_id", F.col("quality").alias("v"))
    return S.store_diff(active, backup, "doc_id", "v").groupBy("side").agg(F.count("*").alias("n"))


DIFF_SQL = """SELECT CASE WHEN l.doc_id IS NULL THEN 'active_only' WHEN d.doc_id IS NULL THEN 'backup_only' WHEN n_chars % 2 IS DISTINCT FROM quality THEN 'changed' ELSE 'same' END AS side, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"""


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """Labelled share of each source, and its status."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("l")).distinct(), "doc_id", "left")
    share = F.round(F.count("l") / F.count("*"), 6)
    return docs.groupBy("source").agg(F.count("*").alias("expected"), F.count("l").alias("observed"), share.alias("ratio"), F.when(share >= 0.5, "covered").when(share > 0, "partial").otherwise("missing").alias("status"))


COVERAGE_SQL = """SELECT source, count(*) AS expected, count(l.doc_id) AS observed, round(count(l.doc_id) / count(*), 6) AS ratio,
CASE WHEN round(count(l.doc_id) / count(*), 6) >= 0.5 THEN 'covered' WHEN count(l.doc_id) > 0 THEN 'partial' ELSE 'missing' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source"""


def kpi_report_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Orders by priority as an answer log: rates of each status and the alerts they raise."""
    n = F.count("*")
    rate = lambda s: F.round(F.avg((F.col("o_orderstatus") == s).cast("int")), 6)
    out = table(spark, d, "orders").groupBy("o_orderpriority").agg(n.alias("n"), rate("P").alias("caution"), rate("F").alias("unsupported"))
    alerts = F.array_compact(F.array(F.when((F.col("n") >= 10) & (F.col("caution") >= 0.2), "caution"), F.when((F.col("n") >= 10) & (F.col("unsupported") >= 0.1), "unsupported")))
    return out.withColumn("alerts", F.array_join(alerts, ","))


KPI_SQL = """WITH k AS (SELECT o_orderpriority, count(*) AS n, round(avg(CAST(o_orderstatus = 'P' AS INT)), 6) AS caution, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS unsupported FROM orders GROUP BY 1)
SELECT *, concat_ws(',', CASE WHEN n >= 10 AND caution >= 0.2 THEN 'caution' END, CASE WHEN n >= 10 AND unsupported >= 0.1 THEN 'unsupported' END) AS alerts FROM k"""


def claim_compare(spark: SparkSession, d: str) -> DataFrame:
    """Line items as claims: task is the part's type, metric the return flag, direction the line status. Groups with
    at least two peers are aligned or in conflict."""
    claims = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = claims.groupBy("p_type", "l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_linestatus").alias("directions"), F.countDistinct("p_brand").alias("datasets"), F.round(F.min("l_discount"), 4).alias("least"), F.round(F.max("l_discount"), 4).alias("most"))
    kind = F.when(F.col("directions") > 1, "conflict").when(F.col("datasets") > 3, "scope_mismatch").otherwise("aligned")
    return g.where("n >= 2").withColumn("alignment", kind)


CLAIM_SQL = """SELECT p_type, l_returnflag, count(*) AS n, count(DISTINCT l_linestatus) AS directions, count(DISTINCT p_brand) AS datasets, round(min(l_discount), 4) AS least, round(max(l_discount), 4) AS most,
CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'conflict' WHEN count(DISTINCT p_brand) > 3 THEN 'scope_mismatch' ELSE 'aligned' END AS alignment FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(*) >= 2"""


def contradiction_score(spark: SparkSession, d: str) -> DataFrame:
    """Share of each user's (subject, object) claims that are asserted both ways; the sign of a value is its polarity."""
    claims = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    pairs = claims.groupBy("user_id", "k").agg(F.count("*").alias("n"), F.countDistinct(F.col("value") > 20).alias("sides"))
    return pairs.groupBy("user_id").agg(F.sum("n").alias("claims"), F.round(F.least(F.lit(1.0), F.sum((F.col("sides") > 1).cast("int")) / F.count("*")), 6).alias("contradiction"))


CONTRADICTION_SQL = """WITH p AS (SELECT user_id, json_extract_string(props, '$.k') AS k, count(*) AS n, count(DISTINCT value > 20) AS sides FROM events GROUP BY ALL)
SELECT user_id, CAST(sum(n) AS BIGINT) AS claims, round(least(1.0, sum(CAST(sides > 1 AS INT)) / count(*)), 6)::DOUBLE AS contradiction FROM p GROUP BY user_id"""


def lifecycle_invalidate(spark: SparkSession, d: str) -> DataFrame:
    """Labels go stale where their document's hash is no longer the one on record; hand-made ones (toxic) stay."""
    now = table(spark, d, "documents").select("doc_id", F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 4), 16, 10).cast("long").alias("h"))
    rows = table(spark, d, "labels").join(now, "doc_id", "left")
    stale = (F.col("h").isNull() | (F.col("h") % 3 == 0)) & (F.col("toxic") == 0)
    return rows.select("doc_id", F.coalesce(stale, F.lit(False)).alias("stale"))


LIFECYCLE_SQL = """WITH n AS (SELECT doc_id, CAST('0x' || substr(md5(text), 1, 4) AS BIGINT) AS h FROM documents)
SELECT l.doc_id, coalesce((h IS NULL OR h % 3 = 0) AND toxic = 0, false) AS stale FROM labels l LEFT JOIN n USING (doc_id)"""


def keep_latest(spark: SparkSession, d: str) -> DataFrame:
    """The customer table after an upsert of nation 3 with raised balances and a delete of one segment."""
    stored = table(spark, d, "customer").withColumn("version", F.lit(1))
    changes = stored.where("c_nationkey = 3").withColumn("c_acctbal", F.round(F.col("c_acctbal") + 100, 2)).withColumn("version", F.lit(2))
    return S.delete_where(S.upsert(stored, changes, "c_custkey", "version"), {"c_mktsegment": "MACHINERY"}).select("c_custkey", "c_acctbal", "version")


LATEST_SQL = "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN round(c_acctbal + 100, 2) ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN 2 ELSE 1 END AS version FROM customer WHERE c_mktsegment IS DISTINCT FROM 'MACHINERY'"


def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    """Orders after customers are merged into the least key of their nation and segment: every reference is remapped."""
    c = table(spark, d, "customer")
    to = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("target"))
    remap = c.join(to, ["c_nationkey", "c_mktsegment"]).select(F.col("c_custkey").alias("o_custkey"), "target")
    return table(spark, d, "orders").join(remap, "o_custkey").groupBy("target").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


MERGE_SQL = """WITH r AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS target FROM customer)
SELECT target, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN r ON o_custkey = c_custkey GROUP BY target"""


def elbow_cut(spark: SparkSession, d: str) -> DataFrame:
    """How many parts of each brand to keep: where the price drops most, between the 3rd and 20th."""
    ranked = top(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 21)
    drop = F.round(F.col("p_retailprice") - F.lead("p_retailprice").over(Window.partitionBy("p_brand").orderBy("rank")), 4)
    return ranked.withColumn("drop", drop).where("rank between 3 and 20 and drop is not null").groupBy("p_brand").agg(F.max_by("rank", F.struct("drop", -F.col("rank"))).alias("keep"), F.max("drop").alias("drop"))


ELBOW_SQL = """
WITH r AS (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 21),
x AS (SELECT p_brand, rank, round(p_retailprice - lead(p_retailprice) OVER (PARTITION BY p_brand ORDER BY rank), 4) AS drop_ FROM r)
SELECT p_brand, CAST(rank AS INT) AS keep, drop_ AS "drop" FROM x WHERE rank BETWEEN 3 AND 20 AND drop_ IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY drop_ DESC, rank) = 1
"""


def graph_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the nation, customer and order tables, and orders per status as relations per predicate."""
    count = lambda name: table(spark, d, name).agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    status = table(spark, d, "orders").groupBy(F.concat(F.lit("orders:"), "o_orderstatus").alias("what")).agg(F.count("*").alias("n"))
    return count("nation").unionByName(count("customer")).unionByName(count("orders")).unionByName(status)


TOTALS_SQL = """SELECT 'nation' AS what, count(*) AS n FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'orders:' || o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus"""


def monthly_spend(spark: SparkSession, d: str) -> DataFrame:
    """Spend of each month and priority, and the month's."""
    orders = table(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return orders.rollup("month", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.grouping("o_orderpriority").cast("int").alias("whole"), F.grouping("month").alias("_all")).where("_all = 0").drop("_all")


SPEND_SQL = """SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, round(sum(o_totalprice), 2) AS spent, CAST(grouping(o_orderpriority) AS INT) AS whole FROM orders GROUP BY GROUPING SETS ((1, o_orderpriority), (1))"""


def episode_search(spark: SparkSession, d: str) -> DataFrame:
    """Conversations by the words of a request they hold: one each, and one and a half for the phrase."""
    said = table(spark, d, "conversations").groupBy("conv_id").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.coalesce(t["text"], F.lit(""))), "\n")).alias("s"))
    score = sum((F.col("s").contains(w).cast("double") for w in ("the", "thation", "one")), F.lit(0.0)) + 1.5 * F.col("s").contains("the one").cast("double")
    return best(said.select("conv_id", score.alias("score")).where("score > 0"), [F.desc("score"), "conv_id"], 10)


EPISODE_SQL = """WITH s AS (SELECT conv_id, lower(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS s FROM conversations GROUP BY conv_id),
x AS (SELECT conv_id, CAST(contains(s, 'the') AS DOUBLE) + CAST(contains(s, 'thation') AS DOUBLE) + CAST(contains(s, 'one') AS DOUBLE) + 1.5 * CAST(contains(s, 'the one') AS DOUBLE) AS score FROM s)
SELECT conv_id, score, CAST(row_number() OVER (ORDER BY score DESC, conv_id) AS INT) AS rank FROM x WHERE score > 0 QUALIFY rank <= 10"""

QUERIES = {
    "precision_at_k": (precision_at_k, PRECISION_SQL),
    "stage_a_metrics": (stage_a_metrics, STAGE_SQL),
    "delta_vs_baseline": (delta_vs_baseline, DELTA_SQL),
    "upper_median_age": (upper_median_age, MEDIAN_SQL),
    "dedupe_two_pass": (dedupe_two_pass, DEDUPE_SQL),
    "near_duplicate_jaccard": (near_duplicate_jaccard, JACCARD_SQL),
    "store_diff": (store_diff, DIFF_SQL),
    "coverage_report": (coverage_report, COVERAGE_SQL),
    "kpi_report_alerts": (kpi_report_alerts, KPI_SQL),
    "claim_compare": (claim_compare, CLAIM_SQL),
    "contradiction_score": (contradiction_score, CONTRADICTION_SQL),
    "lifecycle_invalidate": (lifecycle_invalidate, LIFECYCLE_SQL),
    "keep_latest": (keep_latest, LATEST_SQL),
    "merge_entities": (merge_entities, MERGE_SQL),
    "elbow_cut": (elbow_cut, ELBOW_SQL),
    "graph_totals": (graph_totals, TOTALS_SQL),
    "monthly_spend": (monthly_spend, SPEND_SQL),
    "episode_search": (episode_search, EPISODE_SQL),
}
