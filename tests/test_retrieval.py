"""The words that queries are made of, and how often searches read the texts."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill.functions.text import tokens
from quarrymill.operators import retrieval as R
from quarrymill.plans import retrieval as plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most_sent", [R.MOST_SENT, 1])
def test_asked_words_are_counted_over_all_rows(spark, monkeypatch, most_sent):
    monkeypatch.setattr(R, "MOST_SENT", most_sent)
    docs = spark.createDataFrame([(0, "Ann bee bee cat"), (1, "bee dog"), (2, "cat bee"), (3, None), (4, "dog ann"), (100, "dog"), (None, "cat")], "id long, text string").repartition(3)
    asked, df = R.asked_words(docs, "id", "text", F.col("id") % 100 == 0)
    assert sorted(map(tuple, asked.collect())) == [(0, "ann"), (0, "bee"), (0, "cat"), (100, "dog")]
    assert sorted(map(tuple, df.collect())) == [("ann", 2), ("bee", 3), ("cat", 3), ("dog", 3)]
    assert [tuple(r) for r in R.rare_words(docs, "id", "text", F.col("id") == 0, 2).collect()] == [(0, ["ann", "bee"])]
    tf = R.postings(docs, "id", "text", spark.createDataFrame([(9, ["bee", "none"])], "query_id long, terms array<string>"))
    assert sorted((r["word"], r["id"], r["len"], r["tf"]) for r in tf.collect()) == [("bee", 0, 4, 2), ("bee", 1, 2, 1), ("bee", 2, 2, 1)]


@pytest.mark.parametrize(("query", "scans"), [("parent_diversify", 1), ("duplicate_parent_penalty", 1), ("source_budget_topk", 1), ("feature_boost_rank", 2)])
def test_hits_are_not_searched_for_again_by_each_reader(spark, query, scans):
    plan = plans.QUERIES[query][0](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    # of documents only sources and features are still to be read, not the texts
    assert plan.count("documents.parquet") == scans and "text" not in plan


@pytest.mark.parametrize("query", ["parent_diversify", "duplicate_parent_penalty", "source_budget_topk", "feature_boost_rank"])
def test_queries_meet_postings_once(spark, query):
    plan = plans.QUERIES[query][0](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # the hits are read back: no reader of the result counts a query's words in the postings again
    assert "n_terms" not in plan and "tf#" not in plan


@pytest.mark.parametrize("piece", [4 << 20, 8])
def test_all_texts_of_a_batch_are_cut_as_tokens_cuts_each(spark, monkeypatch, piece):
    """Capitals, letters that become ASCII in lower case (a dotted I, the sign of Kelvin), null, empty and wordless texts."""
    monkeypatch.setattr(R, "PIECE", piece)
    texts = ["Ann BEE-bee 42", None, "", "x", "\u0130stanbul 5\u212aelvin", "...", "a\u00c9\u00c9b", "end ", " of", "Z" * 50, "\u4e2d\u6587", "last"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    raw = {r["id"]: r["_text"] for r in R._bytes(docs, "text", "id").collect()}
    words, counts = R._cut(pa.array([None if raw[i] is None else bytes(raw[i]) for i in range(len(texts))], pa.binary()))
    flat, at = [w.decode() for w in words.to_pylist()], 0
    for row in docs.select("id", tokens(F.col("text")).alias("w")).orderBy("id").collect():
        assert flat[at : at + counts[row["id"]]] == (row["w"] or [])
        at += counts[row["id"]]
    assert at == len(flat)


def test_budgets_of_sources_need_no_range_of_scores(spark):
    plan = plans.source_budget_topk(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_hi" not in plan and "normalised" not in plan


@pytest.mark.parametrize("few", [True, False])
def test_hits_of_odd_rows_match_sql(spark, tmp_path, monkeypatch, few):
    """Null, empty and wordless texts, null and repeated ids, repeated rows, words with letters beyond ASCII between."""
    if not few:
        monkeypatch.setattr(R, "MOST_SENT", 1)
        monkeypatch.setattr(R, "MOST_ASKED", 1)
    rows = [
        (0, "Ann bee bee cat"), (100, "bee-dog\u00e9bee \u00c9t\u00c9 42"), (200, None), (300, ""), (400, "cat cat"), (500, "nowhere else"), (1, "ann, BEE; cat\tdog"), (2, None), (3, "\u4e2d\u6587 ..."),
        (4, "t bee dog 42 ann cat"), (None, "dog bee t ann cat"), (None, "cat"), (7, "ann bee"), (7, "cat ann bee"), (7, "cat"), (8, "t 42 dog"), (8, "t 42 dog"), (600, "ann dog"), (600, "ann dog"),
    ]
    docs = spark.createDataFrame([(*r, "s", "en", 0) for r in rows], "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r["query_id"], r["doc_id"], r["score"]) for r in plans._bm25(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got and got == sorted(con.sql(f"WITH {plans._BM25} SELECT query_id, doc_id, score FROM h").fetchall(), key=str)
