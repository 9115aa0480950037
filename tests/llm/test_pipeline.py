"""The pipeline's stages, each against its own input."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from quarrymill.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
    assert sizes[1] <= sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2] and sizes[5] == sizes[4]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_take_odd_rows(spark, tmp_path):
    """What each stage keeps of nulls, empty and long texts, repeated rows and ids; clashing columns stay."""
    passage = "some words " * 30
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (1, "", "en", None, 0), (2, passage, None, "a", 330), (2, passage, None, "a", 330), (3, "x" * 50_000, "en", "b", 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("uid", F.lit(7)).withColumn("size", F.lit("x"))
    kept = {
        "toxicity": [(None, 0), (1, 0), (1, 0), (2, 330), (2, 330), (3, 50_000)],  # none is toxic
        "near-copies": [(1, 0), (2, 330), (3, 50_000)],  # one of the empty ones, of the copies, and the long one
        # of repeated words the first hundred bytes or so stay: a passage of equal words repeats itself; of copies the first keeps them
        "repeats": None,
        "mix": None,
        "tokens": None,
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        found = out.collect()
        if kept[name]:
            assert sorted(((r["doc_id"], len(r["text"] or "")) for r in found), key=str) == sorted(kept[name], key=str)
        if name == "repeats":
            assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
            # windows of two words recur after 11 bytes, those of one letter after 1: the first window of each stays
            assert max(len(r["text"]) for r in found if r["doc_id"] == 3) < 200
        if name == "mix":
            assert {r["doc_id"] for r in found} == {2, 3}  # texts without words are left out
        if name == "tokens":
            assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
            assert sorted(r["n_tokens"] for r in found)[:3] == [0, 0, 0]
        else:
            assert out.columns == docs.columns
        assert stage(spark, docs.where("false"), SF).collect() == []


def test_whole_queries_over_empty_tables(spark, tmp_path):
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.QUERIES.items():
        assert [r["conv_id"] for r in query(spark, str(tmp_path)).collect()] == [-1] if name == "op6_chat_format" else query(spark, str(tmp_path)).collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
