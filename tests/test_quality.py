"""The quality score reads each text once."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.plans import text as plans


@pytest.mark.parametrize("query", ["assess_quality", "sample_gate"])
def test_texts_are_cut_into_words_once(spark, query):
    plan = plans.QUERIES[query][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_stages_give_the_parts(spark):
    texts = [None, "", "one", "rag agent " * 30, "Deep learning and retrieval " + " ".join(f"w{k}" for k in range(600)), "x y " * 25]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, clean string")
    parts = T.quality_parts(F.col("clean"))
    want = rows.select("k", "clean", *[c.alias(n) for n, c in parts.items()])
    assert T.with_quality(rows, "clean").select(want.columns).orderBy("k").collect() == want.orderBy("k").collect()
