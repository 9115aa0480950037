"""Literal cases of functions and operators."""

from pyspark.sql import functions as F

from quarrymill.functions import chunking
from quarrymill.functions import queries as Q
from quarrymill.functions import text as T
from quarrymill.operators import evaluation, events, evidence, graph, learning, retrieval
from quarrymill.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_canonical_url(spark):
    assert one(spark, T.canonical_url(F.lit("HTTP://A.com/x/?utm_a=1&b=2&a=1#f"))) == "http://a.com/x?a=1&b=2"
    assert one(spark, T.canonical_url(F.lit("a.com"))) == "https://a.com/"
    assert one(spark, T.canonical_url(F.lit("http://a.com"))) == "http://a.com/"
    assert one(spark, T.canonical_url(F.lit("http://a.com/?igshid=1&b="))) == "http://a.com/"
    assert one(spark, T.canonical_url(F.lit(" https://a.com//?q=a%20b+c&Q=%C3%A9~*&novalue"))) == "https://a.com/?Q=%C3%A9~%2A&q=a+b+c"
    assert one(spark, T.canonical_url(F.lit("  "))) == ""


def test_cleaning_drops_lines_that_begin_like_boilerplate(spark):
    text = "Cookie settings\nWe never sell a cookie\r\n  sign in \n\n\nok\nsponsoredly  spoken\u00a0 words\nNewsletter"
    assert one(spark, T.clean_text(F.lit(text))) == "We never sell a cookie\n\nsponsoredly spoken words"


def test_quality_of_a_text_worked_out_by_hand(spark):
    text = "\n".join(["Agent safety rag words"] * 10 + ["cookie notice"])  # 40 tokens, 4 different, 3 signal terms ("ai" is in none)
    parts = T.quality_parts(T.clean_text(F.lit(text)))
    got = spark.range(1).select(*[c.alias(n) for n, c in parts.items()]).first()
    assert (got["n_tokens"], got["unique_ratio"], got["signal_hits"], got["noise_ratio"]) == (40, 0.1, 3, 0.0)
    assert got["score"] == 0.303 and not got["approved"] and got["reasons"] == "low_diversity"


def test_unit_types_by_words_then_shape(spark):
    for text, kind in (("Our approach", "method"), ("Evaluation of it", "result"), ("An overview", "section"), ("x\n - item", "list_block"), ("a|b\nc|d", "table_block"), ("a|b", "section"), ("x" * 178 + " abstract", "section")):
        assert one(spark, T.unit_type(F.lit(text))) == kind
    assert one(spark, T.unit_type(F.lit("x"), F.lit("요약"))) == "summary"


def test_text_levels(spark):
    for text, level in (("", "P3"), ("https://x.y", "P3"), ('{"a":1}', "P1"), ("plain prose", "P2"), ("a@b.co", "P0"), (None, "P3")):
        assert one(spark, T.text_level(F.lit(text).cast("string"))) == level


def test_freshness_and_importance(spark):
    assert one(spark, T.freshness(F.lit(None).cast("double"))) == 0.25
    assert one(spark, T.freshness(F.lit(0.0))) == 1.0
    assert abs(one(spark, T.freshness(F.lit(30.0))) - 0.462698) < 1e-5
    assert one(spark, T.importance(F.lit(1.0), F.lit(8), F.lit(12), F.lit(1.0))) == 1.0


def test_duplicate_parent_penalty_and_round_robin(spark):
    rows = spark.createDataFrame([(1, "A", 0.9, 1), (1, "A", 0.8, 2), (1, "A", 0.7, 3), (1, "B", 0.6, 4), (1, "C", 0.5, 5), (1, "B", 0.4, 6)], "q int, p string, s double, id int")
    got = {r["id"]: round(r["s"] - r["penalised"], 6) for r in retrieval.duplicate_parent_penalty(rows, "q", "p", "s", "id").collect()}
    assert [got[k] for k in (1, 2, 3)] == [0, 0.32, 0.45]
    placed = retrieval.round_robin(rows, "q", "p", "s", "id").orderBy("position").collect()
    assert [r["p"] for r in placed] == ["A", "B", "C", "A", "B", "A"]


def test_fusion_and_rescue(spark):
    lex = spark.createDataFrame([(1, 1, 1.0, 1), (1, 2, 1.0, 1)], "query_id int, doc int, lex double, lex_rank int")
    sem = spark.createDataFrame([(1, 1, 0.5)], "query_id int, doc int, sem double")
    got = {r["doc"]: r["score"] for r in retrieval.fuse(lex, sem, "doc").collect()}
    assert got == {1: 0.65, 2: 0.84}


def test_precision_counts_labelled_rows_only(spark):
    rows = spark.createDataFrame([("g", "q", 1, 1), ("g", "q", 2, None), ("g", "q", 3, 0)], "g string, q string, rank int, label int")
    r = evaluation.precision_at_k(rows, "q", "rank", "label", 5, ["g"]).first()
    assert (r["precision_at_k"], r["hit_at_3"]) == (0.5, 1.0)


def test_components_and_closure(spark, tmp_path):
    at = iter(range(1000))

    def keep(df, k):
        path = str(tmp_path / str(next(at)))
        df.write.parquet(path)
        return spark.read.parquet(path)

    nodes = spark.createDataFrame([(k,) for k in range(6)], "n long")
    edges = spark.createDataFrame([(3, 1), (1, 2), (4, 5)], "a long, b long")
    assert {r["n"]: r["component"] for r in graph.components(nodes, edges, "n", "a", "b", keep).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    closed = {(r["a"], r["b"]): r["depth"] for r in graph.closure(edges, "a", "b", keep).collect()}
    assert closed == {(3, 1): 1, (1, 2): 1, (4, 5): 1, (3, 2): 2}


def test_chunks_cover_the_text():
    text = "One sentence. " * 400
    spans = chunking.chunk_spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b > a and c < b for (a, b), (c, _) in zip(spans, spans[1:]))
    assert chunking.chunk_spans("") == []
    assert chunking.sections("lost\n# A\nx\n## B\ny\n# C\n") == [("A", "A", "x"), ("B", "A > B", "y"), ("C", "C", "")]


def test_sessions_and_fresh_runs(spark):
    rows = spark.createDataFrame([("u", "2024-01-01 00:00:00", 1), ("u", "2024-01-01 01:00:00", 2), ("u", "2024-01-02 00:00:00", 3)], "u string, ts string, id int").withColumn("ts", F.to_timestamp("ts"))
    assert [r["session"] for r in events.sessions(rows, "u", "ts", "id", 7200).orderBy("id").collect()] == [1, 1, 2]
    runs = spark.createDataFrame([("r", 1, "failed"), ("r", 2, "completed"), ("r", 3, "started")], "r string, t int, status string")
    assert [r["fresh"] for r in events.fresh_runs(runs, ["r"], ["t"], "status").orderBy("t").collect()] == [True, True, False]


def test_upsert_and_delete(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, at int")
    changes = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "id int, v string, at int")
    out = tables.delete_where(tables.upsert(stored, changes, "id", "at"), {"v": "a"})
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(2, "c"), (3, "d")]
    assert tables.merge_filters({"a": 1}, {"a": 2, "b": 3}) == {"a": 2, "b": 3}


def test_query_intent_and_time(spark):
    cases = (
        ("RAG vs fine-tuning", "comparison", "none", ""), ("arXiv 2401.01234 since 2021", "paper_lookup", "after", "2021"), ("find papers about agents", "paper_topic", "none", ""),
        ("the citation", "paper_lookup", "none", ""), ("patch this before 2019", "implementation", "before", "2019"), ("benchmark prior to 2022", "evaluation", "before", "2022"),
        ("how to install", "howto", "none", ""), ("define entropy", "definition", "none", ""), ("vector index latest", "evaluation", "latest", ""), ("vector index recent", "topic_lookup", "latest", ""),
        ("many words about some rather unusual subject matter", "definition", "none", ""), ("", "definition", "none", ""), (None, "definition", "none", ""), ("2020 이전 모델", "topic_lookup", "before", "2020"),
    )
    assert one(spark, Q.query_words(F.lit("그리고 Sparse 모델 있는 the 구조 모델 의"))) == ["sparse", "모델", "구조"]
    for text, intent, mode, year in cases:
        t = F.lit(text).cast("string")
        assert (one(spark, Q.intent(t)), *(one(spark, x) for x in Q.temporal(t))) == (intent, mode, year), text


def test_dropped_evidence_drops_nothing(spark):
    rows = spark.createDataFrame([("q", 1, "a", "x"), ("q", 2, "b", "x"), ("q", 3, "b", "y"), ("q", 4, "a", "z"), ("r", 1, "a", None), ("r", 2, "c", None)], "q string, rank int, k string, f string")
    assert sorted((r["q"], r["rank"]) for r in evidence.dedupe(rows, "q", "rank", "k", "f").collect()) == [("q", 1), ("q", 3), ("r", 1), ("r", 2)]
    for kind, intent, most in (("paper", "definition", 2), ("paper", "evaluation", 4), ("web", "comparison", 5), ("web", "howto", 6)):
        assert one(spark, evidence.most_sources(F.lit(kind), F.lit(intent))) == most


def test_learning_edges(spark):
    rows = spark.createDataFrame([("x", "y", "requires", 0.5), ("x", "y", "part_of", 0.9), ("x", "x", "enables", 0.9), ("x", "z", "related_to", 0.9), ("x", None, "enables", 0.9)], "source string, target string, predicate string, confidence double")
    assert sorted(map(tuple, learning.relation_edges(rows).collect())) == [("x", "y", "recommended_before", 0.9), ("y", "x", "prerequisite", 0.85)]
    claims = spark.createDataFrame([("a", "b", "A builds on B and requires it", 0.5), ("a", "a", "requires", 0.5), ("a", "b", "nothing", 0.5), ("a", "b", None, 0.5)], "subject string, object string, text string, confidence double")
    assert sorted(map(tuple, learning.claim_edges(claims).collect())) == [("b", "a", "builds_on", 0.62), ("b", "a", "prerequisite", 0.76)]


def test_links_resolve_to_single_notes(spark):
    notes = spark.createDataFrame([(1, "a/one", "one", "first"), (2, "b/two", "two", "same"), (3, "c/two", "two", "same"), (4, None, None, None)], "id int, path string, stem string, alias string")
    links = spark.createDataFrame([(2, "a/one"), (2, "x/one"), (3, "two"), (3, "first"), (3, "same"), (3, "gone"), (4, None)], "id int, key string")
    assert sorted(map(tuple, learning.resolve_links(notes, links).collect())) == [(2, 1), (3, 1)]


def test_answer_stage_needs_rows_for_every_rate(spark):
    full = ("s", True, True, True, True, 1, "good", True, False, True)
    rows = spark.createDataFrame([full, ("t", True, True, True, False, 0, None, False, False, False), ("t", False, True, True, True, 1, "good", True, False, True)], "g string, top1 boolean, answerable boolean, substantive boolean, temporal boolean, grounded long, label string, abstains boolean, wrong_era boolean, must_abstain boolean")
    got = {r["g"]: r for r in evaluation.answer_stage(rows, "g").collect()}
    assert got["s"]["passed"] and got["s"]["good_or_partial"] == 1.0
    assert not got["t"]["passed"] and got["t"]["results"] == 1 and got["t"]["judged"] == 0 and got["t"]["grounded"] == 0.0
