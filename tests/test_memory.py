"""Two-level search on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import memory as M

FIELDS = "document_id long, document_title string, source_type string, source_ref string, summary string, thesis string, confidence double, document_date string, event_date string, observed_at string, incoming int, outgoing int"
UNITS = "document_id long, unit_id string, order_index int, document_title string, title string, section_path string, excerpt string, unit_type string, source_type string, confidence double"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_words_variants_and_overlap(spark):
    assert value(spark, M.query_terms(F.lit("  Self-RAG: memory/v2, the_end "))) == ["self-rag", "memory/v2", "the_end"]
    assert sorted(value(spark, M.variants(F.lit("re-ranks")))) == ["re-rank", "re-ranks", "rerank", "reranks"]
    assert value(spark, M.variants(F.lit("gas"))) == ["gas"]
    terms = F.array(F.lit("deep"), F.lit("net"))
    assert value(spark, M.text_overlap(terms, F.lit("A Deep"), F.lit("net"))) == 4.0
    assert value(spark, M.text_overlap(terms, F.lit("networks"), F.lit(None).cast("string"))) == 1.0
    assert value(spark, M.text_overlap(F.array().cast("array<string>"), F.lit("x"))) == 0.0


def test_title_signals(spark):
    hits, asked = M.title_words(F.lit("Vision Transformers scaling"), F.lit("Scaling Vision Transformer"), F.lit(""))
    assert value(spark, M.title_match(hits, asked)) == 4.25
    titled = M.asks_for_title(F.lit("Vision Transformers scaling"), hits, asked)
    assert [value(spark, M.source_boost(titled, F.lit(k))) for k in ("paper", "vault", "web")] == [1.75, 0.0, 0.25]
    one, all_ = M.title_words(F.lit("plain words of memory"), F.lit("Memory"), F.lit(None).cast("string"))
    assert value(spark, M.title_match(one, all_)) == 0.625
    assert value(spark, M.asks_for_title(F.lit("plain words of memory"), one, all_)) is False
    assert value(spark, M.generic_title_penalty(F.lit(True), F.lit("web"), F.lit("Memory agents"))) == 3.0
    assert value(spark, M.generic_title_penalty(F.lit(True), F.lit("paper"), F.lit("Memory agents"))) == 0.0


@pytest.mark.parametrize(
    ("query", "dates", "kind", "expected"),
    [
        ("changes after 2022", (None, "2023-05-01", None), "paper", 1.5), ("changes after 2022", ("2021", None, None), "paper", -0.75), ("latest results", (None, "2024-01-31T10:00:00Z", None), "paper", 1.2),
        ("latest results", (None, None, "2024-01-31"), "web", 0.42), ("latest results", (None, None, "2024-01-31"), "vault", 1.2), ("before 2020", (None, None, "2021-01-01"), "web", -0.375),
        ("before the flood", (None, "2021", None), "paper", 0.0), ("since long", (None, "2010", None), "paper", 0.0), ("plain", (None, "2024", None), "paper", 0.0), ("latest", (None, "no date", None), "web", 0.0),
    ],
)
def test_temporal_signal(spark, query, dates, kind, expected):
    item = dict(zip(("event_date", "document_date", "observed_at"), (F.lit(x).cast("string") for x in dates))) | {"source_type": F.lit(kind)}
    assert value(spark, M.temporal_signal(F.lit(query), item, 2026)) == expected


def test_other_signals(spark):
    assert value(spark, M.updates_signal(F.lit("what changed"), F.lit(7), F.lit(2))) == 1.45
    assert value(spark, M.updates_signal(F.lit("plain"), F.lit(7), F.lit(2))) == 0.0
    assert [value(spark, M.type_signal(F.lit(q), F.lit(u))) for q, u in (("which method", "method"), ("which method", "result"), ("plain", "section"), ("plain", "result"))] == [2.5, -0.2, 0.6, 0.0]
    assert value(spark, M.web_update_bonus(F.lit("latest"), F.lit("web"), F.lit("Release guide, latest version"))) == 1.1
    assert [value(spark, M.parent_path(F.lit(p))) for p in ("a > b > c", "a", "", "a >  > b")] == ["a > b", "", "", "a"]
    none = {c: F.lit(None).cast("string") for c in M.TEXT_FIELDS}
    page = none | {"source_type": F.lit("web"), "summary": F.lit("Submitted on Monday. View PDF")}
    assert value(spark, M.is_archive_page(page)) and not value(spark, M.is_archive_page(page | {"source_type": F.lit("paper")}))
    assert [value(spark, M.archive_penalty(F.lit(q), F.lit(False), F.lit(True))) for q in ("plain", "latest")] == [4.8, 1.2]
    assert value(spark, M.explainer_bias(F.lit("explain it"), F.lit(False), F.lit(False), F.lit("paper"))) == 0.7
    appendix = none | {"source_type": F.lit("paper"), "title": F.lit("Appendix B")}
    assert [value(spark, M.appendix_penalty(F.lit(q), appendix)) for q in ("plain", "the appendix")] == [6.0, 0.0]
    pending = none | {"title": F.lit("메타데이터"), "summary": F.lit("pending_summary, cannot summarize")}
    assert [value(spark, M.placeholder_penalty(F.lit(q), pending)) for q in ("plain", "status")] == [6.0, 0.0]


@pytest.fixture(scope="module")
def found(spark):
    documents = [
        (1, "Sparse attention", "paper", "s/1", "windowed attention for long text", "t", 0.8, "2024", None, None, 2, 0),
        (2, "Dense retrieval", "web", "s/2", "attention is elsewhere", None, 0.8, None, None, None, 0, 0),
        (3, "Unrelated", "web", "s/3", "nothing shared", None, 1.0, None, None, None, None, None),
        (4, "Attention", None, None, None, None, None, None, None, None, None, None),
    ]
    units = [
        (1, "1:0", 0, "Sparse attention", "Intro", "A > Intro", "first words", "section", "paper", 0.5), (1, "1:1", 1, "Sparse attention", "Windows", "A > Windows", "windowed attention here", "method", "paper", 0.5),
        (1, "1:2", 2, "Sparse attention", "End", "B > End", "last words", "section", "paper", 0.5), (2, "2:0", 0, "Dense retrieval", "Only", "Only", " all of it ", "section", "web", None),
    ]
    queries = spark.createDataFrame([(10, "windowed attention", None), (11, "attention", 1), (12, "", None), (13, None, None), (None, "attention", None)], "query_id long, query string, not_document long")
    return {(r["query_id"], r["document_id"]): r for r in M.search(queries, spark.createDataFrame(documents, FIELDS), spark.createDataFrame(units, UNITS)).collect()}


def test_only_documents_that_share_a_term_are_found(found):
    assert set(found) == {(10, 1), (10, 2), (10, 4), (11, 2), (11, 4)}
    assert [found[10, k]["rank"] for k in (1, 2, 4)] == [1, 3, 2]


def test_scores_are_the_sums_of_their_parts(found):
    r = found[10, 1]
    # both terms and the phrase; one of two title words: 2.5 * 0.5; confidence
    assert (r["summary_match"], r["title_match"], r["confidence_part"], r["doc_score"]) == (4.0, 1.25, 0.4, 5.65)
    # both terms and the phrase in the excerpt, one of two title words, .75 * .5, depth 2 of a path, no type asked for
    assert (r["query_match"], r["unit_title_match"], r["unit_summary_match"], r["unit_confidence"], r["type_signal"], r["depth_penalty"]) == (4.0, 1.25, 1.4, 0.375, 0.0, -0.12)
    assert r["unit_score"] == pytest.approx(4.0 + 1.25 + 1.4 + 0.375 - 0.12)


def test_passages_stay_within_their_parent_section(found):
    r = found[10, 1]
    assert (r["unit_id"], r["segment_start"], r["segment_end"], r["segment"]) == ("1:1", 0, 1, "first words\n\nwindowed attention here")
    assert r["related"] == ["1:1", "1:0", "1:2"]
    assert (found[10, 2]["segment"], found[10, 2]["related"]) == ("all of it", ["2:0"])
    assert found[10, 4]["unit_id"] is None and found[10, 4]["segment"] is None and found[10, 4]["related"] is None


def test_empty_tables(spark):
    queries, documents, units = spark.createDataFrame([], "query_id long, query string"), spark.createDataFrame([], FIELDS), spark.createDataFrame([], UNITS)
    assert M.search(queries, documents, units).collect() == []


def test_only_found_documents_are_cut_into_chunks(spark, monkeypatch):
    from quarrymill.plans import memory as plans

    cut, whole = [], plans.chunking.chunks
    monkeypatch.setattr(plans.chunking, "chunks", lambda docs, *rest: cut.append(docs) or whole(docs, *rest))
    found = plans.memory_search(spark, "/root/testdata/sf0.001")
    assert [sorted(r[0] for r in d.select("doc_id").collect()) for d in cut] == [sorted({r[0] for r in found.select("document_id").collect()})]
