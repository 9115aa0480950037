"""Two-level search: documents by their summaries, then only the found documents' units, and the best unit with its
neighbours as one passage.

Signals are column expressions over a query's text and the fields of a document or unit; absent fields are null and
count as empty. Nothing is scored that shares no term with a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What marks a query's intent.
TEMPORAL = r"(?i)\b(latest|recent|updated|newest|changed since|before|after|since)\b|최근|최신|업데이트|이전|이후"
VERSION = r"(?i)\b(update|updated|latest|recent|version|revision|revised|release|newest|changed)\b|업데이트|최신|최근|버전|개정|릴리즈|변경"
EXPLAINER = r"(?i)\b(explain|purpose|role|difference|summary|overview|what is)\b|설명|목적|역할|차이|요약|개요|무엇"
BEFORE, AFTER = r"(?i)\b(before|prior to|earlier than)\b|이전", r"(?i)\b(after|since)\b|이후"
QUOTES = (":", '"', "'", "“", "”")
METADATA_ASKED = ("metadata", "메타데이터", "status", "상태")
APPENDIX_ASKED = ("appendix", "supplement", "reference", "references", "bibliography", "부록", "참고문헌")
#: Kinds of units in the order in which they are tried, with the words that ask for them.
KINDS_ASKED = {
    "method": ("method", "approach", "방법"),
    "result": ("result", "results", "evaluation", "finding", "결과", "평가"),
    "limitation": ("limitation", "limitations", "한계"),
    "summary": ("summary", "abstract", "overview", "요약", "개요"),
    "background": ("background", "introduction", "배경", "소개"),
}
#: Words of texts that raise or lower a score.
UPDATE_WORDS = ("updated", "latest", "recent", "version", "release", "guide", "guideline", "watchlist", "reference", "최신", "최근", "업데이트", "버전", "가이드", "레퍼런스")
GENERIC_WORDS = ("transformer", "retrieval", "memory", "attention", "rag", "diffusion", "agent", "agents")
ARCHIVE_WORDS = (
    "submitted on", "view pdf", "references & citations", "google scholar", "semantic scholar", "bibtex", "computer science >", "arxiv:",
    "submission history", "full-text links",
)
PENDING_WORDS = ("pending_summary", "요약본/번역본이 아직 등록되지 않았습니다")
NO_SUMMARY_WORDS = (
    "요약을 바로 작성할 수 없습니다", "원문이 필요합니다", "논문 원문", "제공된 정보만으로는", "cannot summarize", "unable to summarize",
    "need the original paper text",
)
TRANSLATION_WORD, METADATA_TITLE = "번역 완료 후", "메타데이터"
APPENDIX_WORDS = ("appendix", "supplementary", "supplemental", "references", "reference", "bibliography", "부록", "참고문헌")
APPENDIX_TITLES = ("appendix", "supplement", "references", "bibliography", "부록", "참고문헌")

TEXT_FIELDS = ("document_title", "title", "source_type", "source_ref", "heading_path", "summary", "header", "thesis", "search_text", "excerpt", "tags", "links", "event_date", "document_date", "observed_at", "section_path", "unit_type")
RELATED = 4


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def _joined(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def query_terms(query: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(F.coalesce(query, F.lit("")))), "[^0-9a-z가-힣._/-]+"), lambda t: t != "")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z가-힣]+"), lambda t: t != "")


def text_overlap(terms: Column, *parts: Column) -> Column:
    """1 for each term that the parts, joined, hold, and 2 for all of them as a phrase."""
    text = _joined(*parts)
    phrase = F.array_join(terms, " ")
    return F.size(F.filter(terms, lambda t: F.contains(text, t))) + F.when((phrase != "") & F.contains(text, phrase), 2.0).otherwise(0.0)


def variants(word: Column) -> Column:
    """A word, without hyphens and underscores, and both without a plural s."""
    compact = F.regexp_replace(word, "[-_]", "")
    singular = lambda w: F.when(w.endswith("s") & (F.length(w) >= 4), F.regexp_replace(w, "s$", ""))
    return F.filter(F.array_distinct(F.array(word, compact, singular(word), singular(compact))), lambda w: w.isNotNull() & (w != ""))


def title_words(query: Column, *titles: Column) -> tuple[Column, Column]:
    """(query words of two letters or more that titles hold in any variant, all of them)."""
    asked = F.filter(words_of(query), lambda w: F.length(w) >= 2)
    held = F.flatten(F.transform(F.concat(*map(words_of, titles)), variants))
    return F.filter(asked, lambda w: F.arrays_overlap(variants(w), held)), asked


def title_match(hits: Column, asked: Column) -> Column:
    ratio = F.size(hits) / F.greatest(F.lit(1), F.size(F.array_distinct(asked)))
    signal = 2.5 * ratio + F.when(ratio >= 0.66, 1.25).otherwise(0.0) + F.when(F.size(hits) >= 2, 0.5).otherwise(0.0)
    return F.when(F.size(hits) > 0, F.round(signal, 3)).otherwise(0.0)


def is_named(query: Column) -> Column:
    """A query for something with a name: a long number, quotes or a colon, or three words of Latin letters."""
    words = words_of(query)
    return F.exists(words, lambda w: w.rlike("^[0-9]{4,}$")) | _any(F.coalesce(query, F.lit("")), QUOTES) | (F.size(F.filter(words, lambda w: w.rlike("[a-z]"))) >= 3)


def asks_for_title(query: Column, hits: Column, asked: Column) -> Column:
    """Whether a query names something and titles hold two of its words and half of all."""
    ratio = F.size(F.array_distinct(hits)) / F.greatest(F.lit(1), F.size(F.array_distinct(asked)))
    return is_named(query) & (F.size(hits) >= 2) & (ratio >= 0.5)


def source_boost(titled: Column, source_type: Column) -> Column:
    kind = F.lower(F.coalesce(source_type, F.lit("")))
    return F.when(titled, F.when(kind == "paper", 1.75).when(kind == "vault", 0.0).otherwise(0.25)).otherwise(0.0)


def generic_title_penalty(titled: Column, source_type: Column, document_title: Column) -> Column:
    words = words_of(document_title)
    penalty = F.when(F.size(words) <= 2, 1.5).otherwise(0.0) + F.when((F.size(words) > 0) & F.forall(words, lambda w: w.isin(*GENERIC_WORDS)), 1.5).otherwise(0.0)
    return F.when(titled & (F.lower(F.coalesce(source_type, F.lit(""))) != "paper"), penalty).otherwise(0.0)


def temporal_signal(query: Column, item: dict[str, Column], year_now: int) -> Column:
    """The year of the first of event, document and observation date that can be read, against the query's year or now;
    a page known only by when it was seen counts less."""
    dates = [F.coalesce(F.try_to_timestamp(item[c]), F.try_to_timestamp(F.when(item[c].rlike(r"^\d{4}$"), F.concat(item[c], F.lit("-01-01"))))) for c in ("event_date", "document_date", "observed_at")]
    year, asked = F.year(F.coalesce(*dates)), F.nullif(F.regexp_extract(query, r"(20\d{2})", 1), F.lit("")).cast("int")
    recent = F.greatest(F.lit(0.0), 1.8 - (year_now - year) * 0.3)
    signal = (
        F.when(query.rlike(BEFORE), F.when(asked.isNull(), 0.0).when(year <= asked, 1.5).otherwise(-0.75))
        .when(query.rlike(AFTER) & asked.isNotNull(), F.when(year >= asked, 1.5).otherwise(-0.75)).otherwise(recent)
    )
    seen_only = dates[0].isNull() & dates[1].isNull() & (F.lower(F.trim(F.coalesce(item["source_type"], F.lit("")))) == "web")
    weighed = F.when(seen_only, F.when(signal > 0, signal * 0.35).otherwise(signal * 0.5)).otherwise(signal)
    return F.when(query.rlike(TEMPORAL) & year.isNotNull(), F.round(weighed, 3)).otherwise(0.0)


def updates_signal(query: Column, incoming: Column, outgoing: Column) -> Column:
    """Edges that say a document updates another, five of each kind at most."""
    score = 0.35 * F.least(F.lit(5), F.coalesce(incoming, F.lit(0))) - 0.15 * F.least(F.lit(5), F.coalesce(outgoing, F.lit(0)))
    return F.when(query.rlike(VERSION) | query.rlike(TEMPORAL), F.round(score, 3)).otherwise(0.0)


def web_update_bonus(query: Column, source_type: Column, *texts: Column) -> Column:
    text = _joined(*texts)
    hits = F.size(F.filter(F.array(*map(F.lit, UPDATE_WORDS)), lambda w: F.contains(text, w)))
    return F.when((F.lower(F.coalesce(source_type, F.lit(""))) == "web") & query.rlike(TEMPORAL), F.least(F.lit(1.1), 0.35 * hits)).otherwise(0.0)


def is_archive_page(item: dict[str, Column]) -> Column:
    text = _joined(item["summary"], item["excerpt"], item["thesis"], item["header"])
    listing = F.contains(F.coalesce(item["source_ref"], F.lit("")), F.lit("arxiv.org/abs/")) | F.trim(F.coalesce(F.nullif(item["document_title"], F.lit("")), item["title"], F.lit(""))).rlike(r"^\[\d{4}\.\d{4,5}\]")
    marks = F.size(F.filter(F.array(*map(F.lit, ARCHIVE_WORDS)), lambda w: F.contains(text, w))) >= 2
    return (F.lower(F.coalesce(item["source_type"], F.lit(""))) == "web") & (listing | marks)


def _titles(item: dict[str, Column]) -> tuple[Column, Column]:
    return F.coalesce(F.nullif(item["document_title"], F.lit("")), item["title"]), item["title"]


def archive_penalty(query: Column, titled: Column, archive: Column) -> Column:
    soft = query.rlike(TEMPORAL) | query.rlike(VERSION)
    return F.when(archive & ~titled, F.when(soft, 1.2).otherwise(4.8)).otherwise(0.0)


def explainer_bias(query: Column, titled: Column, archive: Column, source_type: Column) -> Column:
    kind = F.lower(F.coalesce(source_type, F.lit("")))
    bias = F.when((kind == "paper") & ~archive, 0.7).when((kind == "web") & archive, -0.45).otherwise(0.0)
    return F.when(query.rlike(EXPLAINER) & ~titled, bias).otherwise(0.0)


def type_signal(query: Column, unit_type: Column) -> Column:
    low, kind, out = F.lower(query), F.lower(F.coalesce(unit_type, F.lit(""))), F.when(F.lit(False), 0.0)
    for wanted, hints in KINDS_ASKED.items():
        out = out.when(_any(low, hints), F.when(kind == wanted, 2.5).otherwise(-0.2))
    return out.otherwise(F.when(kind.isin("summary", "section"), 0.6).otherwise(0.0))


def placeholder_penalty(query: Column, item: dict[str, Column]) -> Column:
    text = _joined(item["title"], item["summary"], item["excerpt"], item["thesis"])
    penalty = (
        F.when(_any(text, PENDING_WORDS), 2.25).otherwise(0.0) + F.when(F.contains(text, F.lit(TRANSLATION_WORD)), 0.75).otherwise(0.0)
        + F.when(_any(text, NO_SUMMARY_WORDS), 2.5).otherwise(0.0) + F.when(F.trim(F.coalesce(item["title"], F.lit(""))) == METADATA_TITLE, 1.25).otherwise(0.0)
    )
    return F.when(_any(F.lower(query), METADATA_ASKED), 0.0).otherwise(penalty)


def metadata_penalty(query: Column, item: dict[str, Column]) -> Column:
    title, path = F.lower(F.trim(F.coalesce(item["title"], F.lit("")))), F.lower(F.coalesce(item["section_path"], F.lit("")))
    penalty = F.when(title.isin(METADATA_TITLE, "metadata") | path.endswith(METADATA_TITLE), 2.0).otherwise(0.0)
    penalty = penalty + F.when(_any(F.lower(F.coalesce(item["excerpt"], F.lit(""))), PENDING_WORDS), 1.5).otherwise(0.0)
    return F.when(_any(F.lower(query), METADATA_ASKED), 0.0).otherwise(penalty)


def appendix_penalty(query: Column, item: dict[str, Column]) -> Column:
    title = F.lower(F.trim(F.coalesce(item["title"], F.lit(""))))
    text = _joined(title, item["section_path"], F.substring(F.lower(F.coalesce(item["excerpt"], F.lit(""))), 1, 160))
    titled = F.exists(F.array(*map(F.lit, APPENDIX_TITLES)), lambda w: F.startswith(title, w))
    paper = F.lower(F.trim(F.coalesce(item["source_type"], F.lit("")))) == "paper"
    return F.when(paper & ~_any(F.lower(query), APPENDIX_ASKED) & _any(text, APPENDIX_WORDS), F.when(titled, 6.0).otherwise(4.5)).otherwise(0.0)


def _path(section_path: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(section_path, F.lit("")), " > "), lambda p: F.trim(p)), lambda p: p != "")


def path_depth(section_path: Column) -> Column:
    return F.size(_path(section_path))


def parent_path(section_path: Column) -> Column:
    """A section's path without its last part; sections without a parent have one parent, the empty path."""
    path = _path(section_path)
    return F.when(F.size(path) > 1, F.array_join(F.slice(path, F.lit(1), F.size(path) - 1), " > ")).otherwise("")


def _metadata(item: dict[str, Column]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(item[c], F.lit("")) for c in ("source_ref", "heading_path", "tags", "links")])


def _fields(rows: DataFrame, prefix: str = "") -> dict[str, Column]:
    have = {c.lower() for c in rows.columns}
    return {c: F.col(prefix + c) if prefix + c in have else F.lit(None).cast("string") for c in TEXT_FIELDS}


def _judged(rows: DataFrame, item: dict[str, Column], titles: tuple[Column, Column]) -> DataFrame:
    """rows (query, ...) with what several signals read: _asked, _hits, _titled and _archive, each worked out once."""
    hits, asked = title_words(F.col("query"), *titles)
    rows = rows.withColumns({"_asked": asked, "_hits": hits, "_archive": is_archive_page(item)})
    return rows.withColumn("_titled", asks_for_title(F.col("query"), F.col("_hits"), F.col("_asked")))


def document_signals(item: dict[str, Column], year_now: int) -> dict[str, Column]:
    """The parts of a document's score by its summary, penalties negative, over judged rows."""
    query, terms, metadata, titled = F.col("query"), F.col("terms"), _metadata(item), F.col("_titled")
    fields = [item[c] for c in ("document_title", "title", "source_ref", "summary", "header", "thesis", "search_text", "document_date", "event_date", "observed_at")]
    return {
        "summary_match": text_overlap(terms, *fields, metadata),
        "title_match": title_match(F.col("_hits"), F.col("_asked")),
        "source_boost": source_boost(titled, item["source_type"]),
        "explainer_bias": explainer_bias(query, titled, F.col("_archive"), item["source_type"]),
        "time_relevance": temporal_signal(query, item, year_now),
        "web_update_bonus": web_update_bonus(query, item["source_type"], item["document_title"], item["title"], item["source_ref"], item["heading_path"]),
        "update_boost": updates_signal(query, F.col("incoming"), F.col("outgoing")),
        "metadata_match": 0.45 * text_overlap(terms, metadata),
        "confidence_part": 0.5 * F.coalesce("confidence", F.lit(0.0)),
        "placeholder_penalty": -placeholder_penalty(query, item),
        "archive_penalty": -archive_penalty(query, titled, F.col("_archive")),
        "generic_penalty": -generic_title_penalty(titled, item["source_type"], _titles(item)[0]),
    }


def unit_signals(unit: dict[str, Column], document: dict[str, Column]) -> dict[str, Column]:
    """The parts of a unit's score over judged rows; `document` has the fields of its document's summary."""
    query, terms, metadata, titled = F.col("query"), F.col("terms"), _metadata(unit), F.col("_titled")
    fields = [unit[c] for c in ("title", "section_path", "summary", "excerpt", "header", "search_text")]
    return {
        "query_match": text_overlap(terms, *fields, metadata),
        "unit_title_match": title_match(F.col("_hits"), F.col("_asked")),
        "unit_source_boost": source_boost(titled, unit["source_type"]),
        "unit_explainer_bias": explainer_bias(query, titled, F.col("_archive"), unit["source_type"]),
        "unit_web_bonus": web_update_bonus(query, unit["source_type"], unit["document_title"], unit["title"], unit["source_ref"], unit["section_path"]),
        "unit_summary_match": 0.35 * text_overlap(terms, document["summary"], document["thesis"], _metadata(document)),
        "unit_metadata_match": 0.35 * text_overlap(terms, metadata),
        "unit_confidence": 0.75 * F.coalesce("confidence", F.lit(0.0)),
        "type_signal": type_signal(query, unit["unit_type"]),
        "depth_penalty": -0.12 * F.greatest(F.lit(0), path_depth(unit["section_path"]) - 1),
        "metadata_penalty": -metadata_penalty(query, unit),
        "appendix_penalty": -appendix_penalty(query, unit),
        "unit_archive_penalty": -archive_penalty(query, titled, F.col("_archive")),
    }


def with_neighbours(units: DataFrame) -> DataFrame:
    """units with the structs `before` and `after`: the units beside each in its document, where they have one parent
    section with it, else null."""
    unit = F.struct("order_index", "unit_id", F.coalesce("excerpt", F.lit("")).alias("excerpt"), parent_path(F.col("section_path")).alias("parent"))
    beside = Window.partitionBy("document_id").orderBy("order_index", "unit_id")
    rows = units.withColumns({"before": F.lag(unit).over(beside), "after": F.lead(unit).over(beside)})
    own = parent_path(F.col("section_path"))
    return rows.withColumns({c: F.when(F.col(c)["parent"] == own, F.col(c)) for c in ("before", "after")})


def search(queries: DataFrame, documents: DataFrame, units: DataFrame, limit: int = 10, year_now: int = 2026) -> DataFrame:
    """The `limit` best documents of each query, with the best unit of each, the passage around it, and the best four:
    `passages` of what `find` finds."""
    return passages(find(queries, documents, limit, year_now), units)


def find(queries: DataFrame, documents: DataFrame, limit: int = 10, year_now: int = 2026) -> DataFrame:
    """The `limit` best documents of each query by their summaries, with all signals and the fields that units are judged
    by.

    queries: (query_id, query), and `not_document` where a document must not answer. documents: document_id, confidence,
    incoming, outgoing, and any of TEXT_FIELDS, of which document_title, title, summary and search_text are searched for
    a query's terms. Documents that share no whole term with a query are not scored. Ties go to the higher confidence,
    then the smaller id.

    Queries meet documents by term: neither side is sent as a whole."""
    asked = queries.where("query_id is not null").withColumn("terms", query_terms(F.col("query")))
    wanted = asked.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    item = _fields(documents)
    searched = _joined(*(item[c] for c in ("document_title", "title", "summary", "search_text")))
    held = documents.select("document_id", F.explode(F.array_distinct(query_terms(searched))).alias("term"))
    met = held.join(wanted, "term").select("query_id", "document_id").distinct().join(asked, "query_id")
    if "not_document" in queries.columns:
        met = met.where(~F.col("document_id").eqNullSafe(F.col("not_document"))).drop("not_document")
    parts = document_signals(item, year_now)
    scored = _judged(met.join(documents, "document_id"), item, _titles(item)).withColumns(parts).withColumn("doc_score", F.round(sum((F.col(c) for c in parts), F.lit(0.0)), 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("doc_score"), F.desc(F.coalesce("confidence", F.lit(0.0))), "document_id")
    found = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return found.select("query_id", "query", "terms", "rank", "document_id", "doc_score", *parts, *(item[c].alias(f"of_{c}") for c in ("summary", "thesis", "source_ref", "heading_path", "tags", "links")))


def passages(found: DataFrame, units: DataFrame) -> DataFrame:
    """What `find` found, with the best unit of each document, the passage around it, and the best four.

    units: document_id, unit_id, order_index, confidence and any of TEXT_FIELDS; those of other documents are not
    scored. Ties go to the higher confidence, then the earlier unit. A document without units has nulls for them."""
    parts = found.columns[found.columns.index("doc_score") + 1 : found.columns.index("of_summary")]
    beside = with_neighbours(units.join(found.select("document_id").distinct(), "document_id", "left_semi"))
    rows = found.select("query_id", "query", "terms", "document_id", *[c for c in found.columns if c.startswith("of_")]).join(beside, "document_id")
    unit = _fields(beside)
    parts_u = unit_signals(unit, _fields(rows, "of_"))
    rows = _judged(rows, unit, (unit["document_title"], unit["title"])).withColumns(parts_u).withColumn("unit_score", F.round(sum((F.col(c) for c in parts_u), F.lit(0.0)), 6))
    place = Window.partitionBy("query_id", "document_id").orderBy(F.desc("unit_score"), F.desc(F.coalesce("confidence", F.lit(0.0))), "order_index")
    few = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= RELATED)
    first = F.when(F.col("place") == 1, F.struct("unit_id", "order_index", "unit_score", *parts_u, "before", "after", F.coalesce("excerpt", F.lit("")).alias("excerpt")))
    related = F.transform(F.array_sort(F.collect_list(F.struct("place", "unit_id"))), lambda x: x["unit_id"])
    shown = few.groupBy("query_id", "document_id").agg(F.first(first, ignorenulls=True).alias("unit"), related.alias("related"))
    out = found.join(shown, ["query_id", "document_id"], "left")
    unit = F.col("unit")
    passage = F.filter(F.transform(F.array(unit["before"]["excerpt"], unit["excerpt"], unit["after"]["excerpt"]), lambda p: F.trim(p)), lambda t: t != "")
    return out.select(
        "query_id", "rank", "document_id", "doc_score", *parts, unit["unit_id"].alias("unit_id"), unit["unit_score"].alias("unit_score"), *(unit[c].alias(c) for c in parts_u),
        F.coalesce(unit["before"]["order_index"], unit["order_index"]).alias("segment_start"), F.coalesce(unit["after"]["order_index"], unit["order_index"]).alias("segment_end"),
        F.when(unit.isNotNull(), F.array_join(passage, "\n\n")).alias("segment"), "related",
    )
