"""What a query asks for, as column expressions: intent, temporal cue, target year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Intents in the order in which they are tried, with the words that mark them wherever they occur.
COMPARISON = ("compare", "comparison", "vs", "versus", "차이", "비교", "장단점", "tradeoff", "trade-off", "pros", "cons")
PAPER = ("paper", "papers", "논문", "논문들", "논문을", "논문들에", "논문들을")
PAPER_TOPIC = (
    "find", "search", "collect", "curate", "organize", "overview", "survey", "related", "representative", "alternatives", "alternative", "papers about",
    "찾아", "찾아줘", "정리", "정리해줘", "묶어", "모아", "추천", "관련", "대표", "대체", "차세대", "계열",
)
CITATION = ("citation", "citations")
IMPLEMENTATION = ("implement", "implementation", "code", "patch", "fix", "구현", "코드", "수정")
EVALUATION = (
    "evaluate", "evaluation", "benchmark", "metric", "metrics", "score", "scores", "measure", "measurement", "assess", "assessment", "test", "testing",
    "experiment", "experiments", "실험", "평가", "지표",
)
HOWTO = (
    "how to", "how do i", "usage", "use ", "setup", "install", "configure", "tutorial", "guide", "example", "examples", "사용법", "어떻게", "설정", "설치", "방법",
)
DEFINITION = ("what is", "define", "definition", "meaning", "뜻", "무엇", "무슨", "설명")
PAPER_ID = r"\b(?:arxiv|doi)\b|\b\d{4}\.\d{4,5}(?:v\d+)?\b"
#: Words that do not count when a query's words are.
STOP = (
    "the", "and", "for", "with", "that", "this", "from", "into", "were", "have", "has", "are", "was", "which", "their", "when", "then", "there",
    "about", "used", "using", "based", "models", "model", "learn", "learning", "dataset", "datasets", "results", "method", "methods", "paper",
    "research", "analysis", "different", "new", "more", "less", "one", "two", "three", "also", "first", "four", "five", "use", "show", "shown",
    "shows",
)
STOP_KOREAN = (
    "하는", "있는", "있다", "있고", "않고", "없이", "또는", "그리고", "에서", "대한", "에 대한", "같은", "및", "또한", "하지만", "뿐", "수",
    "등", "의", "을", "를", "에", "과", "와", "로", "으로", "으로써", "또", "뿐만", "때문에", "않은", "없는", "이", "그", "그녀", "본",
    "있습니다", "있을", "있으며", "있는지", "있음",
)
#: Temporal cues.
BEFORE = r"(?i)\b(before|prior to|earlier than)\s+(20\d{2})\b|([0-9]{4})\s*이전|([0-9]{4})\s*당시"
AFTER = r"(?i)\b(after|since)\s+(20\d{2})\b|([0-9]{4})\s*이후"
LATEST = r"(?i)\b(latest|recent|updated|update|newest|changed since)\b|최근|최신|업데이트"


def query_words(text: Column) -> Column:
    """Different words of a query that are no stop words: English ones of three letters or more, Korean ones of two."""
    low = F.lower(text)
    english = F.filter(F.regexp_extract_all(low, F.lit("[a-zA-Z][a-zA-Z0-9]+"), 0), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP))
    korean = F.filter(F.regexp_extract_all(low, F.lit("[가-힣]{2,}"), 0), lambda w: ~w.isin(*STOP_KOREAN))
    return F.array_distinct(F.concat(english, korean))


def intent(query: Column) -> Column:
    """The first rule that holds; a query without words asks for a definition, one of few words for a topic."""
    text = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return (
        F.when(text == "", "definition").when(has(COMPARISON), "comparison").when(text.rlike(PAPER_ID), "paper_lookup")
        .when(has(PAPER) & has(PAPER_TOPIC), "paper_topic").when(has(PAPER + CITATION), "paper_lookup").when(has(IMPLEMENTATION), "implementation")
        .when(has(EVALUATION), "evaluation").when(has(HOWTO), "howto").when(has(DEFINITION), "definition")
        .when(F.size(query_words(text)) <= 4, "topic_lookup").otherwise("definition")
    )


def temporal(query: Column) -> tuple[Column, Column]:
    """(mode, target year): before or after a year, latest, or none."""
    text = F.coalesce(query, F.lit(""))
    mode = F.when(text.rlike(BEFORE), "before").when(text.rlike(AFTER), "after").when(text.rlike(LATEST), "latest").otherwise("none")
    year = lambda pattern, groups: F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups], F.lit(""))
    return mode, F.when(mode == "before", year(BEFORE, (2, 3, 4))).when(mode == "after", year(AFTER, (2, 3))).otherwise("")
