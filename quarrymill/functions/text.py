"""Text, URL and privacy functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tracking parameters (dropped by prefix), signal terms, the words that boilerplate lines begin with.
TRACKING = ("utm_", "fbclid", "gclid", "mc_", "ref", "igshid")
SIGNAL_TERMS = (
    "ai", "artificial intelligence", "machine learning", "deep learning", "neural", "transformer", "llm", "language model", "rag", "retrieval", "embedding",
    "inference", "fine-tuning", "agent", "alignment", "safety",
)
BOILERPLATE = (
    "cookie|privacy policy|all rights reserved", "sign in|log in|subscribe|newsletter", "share this|follow us|back to top", "advertisement|sponsored",
)
#: Kinds of units in the order in which they are tried, with the words that mark them.
UNIT_WORDS = (
    ("summary", "abstract|요약|summary"), ("method", "method|방법|approach"), ("result", "result|결과|finding|evaluation"), ("limitation", "limitation|한계"),
    ("background", "background|배경|introduction|소개"),
)
#: White space as text splitting sees it, spelled so that every regular expression engine agrees; word ends likewise.
SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BOILERPLATE_LINE = "(?i)^(" + "|".join(BOILERPLATE) + r")($|[^\p{L}\p{N}_])"
QUALITY_TOKEN = r"[A-Za-z0-9가-힣][A-Za-z0-9가-힣\-_/]*"
#: Marks of sensitive text.
P0_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("phone_like", r"\b(?:\+?\d{1,3}[-\s]?)?(?:\(?\d{2,4}\)?[-\s]?)\d{3,4}[-\s]?\d{4}\b"),
    ("card_like", r"\b(?:\d[ -]*?){13,19}\b"),
    ("ssn_like", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("secret_keyword", r"(?i)\b(password|passwd|api[_-]?key|access[_-]?token|refresh[_-]?token|secret(?:[_-]?key)?|주민등록번호|계좌번호)\b"),
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, "/" for an empty path and else no trailing slash, no fragment; parameters decoded,
    without blank and tracking ones, sorted and encoded again. A URL without a scheme begins with its host and is taken
    for https; an empty one stays empty."""
    bare = F.regexp_replace(strip(url), "#.*$", "")
    scheme = F.lower(F.coalesce(F.nullif(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("")), F.lit("https")))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: p.rlike("^[^=]*=."))
    plain = lambda x: F.coalesce(F.try_url_decode(x), F.regexp_replace(x, r"\+", " "))
    named = F.transform(pairs, lambda p: F.struct(plain(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), plain(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(named, lambda p: ~F.lower(p["k"]).rlike("^(" + "|".join(TRACKING) + ")")))
    code = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    query = F.array_join(F.transform(kept, lambda p: F.concat(code(p["k"]), F.lit("="), code(p["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(strip(url) == "", "").otherwise(whole)


def clean_text(text: Column) -> Column:
    """Lines with white space collapsed, without very short ones and those that begin like boilerplate, joined by blank
    lines."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.trim(F.regexp_replace(x, f"{SPACE}+", " ")))
    return F.array_join(F.filter(lines, lambda x: (F.length(x) > 2) & ~x.rlike(BOILERPLATE_LINE)), "\n\n")


def tokens(text: Column) -> Column:
    """ASCII letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[0-9a-z]+"), 0)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _quality(n: Column, different: Column, hits: Column, threshold: float, min_tokens: int) -> dict[str, Column]:
    unique = F.when(n > 0, different / n).otherwise(0.0)
    score = F.round(0.35 * F.least(F.lit(1.0), n / 500) + 0.25 * clamp((unique - 0.2) / 0.5) + 0.25 * F.least(F.lit(1.0), hits / 6) + 0.15, 4)
    approved = (n >= min_tokens) & (score >= threshold)
    against = F.array_compact(F.array(F.when(n < min_tokens, "too_short"), F.when(hits == 0, "no_ai_signal"), F.when(unique < 0.28, "low_diversity")))
    reasons = F.when(~approved & (F.size(against) == 0), "low_quality_score").otherwise(F.array_join(against, ","))
    return {"n_tokens": n, "unique_ratio": F.round(unique, 4), "signal_hits": hits, "noise_ratio": F.lit(0.0), "score": score, "approved": approved, "reasons": reasons}


def _signal_hits(low: Column) -> Column:
    return sum((low.contains(t).cast("int") for t in SIGNAL_TERMS), F.lit(0))


def quality_parts(clean: Column, threshold: float = 0.5, min_tokens: int = 40) -> dict[str, Column]:
    """Of a cleaned text: length, variety and signal terms as one score, whether it is approved, and what speaks against
    it. Cleaning leaves no boilerplate line, so the share of noise is 0. Each part cuts the text into words anew."""
    low = F.lower(clean)
    toks = F.regexp_extract_all(low, F.lit(QUALITY_TOKEN), 0)
    return _quality(F.size(toks), F.size(F.array_distinct(toks)), _signal_hits(low), threshold, min_tokens)


def with_quality(rows: DataFrame, clean: str, threshold: float = 0.5, min_tokens: int = 40) -> DataFrame:
    """rows with the parts of quality_parts; what several of them read is a column of its own first, so that each text is
    cut into words once."""
    rows = rows.withColumn("_low", F.lower(clean))
    rows = rows.withColumns({"_toks": F.regexp_extract_all("_low", F.lit(QUALITY_TOKEN), 0), "_hits": _signal_hits(F.col("_low"))})
    rows = rows.withColumns({"_n": F.size("_toks"), "_different": F.size(F.array_distinct("_toks"))})
    parts = _quality(F.col("_n"), F.col("_different"), F.col("_hits"), threshold, min_tokens)
    return rows.withColumns(parts).drop("_low", "_toks", "_hits", "_n", "_different")


def p0(text: Column) -> Column:
    """Whether a text holds personal data or secrets."""
    found = F.lit(False)
    for _, pattern in P0_PATTERNS:
        found = found | text.rlike(pattern)
    return F.coalesce(found, F.lit(False))


def text_level(text: Column) -> Column:
    """P0 sensitive, P1 structured, P2 prose, P3 empty or a bare link."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when(p0(bare), "P0").when((bare == "") | bare.rlike(r"^https?://\S+$"), "P3")
        .when(bare.rlike(r"^[\[{]") | bare.rlike(r"\|.*\|"), "P1").otherwise("P2")
    )


def redact(text: Column) -> Column:
    for _, pattern in P0_PATTERNS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def normal_term(value: Column) -> Column:
    out = F.regexp_replace(F.lower(value), "[_-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9가-힣\s]", ""), r"\s+", " "))


def jaccard(left: Column, right: Column) -> Column:
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)


def freshness(age_days: Column) -> Column:
    """0.25 if undated, else an e-fold every 30 days above a floor."""
    return F.when(age_days.isNull(), 0.25).otherwise(clamp(0.15 + 0.85 * F.exp(-F.greatest(age_days, F.lit(0.0)) / 30)))


def importance(trust: Column, support: Column, degree: Column, density: Column) -> Column:
    return clamp(0.30 * trust + 0.25 * F.least(F.lit(1.0), support / 8) + 0.25 * F.least(F.lit(1.0), degree / 12) + 0.20 * density)


def unit_type(text: Column, title: Column | None = None) -> Column:
    """By the words of a unit's title and first 180 characters; then lists, tables of more than one line, sections."""
    flat = strip(F.regexp_replace(text, f"{SPACE}+", " "))
    head = F.when(F.length(flat) <= 180, flat).otherwise(F.substring(flat, 1, 177))
    key = F.lower(F.concat_ws(" ", title, head) if title is not None else head)
    out = F.when(F.lit(False), "")
    for name, words in UNIT_WORDS:
        out = out.when(key.rlike(words), name)
    return out.when(text.rlike(r"(?m)^\s*[-*]\s+"), "list_block").when(text.contains("|") & text.contains("\n"), "table_block").otherwise("section")


def direction(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("improv|outperform|better|higher"), "better").when(low.rlike("degrad|worse|lower|underperform"), "worse").when(low.rlike("same|no difference|comparable"), "neutral").otherwise("unknown")
