"""Toxicity: a lexicon trie intersected with Levenshtein automata, and context windows that tell quotation from abuse.

The lexicon is learnt from labelled texts: whole words, and stems that take any ending. Each word of a text is run as
a bit-parallel Levenshtein automaton along the trie's branches. Hits are weighed by whether their window shows that
they are quoted or reported, and a small logistic model turns a text's hits into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .training import fold, labelled_sample

#: Labelled documents that training may read.
MOST_TRAINING_ROWS = 10_000
STEMS = range(3, 9)  # lengths of stems that are tried
LEAST_GAIN = 24.0  # log-likelihood ratio that a term needs
LEAST_ODDS = 2.0  # log odds that a term needs
FUZZY_WORD, FUZZY_STEM = 5, 6  # lengths from which one edit is allowed
WINDOW = 6  # words on each side
REMEMBERED_WORDS = 400_000
WORD = re.compile(r"[^\W_]+(?:[@$!*0-9][^\W_]+)*")
#: Words that report speech, and quotation marks.
REPORTING = frozenset("said says say told called calls quote quoted quotes quoting term word slur wrote writes dijo dice palabra dit mot appelé sagte sagt wort nannte zitat".split())
QUOTES = "\"“”„«»‹›`"


class Lexicon:
    """terms: (text, is_stem, weight)."""

    def __init__(self, terms):
        self.root: dict = {}
        self.weights = [w for _, _, w in terms]
        self.heads: dict[int, set] = {}
        self.tails: dict[int, set] = {}
        self.inner: dict[int, dict[int, set]] = {}
        for k, (text, stem, _) in enumerate(terms):
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((k, stem, len(text) >= (FUZZY_STEM if stem else FUZZY_WORD)))
            half = len(text) // 2 if len(text) >= FUZZY_WORD else len(text)
            self.heads.setdefault(half, set()).add(text[:half])
            if half < len(text):
                if stem:
                    for at in (half - 1, half, half + 1):
                        self.inner.setdefault(at, {}).setdefault(len(text) - half, set()).add(text[half:])
                else:
                    self.tails.setdefault(len(text) - half, set()).add(text[half:])
        self.seen: dict[str, tuple | None] = {}

    def may_match(self, word: str) -> bool:
        """One edit leaves one half of a term whole, at the start or the end of the word, or next to a stem's place."""
        for n, these in self.heads.items():
            if word[:n] in these:
                return True
        for n, these in self.tails.items():
            if word[-n:] in these:
                return True
        for at, by in self.inner.items():
            for n, these in by.items():
                if word[at : at + n] in these:
                    return True
        return False

    def match(self, word: str) -> tuple | None:
        """(weight, edits) of the heaviest term within reach, unedited ones first."""
        mask: dict[str, int] = {}
        for at, c in enumerate(word):
            mask[c] = mask.get(c, 0) | 1 << at
        end, best = 1 << len(word), None
        todo = [(self.root, 1, 2 if word else 0)]
        limit = (end << 1) - 1
        while todo:
            node, exact, near = todo.pop()
            for k, stem, fuzzy in node.get("", ()):
                edits = 0 if (exact if stem else exact & end) else 1 if fuzzy and (near if stem else near & end) else None
                if edits is not None:
                    got = (self.weights[k], edits)
                    if best is None or (got[1], -got[0]) < (best[1], -best[0]):
                        best = got
            for c, child in node.items():
                if c:
                    m = mask.get(c, 0)
                    e = (exact & m) << 1
                    n = ((near & m) << 1 | exact << 1 | exact | e << 1) & limit
                    if e or n:
                        todo.append((child, e, n))
        return best

    def hits(self, words: list[str]) -> dict:
        """The words of a text that match, with their matches."""
        seen = self.seen
        if len(seen) > REMEMBERED_WORDS:
            seen.clear()
        own = set(words)
        for w in own.difference(seen):
            seen[w] = self.match(w) if self.may_match(w) else None
        return {w: m for w in own if (m := seen[w]) is not None}


def quoted(text: str, start: int, end: int, before: list[str], after: list[str]) -> bool:
    """Whether a hit stands in quotation marks or next to a reporting word within its window."""
    left, right = text[max(0, start - 60) : start], text[end : end + 60]
    inside = any(q in left for q in QUOTES) and any(q in right for q in QUOTES) and sum(left.count(q) for q in QUOTES) % 2 == 1
    return inside or any(w in REPORTING for w in before) or any(w in REPORTING for w in after)


N_FEATURES = 6


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Logs of the weight of hits by spelling and context, and their share of the words."""
    low = text.lower()
    words = WORD.findall(low)
    hits = lexicon.hits(words)
    if not hits:
        return [0.0] * N_FEATURES
    spans = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
    sums = [0.0, 0.0, 0.0, 0.0]
    n = 0
    for k, (w, start, end) in enumerate(spans):
        if w in hits:
            weight, edits = hits[w]
            near = lambda part: [x[0] for x in part]
            q = quoted(low, start, end, near(spans[max(0, k - WINDOW) : k]), near(spans[k + 1 : k + 1 + WINDOW]))
            sums[2 * (edits > 0) + q] += weight
            n += not q
    return [*map(math.log1p, sums), math.log1p(1000 * n / len(spans)), float(sums[0] > 0)]


def _gain(a: Column, b: Column, pos: int, neg: int) -> Column:
    """Log-likelihood ratio of a term in a of pos and b of neg texts."""
    total, out = pos + neg, F.lit(0.0)
    for seen, of, share in ((a, a + b, pos), (b, a + b, neg), (pos - a, total - a - b, pos), (neg - b, total - a - b, neg)):
        out += F.when(seen > 0, seen * F.log(seen * total / (of * share))).otherwise(0.0)
    return 2 * out


def learn_lexicon(sample: DataFrame, counts: dict, scratch: Scratch) -> list[tuple[str, bool, float]]:
    """Terms that mark toxic texts in a bounded sample (text, label). A term counts once for each different word of a
    text that it covers, so a stem with many endings shows early. Candidates are counted where the texts are and summed
    by a shuffle; only those that pass the thresholds reach the driver."""
    if not counts.get(1) or not counts.get(0):
        return []

    def candidates(batches):
        seen = {0: Counter(), 1: Counter()}
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"]):
                words, tally = set(WORD.findall(text.lower())), seen[int(label)]
                tally[""] += len(words)
                tally.update(w + "$" for w in words)
                for n in STEMS:
                    tally.update(w[:n] for w in words if len(w) >= n)
        terms = [*set(seen[0]) | set(seen[1])]
        for k in range(0, len(terms), 50_000):
            some = terms[k : k + 50_000]
            yield pd.DataFrame({"term": some, "a": [seen[1][t] for t in some], "b": [seen[0][t] for t in some]})

    both = sample.mapInPandas(candidates, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    both = scratch.keep(both, "terms")
    pos, neg = (both.where("term = ''").select("a", "b").first() or (0, 0))
    if not pos or not neg:
        return []
    odds = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("b") + 0.5) / (neg + 1))
    scored = both.where("a >= 3 and term <> ''").select("term", F.round(_gain(F.col("a"), F.col("b"), pos, neg), 9).alias("gain"), odds.alias("odds"))
    rows = scored.where((F.col("odds") > LEAST_ODDS) & (F.col("gain") >= LEAST_GAIN)).collect()  # few: each term has a gain that a bounded sample's texts share out
    rows = sorted((-r["gain"], not r["term"].endswith("$"), -len(r["term"]), r["term"], r["odds"]) for r in rows)
    chosen: list[tuple[str, bool, float]] = []
    for _, stem, _, term, weight in rows:
        text = term.rstrip("$")
        if not any(text.startswith(t) or t.startswith(text) for t, _, _ in chosen):
            chosen.append((text, bool(stem), float(weight)))
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is last and free."""
    x = np.column_stack((x, np.ones(len(x))))
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.05)
    ridge[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


class ToxicityModel:
    """A lexicon and the weights of its features; both are small whatever the corpus."""

    def __init__(self, terms: list, weights: list[float]):
        self.terms, self.weights = terms, weights

    def score(self, spark: SparkSession, text: Column) -> Column:
        sent = spark.sparkContext.broadcast((self.terms, self.weights))
        held: list = []

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            if not held:
                held.append(Lexicon(sent.value[0]))
            w = sent.value[1]
            rows = (features(text.as_py() or "", held[0]) for text in texts)
            return pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, w[-1] + sum(a * b for a, b in zip(row, w)))))) for row in rows], pa.float64())

        return scored(text)


def fit(sample: DataFrame, scratch: Scratch) -> ToxicityModel:
    """Learns from a bounded, kept sample (text, label). Without any toxic or any other text, every score is the smoothed
    share of toxic texts."""
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    terms = learn_lexicon(sample, counts, scratch)
    bias = math.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)) if counts else math.log(0.1)
    if not terms:
        return ToxicityModel([], [0.0] * N_FEATURES + [bias])

    def made(batches):
        lexicon = Lexicon(terms)
        for pdf in batches:
            yield pd.DataFrame({"x": [features(t, lexicon) for t in pdf["text"]], "label": pdf["label"].astype("int32")})

    rows = sample.mapInPandas(made, "x array<double>, label int").collect()  # at most MOST_TRAINING_ROWS short rows
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)
    at = np.lexsort((y, *x.T))
    return ToxicityModel(terms, _logistic(x[at], y[at]).tolist())


def model_for(spark: SparkSession, sf_dir: str) -> ToxicityModel:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scratch = Scratch(spark, "toxicity")
    return fit(labelled_sample(docs, labels, "toxic", 4, 2, MOST_TRAINING_ROWS, scratch), scratch)


THRESHOLD = 0.3


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """documents less those that score THRESHOLD or more. Null and empty texts have no hits and stay unless the model
    is of a corpus most of which is toxic; very long texts are scored whole; rows are judged one by one, so repeated
    rows go or stay together; no column is added, so that names cannot clash; an empty table gives an empty one."""
    return docs.where(model.score(docs.sparkSession, F.col("text")) < THRESHOLD)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted. Null and empty texts get the score of a text without hits; very long texts
    are scored whole; repeated rows are scored alike, and rows that share an id are held out together; a null doc_id is
    scored and not held out. Without documents no row is returned, without labels every score is the same."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held, model_for(spark, sf_dir).score(spark, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
