"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .training import fold, labelled_sample

BITS = 18
#: Labelled documents that training may read.
MOST_TRAINING_ROWS = 10_000
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 4, 0.5, 1.0, 0.02, 0.1, 20.0
REMEMBERED_WORDS = 500_000
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…–—¡¿"


def shape(word: str) -> str:
    """What a word looks like: its leading and trailing marks around its case and whether it has digits."""
    core = word.strip(_MARKS)
    if not core:
        return word[:8]
    at = word.index(core)
    case = "9" if any(map(str.isdigit, core)) else "X" if len(core) > 1 and core.isupper() else "Xx" if core[0].isupper() else "x"
    return f"{word[:at][:4]}{case}{word[at + len(core) :][:4]}"


class Grams:
    """Indices of a text's hashed features: its one- and two-word grams, and those of the words' shapes, where a word
    that repeats the one before has a shape of its own."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def indices(self, text: str) -> np.ndarray:
        words, seen = text.split(), self.seen
        if len(seen) > REMEMBERED_WORDS:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(shape(w).encode("utf-8", "surrogatepass"))
        both = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        surface, looks = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        if len(words) > 1:
            again = np.zeros(len(words), bool)
            again[1:] = both[1:] == both[:-1]
            looks = np.where(again, np.uint64(0x5BD1E995), looks)
        pair = lambda x: x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        pairs = np.concatenate((pair(surface) * np.uint64(0xFF51AFD7ED558CCD), pair(looks)))
        mixed = np.concatenate((surface * np.uint64(0xFF51AFD7ED558CCD), looks * np.uint64(0xC4CEB9FE1A85EC53), pairs ^ (pairs >> np.uint64(29))))
        return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], base: float, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over (indices, values, label); the returned weights have the intercept last."""
    z, n, size = np.zeros(1 << BITS), np.zeros(1 << BITS), 1 << BITS
    bias, bias_n = base, 0.0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            zi, root = z[at], np.sqrt(n[at])
            w = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2), 0.0)
            slope = 1 / (1 + np.exp(-np.clip(bias + w @ x, -30, 30))) - y
            g = slope * x
            z[at] = zi + g - (np.sqrt(n[at] + g * g) - root) / ALPHA * w
            n[at] += g * g
            bias_n += slope * slope
            bias -= 0.1 * slope / np.sqrt(1 + bias_n)
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return np.append(w[:size], bias).astype(np.float32)


def fit(sample: DataFrame) -> bytes:
    """The model of a bounded sample (text, label): features are made where the texts are, one task runs the updates,
    and the driver gets the weights, 1 MB whatever the sample. An empty sample gives a model that scores 0.5."""

    def features(batches):
        grams = Grams()
        for pdf in batches:
            ats, xs = [], []
            for text in pdf["text"]:
                at, count = np.unique(grams.indices(text), return_counts=True)
                ats.append(at.astype(np.int32).tobytes())
                xs.append((count * (SCALE / max(1, count.sum()))).astype(np.float32).tobytes())
            yield pd.DataFrame({"at": ats, "x": xs, "label": pdf["label"].astype("int32")})

    def leader(batches):
        rows = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32).astype(float), int(y)) for pdf in batches for a, x, y in zip(pdf["at"], pdf["x"], pdf["label"])]
        rows.sort(key=lambda r: (zlib.crc32(r[0].tobytes()), zlib.crc32(r[1].tobytes()), r[2]))  # the same model whatever the order of tasks
        good = sum(r[2] for r in rows)
        yield pd.DataFrame({"w": [train(rows, float(np.log((good + 1) / (len(rows) - good + 1)))).tobytes()]})

    made = sample.mapInPandas(features, "at binary, x binary, label int")
    return made.repartition(1).mapInPandas(leader, "w binary").first()["w"]


def score(spark: SparkSession, text: Column, model: bytes) -> Column:
    """Probability of label 1, for null texts as for empty ones: that of the intercept."""
    sent = spark.sparkContext.broadcast(model)
    held: list = []

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        if not held:
            held.extend((Grams(), np.frombuffer(sent.value, np.float32).astype(float)))
        grams, w = held
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            at = grams.indices(text.as_py() or "")
            out[k] = w[-1] + (SCALE * w[at].mean() if len(at) else 0.0)
        return pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return scored(text)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted. Null and empty texts get the intercept's score; very long texts are scored
    whole; repeated rows are scored alike, and rows that share an id are held out together; a null doc_id is scored and
    not held out. Without documents no row is returned, without labels every score is 0.5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(labelled_sample(docs, labels, "quality", 3, 1, MOST_TRAINING_ROWS, Scratch(spark, "quality")))
    scored = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), score(spark, F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
