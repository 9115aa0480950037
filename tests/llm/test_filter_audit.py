"""The filter audit against applying the filters one after another, for every order."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quarrymill.llm import filter_audit as A

COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def applied(docs, labels):
    """Rows (doc_id, text, lang) and (doc_id, quality, toxic) to the audit's rows, filter after filter."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": any(c in text for c in "#$%&*|"), "E": i is not None and least[text] < i,
        }
        rows.append((lang or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine, removed = [r[1:] for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for k, name in enumerate(order):
                gone, before = [r for r in left if r[0][name]], len(left)
                left = [r for r in left if not r[0][name]]
                removed[name] += before - len(left)
                fail = sum(r[0][name] for r in mine)
                alone = sum(r[0][name] and sum(r[0].values()) == 1 for r in mine)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), fail - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone), name))
        out += [(*s[:-1], removed[s[-1]]) for s in steps]
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    words = ["one", "Two", "THREE", "f#ur", "five", "Ähre", " ", "漢字"] + [f"w{k}" for k in range(300)]
    texts = [None, "", " \t\n", "ABC", "x\x0b y", "a" * 100_000]
    texts += [" ".join(rng.choices(words[: rng.choice([8, 60, 308])], k=rng.randint(1, 220))) for _ in range(60)]
    docs = [(rng.choice([None, k, k, k // 2]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(400)]
    labels = [(rng.choice([None, k, k // 3]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 400, 2)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_applying_the_filters(spark, seed):
    docs, labels = made(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"part": F.lit("x"), "named": F.lit(1), "good": F.lit(True), "n": F.lit(3)}).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).repartition(2)
    got = A.audit(frame, marks)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == applied(docs, labels)


def test_audit_of_copies_of_one_text(spark):
    docs = [(k, "same text" if k % 3 else f"text {k}", "en") for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in A.audit(frame, marks).collect()) == applied(docs, [])


def test_audit_of_empty_tables(spark):
    docs, labels = made(3)
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert A.audit(frame.where("false"), marks).collect() == []
    assert {(r["good_lost"], r["toxic_lost"]) for r in A.audit(frame, marks.where("false")).collect()} == {(0, 0)}


def test_parts_of_the_inversion_add_up(spark):
    """Shapley shares of a part's filters add up to what all five remove, in every order."""
    docs, labels = made(4)
    rows = A.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    sums = rows.groupBy("part", "filter_order").agg(F.sum("shapley").alias("s"), F.sum("removed").alias("r")).collect()
    assert sums and all(x["s"] == len(A.ORDERS) * x["r"] for x in sums)
