"""Interaction audit of five text filters by inclusion and exclusion.

A corpus is reduced once to the joint-failure counts of all 32 intersections of the filters: for each set of filters
the sum, over documents, of the product of their failure flags. Everything else is linear in these counts and worked
out from them alone, whatever the number of documents: survivors of any set by Möbius inversion over its subsets,
failures of one filter alone over its supersets, and Shapley shares from the Harsanyi dividends, which are the counts
with alternating signs.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import mul

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 100, 80, 10
SYMBOLS = r"[#$%&*|]"
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_failures(text: Column) -> Column:
    """The filters A to D that a text fails, as bits 1, 2, 4, 8. Null texts are empty: they fail A alone. The words are
    taken once for both filters that count them."""
    text = F.coalesce(text, F.lit(""))
    sizes = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"))), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different")))[0]

    def bits(s: Column) -> Column:
        fails = (
            s["n"] < LEAST_WORDS,
            100 * s["different"] < LEAST_DISTINCT_PERCENT * s["n"],
            100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS_PERCENT * F.length(text),
            text.rlike(SYMBOLS),
        )
        return reduce(lambda a, b: a + b, (F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)))

    return F.transform(F.array(sizes), bits)[0]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each kind of document: part, fails (bits of A to E), good and toxic (labels), n of them.

    E is failed by rows whose text a smaller doc_id has: all but those of the least id that is not null. Only digests,
    ids and bits are shuffled; equal rows are summed before, and the least id of a text is found by a partial minimum,
    so that a text that a third of all rows share is no large group. Rows that repeat an id are documents of their own,
    and rows of the least id all pass E. Rows without an id have no smaller id, pass E and have no label. Of several
    labels of an id, one with 1 is enough; null labels are 0."""
    seen = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_failures(F.col("text")).alias("fails"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))
    # rows without an id match nothing; a hash of their text stands for it, so that they are dealt out like the others
    named, key = F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.xxhash64("digest")).alias("key")
    rows = seen.groupBy("doc_id", "digest", "part", "fails").agg(F.count("*").alias("n")).select(key, named, "digest", "part", "fails", "n")
    least = seen.groupBy("digest").agg(F.min("doc_id").alias("key")).where("key is not null").select("key", F.lit(True).alias("named"), "digest", F.lit(True).alias("first"))
    marked = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("key"), F.lit(True).alias("named")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = rows.join(least, ["key", "named", "digest"], "left").join(marked, ["key", "named"], "left")
    copy = F.when(F.col("first") | ~F.col("named"), 0).otherwise(1 << FILTERS.index("E"))
    label = (F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))
    return known.select("part", (F.col("fails") + copy).alias("fails"), *label, "n").groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def joint_failures(cells: DataFrame) -> DataFrame:
    """part and, for all documents, good ones and toxic ones, the 32 counts of documents that fail all filters of a
    set, in the order of the sets' bits."""
    flag = [F.col("fails").bitwiseAND(1 << k) / F.lit(1 << k) for k in range(len(FILTERS))]

    def counts(of: Column) -> Column:
        return F.array(*(F.sum(reduce(mul, (flag[k].cast("long") for k in range(len(FILTERS)) if s >> k & 1), of)) for s in range(SETS)))

    n = F.col("n")
    return cells.groupBy("part").agg(counts(n).alias("joint"), counts(F.when(F.col("good"), n).otherwise(0)).alias("joint_good"), counts(F.when(F.col("toxic"), n).otherwise(0)).alias("joint_toxic"))


def _signed(joint: Column, chosen, weight=lambda s: 1) -> Column:
    """Sum over chosen sets of their joint counts, with the sign of the set's size, times a whole weight."""

    def term(s: Column) -> Column:
        size = F.bit_count(s)
        return F.when(chosen(s), F.when(size % 2 == 0, 1).otherwise(-1) * weight(size) * F.element_at(joint, s.cast("int") + 1)).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.lit(SETS - 1)), F.lit(0).cast("long"), lambda total, s: total + term(s).cast("long"))


def interactions(joint: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from joint counts alone."""
    order = joint.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = order.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bits(letters: Column) -> Column:
        return reduce(lambda a, b: a + b, (F.when(F.contains(letters, F.lit(x)), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)))

    name = F.col("filter_order").substr(F.col("step"), F.lit(1))
    steps = steps.select("*", bits(name).alias("own"), bits(F.col("filter_order").substr(F.lit(1), F.col("step") - 1)).alias("before"))
    own, before, after = F.col("own"), F.col("before"), F.col("before") + F.col("own")

    def within(given: Column):
        return lambda s: s.bitwiseAND(given) == s

    def survivors(counts: str, given: Column) -> Column:
        return _signed(F.col(counts), within(given))

    def has_own(s: Column) -> Column:
        return s.bitwiseAND(own) == own

    every = sum(1 for _ in ORDERS)
    kept = steps.select(
        "part", "filter_order", "step", survivors("joint", after).alias("kept"),
        *((survivors(c, before) - survivors(c, after)).alias(name) for c, name in (("joint", "removed"), ("joint_good", "good_lost"), ("joint_toxic", "toxic_lost"))),
        F.element_at("joint", own + 1).alias("fail"),
        (-_signed(F.col("joint"), has_own)).alias("unique_fails"),
        # a set's dividend, its count with the opposite sign, is shared alike by its filters; every / size is whole
        (-_signed(F.col("joint"), has_own, lambda size: F.floor(F.lit(every) / size))).alias("shapley"),
    )
    return kept.select("part", "filter_order", "step", "kept", "removed", (F.col("fail") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters' interactions over documents (doc_id, text, lang) and labels (doc_id, quality, toxic): a row for
    each part (value of lang, null as the empty string), order of the filters and step.

    Null texts are empty; very long texts are read whole; further columns, whatever their names, are not read; an empty
    table gives no rows, and without labels nothing good or toxic is lost."""
    return interactions(joint_failures(failures(docs, labels)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`audit` over all documents and labels; its docstrings state nulls, ties, repeated rows and empty tables."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a JOIN letters b ON b.bit <> a.bit JOIN letters c ON c.bit NOT IN (a.bit, b.bit)
  JOIN letters d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN letters e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce("text", '') AS t, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
least AS (SELECT t, min(doc_id) AS doc_id FROM texts GROUP BY t),
marked AS (SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, coalesce(good, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(x.t, '[^A-Z]', '', 'g')) > 10 * length(x.t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(x.t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN least.doc_id < x.doc_id THEN 16 ELSE 0 END AS mask
  FROM texts x JOIN least ON least.t = x.t LEFT JOIN marked ON marked.doc_id = x.doc_id
),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM docs GROUP BY part, mask),
fates AS (
  SELECT part, filter_order, bits, mask, n, good, toxic,
    CASE WHEN mask & bits[1] > 0 THEN 1 WHEN mask & bits[2] > 0 THEN 2 WHEN mask & bits[3] > 0 THEN 3
      WHEN mask & bits[4] > 0 THEN 4 WHEN mask & bits[5] > 0 THEN 5 ELSE 6 END AS fate
  FROM cells CROSS JOIN orders
),
steps AS (SELECT unnest([1, 2, 3, 4, 5]) AS step),
counted AS (
  SELECT part, filter_order, step, bits[step] AS bit,
    sum(CASE WHEN fate > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN fate = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bits[step] > 0 AND fate < step THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bits[step] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fate = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fate = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM fates CROSS JOIN steps GROUP BY part, filter_order, step, bits[step]
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
