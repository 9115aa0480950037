"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length. A first pass over the longest gives each query a score that its k-th result reaches
at least; divided by both lengths it is the cosine that a candidate of a bucket needs. Where that cosine is high,
candidates are pruned by the range that single coordinates must fall in; where it is low, by length alone. What is
left is verified by its product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

K = 20
#: Candidates and queries in a block; local cosine from which coordinates prune; coordinates that are tried.
BLOCK, QUERY_BLOCK, COORDINATE_COSINE, FOCUS = 8192, 2048, 0.7, 4
#: Buckets of length, whatever the number of rows, and tasks that the names of blocks are matched in.
LEAST_BUCKETS, MOST_BUCKETS, LANES = 8, 256, 64
_EXACT = 2.0**52  # products below this are exact in double precision


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


_NO_KEY = (1 << 63) - 1
_BLOCK = "dim int, bucket int, block int, longest double, row binary, id binary, x binary, width int"


def _pack(key, table):
    column = table["vector"].combine_chunks()
    x = column.flatten().to_numpy().reshape(len(column), -1)
    kind = np.int32 if np.abs(x).max() < 1 << 30 else np.int64
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-norm, kind="stable")
    one = lambda a, t: pa.array([a[order].astype(t).tobytes()], pa.binary())
    numbers = [pa.array([k.as_py()], pa.int32()) for k in key]
    return pa.table({
        "dim": numbers[0], "bucket": numbers[1], "block": numbers[2], "longest": pa.array([float(norm.max())]),
        "row": one(table["row"].to_numpy(), np.int64), "id": one(table["id"].to_numpy(), np.int64), "x": one(x, kind), "width": pa.array([np.dtype(kind).itemsize], pa.int32()),
    })


def _unpack(row: dict) -> dict:
    rows = np.frombuffer(row["row"], np.int64)
    x = np.frombuffer(row["x"], np.int32 if row["width"] == 4 else np.int64).reshape(len(rows), -1)
    wide = x.astype(np.float64)
    return {"row": rows, "id": np.frombuffer(row["id"], np.int64), "x": x, "wide": wide, "norm": np.sqrt((wide**2).sum(axis=1))}


def _products(q: dict, at: np.ndarray, c: dict, rows) -> np.ndarray:
    if q["norm"].max(initial=0) * c["norm"].max(initial=0) < _EXACT:
        return (q["wide"][at] @ c["wide"][rows].T).astype(np.int64)
    if q["norm"].max(initial=0) * c["norm"].max(initial=0) < 1 << 62:
        return q["x"][at].astype(np.int64) @ c["x"][rows].astype(np.int64).T
    exact = q["x"][at].astype(object) @ c["x"][rows].astype(object).T  # whole numbers of any size
    exact[q["row"][at][:, None] == c["row"][rows]] = 0  # a row's product with itself is no result
    if exact.size and max(exact.max(), -exact.min()) >= 1 << 63:
        raise OverflowError("a product of two vectors does not fit in 64 bits")
    return exact.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    some = np.arange(len(scores))
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def search(q: dict, least: np.ndarray, c: dict, k: int):
    """For each query of a block its best candidates in a block: yields (query position, candidate positions,
    scores). least: scores that results must reach."""
    longest = c["norm"].max(initial=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(np.isfinite(least), least / (q["norm"] * longest), -np.inf)
    cosine = np.where((q["norm"] * longest == 0) & np.isfinite(least), np.where(least > 0, np.inf, -np.inf), cosine)
    alive = np.flatnonzero(cosine <= 1 + 1e-9)
    by_coordinate = alive[cosine[alive] >= COORDINATE_COSINE]
    by_length = alive[cosine[alive] < COORDINATE_COSINE]
    if len(by_coordinate):
        unit = c["wide"] / np.maximum(c["norm"], 1e-300)[:, None]
        order = np.argsort(unit, axis=0, kind="stable")
        ranked = np.take_along_axis(unit, order, axis=0)
        for i in by_coordinate:
            u, t = q["wide"][i] / q["norm"][i], min(1.0, cosine[i])
            found = None
            for f in np.argsort(-np.abs(u))[:FOCUS]:
                reach = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f]))) + 1e-9
                # a unit vector at cosine t or more with u; beyond the pole of u the bound is that pole
                low = -1.0 if -u[f] >= t else u[f] * t - reach
                high = 1.0 if u[f] >= t else u[f] * t + reach
                a, b = np.searchsorted(ranked[:, f], (low - 1e-9, high + 1e-9))
                if found is None or b - a < len(found):
                    found = order[a:b, f]
            yield from _verify(q, np.array([i]), c, found, least, k)
    if len(by_length):
        # candidates are in order of falling length: a query needs those of which the length can still suffice
        need = np.where((least[by_length] > 0) & np.isfinite(least[by_length]), least[by_length] / np.maximum(q["norm"][by_length], 1e-300), 0.0)
        upto = np.searchsorted(-c["norm"], -(need * (1 - 1e-12)), side="right")
        for at in range(0, len(by_length), 256):
            yield from _verify(q, by_length[at : at + 256], c, np.arange(upto[at : at + 256].max(initial=0)), least, k)


def _verify(q: dict, at: np.ndarray, c: dict, rows: np.ndarray, least: np.ndarray, k: int):
    if len(rows):
        scores = _products(q, at, c, rows)
        for i, mine in zip(at, scores):
            ok = np.flatnonzero((mine >= least[i]) & (c["row"][rows] != q["row"][i]))
            if len(ok):
                top = ok[_best(mine[ok], c["id"][rows[ok]], k)]
                yield i, rows[top], mine[top]


def _results(k: int):
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                q, c = _unpack(row["q"]), _unpack(row["c"])
                least = np.full(len(q["row"]), -np.inf)
                if row["least"] is not None:
                    known = dict(zip(row["least_row"], row["least"]))
                    least = np.array([known.get(int(r), -np.inf) for r in q["row"]], dtype=np.float64)
                out = [(q["row"][i], q["id"][i], c["row"][j], c["id"][j], s) for i, js, ss in search(q, least, c, k) for j, s in zip(js, ss)]
                columns = zip(*out) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in columns], names=["q_row", "query_id", "c_row", "vec_id", "score"])

    return run


_FOUND = "q_row long, query_id long, c_row long, vec_id long, score long"


def top_k(rows: DataFrame, key: str, vector: str, is_query: Column, scratch: Scratch, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of each query row's k highest integer products with all other rows.

    vector: array<long>. Rows with null or unusable vectors take no part; vectors of unlike dimension are not
    compared; empty vectors take no part; a row is never its own result, but rows that repeat a key can be results of one another. Products are
    exact, and one that does not fit in 64 bits fails the job. Ties go to the smaller key, a null key last (the largest
    64-bit key stands for it), then the earlier row. Columns besides the two are not read, whatever their names; an empty
    table gives an empty one."""
    good = rows.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    good = scratch.keep(good.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("vector"), "norm": norm}), "rows")
    n = good.count()
    wanted = min(MOST_BUCKETS, max(LEAST_BUCKETS, n // BLOCK))
    cuts = sorted(set(good.approxQuantile("norm", [i / wanted for i in range(1, wanted)], 0.001)))
    longer = F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), lambda cut: cut >= F.col("norm"))
    dealt = good.withColumn("bucket", F.size(longer))  # 0 holds the longest
    sizes = dealt.groupBy("dim", "bucket").agg(F.count("*").alias("n"))
    split = lambda df, of: df.join(sizes, ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / of)).cast("int"))
    blocks = scratch.keep(split(dealt, BLOCK).select("dim", "bucket", "block", "row", "id", "vector").groupBy("dim", "bucket", "block").applyInArrow(_pack, _BLOCK), "blocks")
    asking = dealt.where("asks").withColumn("bucket", F.lit(-1))
    sizes = asking.groupBy("dim", "bucket").agg(F.count("*").alias("n"))
    placed = scratch.keep(split(asking, QUERY_BLOCK).select("dim", "bucket", "block", "row", "id", "vector", "norm"), "asking")
    queries = scratch.keep(placed.drop("norm").groupBy("dim", "bucket", "block").applyInArrow(_pack, _BLOCK), "queries")
    c = blocks.select("dim", "bucket", F.col("block").alias("c_block"), F.struct("*").alias("c"))
    q = queries.select("dim", F.col("block").alias("q_block"), F.struct("*").alias("q"))
    # query blocks meet candidates' blocks by dimension, which may be one value: each is dealt to a lane, which has all of the other side's names
    lanes = F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))
    lane = F.pmod(F.xxhash64("q_block"), F.lit(LANES)).cast("int").alias("lane")

    # first pass: every query block against the block with the longest candidates
    longest = blocks.groupBy("dim").agg(F.max_by(F.struct("bucket", F.col("block").alias("c_block")), F.struct("longest", -F.col("bucket"), -F.col("block"))).alias("b"))
    firsts = c.join(longest.select("dim", "b.*"), ["dim", "bucket", "c_block"]).select("dim", lanes.alias("lane"), "c")
    none = [F.lit(None).cast("array<long>").alias("least_row"), F.lit(None).cast("array<long>").alias("least")]
    seen = scratch.keep(q.select("*", lane).join(firsts, ["dim", "lane"]).select("q", "c", *none).mapInArrow(_results(k), _FOUND), "first")
    least = seen.groupBy("q_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    bounds = placed.select("dim", F.col("block").alias("q_block"), "row", "norm").join(least, F.col("row") == F.col("q_row"), "left")
    need = F.min(F.when(F.col("least").isNotNull() & (F.col("norm") > 0), F.col("least") / F.col("norm")).otherwise(float("-inf")))
    bounds = scratch.keep(bounds.groupBy("dim", "q_block").agg(need.alias("need"), F.collect_list(F.when(F.col("least").isNotNull(), F.struct("row", "least"))).alias("l")), "bounds")

    # second pass: the stated queries, in blocks, against the blocks whose longest candidate can still suffice
    names = blocks.select("dim", "bucket", F.col("block").alias("c_block"), "longest", lanes.alias("lane"))
    meet = bounds.select("dim", "q_block", "need", lane).join(names, ["dim", "lane"]).where(F.col("longest") * (1 + 1e-9) >= F.col("need"))
    asked = q.join(bounds, ["dim", "q_block"]).select("dim", "q_block", "q", F.col("l.row").alias("least_row"), F.col("l.least").alias("least"))
    pairs = meet.select("dim", "q_block", "bucket", "c_block").join(asked, ["dim", "q_block"]).join(c, ["dim", "bucket", "c_block"])
    pairs = pairs.repartition("dim", "q_block", "bucket", "c_block").select("q", "c", "least_row", "least")
    found = pairs.mapInArrow(_results(k), _FOUND)
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "c_row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.nullif("query_id", F.lit(_NO_KEY)).alias("query_id"), F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(_NO_KEY)).alias("vec_id"), "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`top_k` over all embeddings; its docstring states nulls, ties, repeated rows and empty tables. Components whose 64th
    parts do not fit in 64 bits fail the job where a product with them does."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding")))
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)).alias("vector"))
    return top_k(whole, "vec_id", "vector", F.col("vec_id") % 20 == 0, Scratch(spark, "topk"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
