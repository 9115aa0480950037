"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bits that one round over the still oversized buckets may split on, and the bits of the hash.
ROUND_BITS, HASH_BITS = 8, 64
OP2_LIMIT = 1 << 20


def _hash32(key):
    """The first 32 bits of the key's MD5, as a non-negative long; a null key is hashed as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def shard(rows: DataFrame, key: str, n_bytes: str, limit: int, scratch: Scratch) -> DataFrame:
    """Adds to rows: shard (the leaf's prefix bits, empty for one single shard), depth, shard_bytes, shard_rows, in place
    of columns so named.

    A bucket splits on the next bit while it holds more than `limit` bytes and more than one row, so a row larger than
    the limit ends alone. The first 32 bits hash the key; the next 32 hash the key with the row's number in the kept
    table, so that a key repeated over very many rows is split as well; 64 bits tell all rows apart but for chance, and a
    bucket that they do not split stays whole. Rows keep null keys and null sizes (0 bytes, like empty texts); their
    columns travel in one struct, whatever their names. An empty table gives an empty one.
    Each round sums bytes by prefix before it shuffles, and only rows of oversized buckets take part in the next."""
    made = ("shard", "depth", "shard_bytes", "shard_rows")
    shown = [c for c in rows.columns if c not in made]
    rows = rows.select(
        F.struct(*shown).alias("_rest"), F.col(key).cast("string").alias("_key"), F.coalesce(F.col(n_bytes).cast("long"), F.lit(0)).alias("_bytes")
    )
    rows = scratch.keep(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    rows = rows.withColumn("_first", _hash32(F.col("_key"))).withColumn("_next", _hash32(F.concat_ws(":", "_key", "_row")))
    left, done = rows, []
    for base in range(0, HASH_BITS, ROUND_BITS):
        word, used = ("_first", base) if base < 32 else ("_next", base - 32)
        round_bits = F.shiftright(word, 32 - used - ROUND_BITS).bitwiseAND((1 << ROUND_BITS) - 1)
        path = F.lpad(F.bin(round_bits), ROUND_BITS, "0")
        left = left.withColumn("_prefix", path if base == 0 else F.concat("_prefix", path))
        bins = left.groupBy("_prefix").agg(F.sum("_bytes").alias("b"), F.count("*").alias("n"))
        depths = F.sequence(F.lit(base if base == 0 else base + 1), F.lit(base + ROUND_BITS))
        nodes = bins.withColumn("depth", F.explode(depths)).withColumn("shard", F.expr("left(_prefix, depth)"))
        sums = nodes.groupBy("shard", "depth").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        last = base + ROUND_BITS >= HASH_BITS
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") <= 1) | (F.lit(last) & (F.col("depth") == HASH_BITS))
        leaf = (
            nodes.select("_prefix", "shard", "depth").join(sums.where(fits).drop("depth"), "shard")
            .groupBy("_prefix").agg(F.min_by(F.struct("shard", "depth", "shard_bytes", "shard_rows"), "depth").alias("leaf"))
        )
        # the first round has 2 ** ROUND_BITS prefixes at most, so its leaves go to every task and no row is shuffled;
        # later ones have as many for each bucket that is still too large, and far fewer rows to each
        leaf = F.broadcast(leaf) if base == 0 else leaf
        placed = scratch.keep(left.join(leaf, "_prefix", "left"), f"round-{base}")
        done.append(placed.where("leaf is not null"))
        left = placed.where("leaf is null").drop("leaf")
        if left.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("_rest.*", "leaf.*")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`shard` over all documents by the bytes of their texts, null texts having none; its docstring states the other cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return shard(sizes, "doc_id", "n_bytes", OP2_LIMIT, Scratch(spark, "sharding"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM documents),
node AS (SELECT depth, h >> (32 - depth) AS prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows
  FROM d, range(0, 33) AS r(depth) GROUP BY ALL HAVING sum(n_bytes) <= {OP2_LIMIT} OR count(*) = 1),
leaf AS (SELECT doc_id, n_bytes, h, depth, shard_bytes, shard_rows FROM d JOIN node ON h >> (32 - depth) = prefix
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(h), 32, '0'), 32)[1:depth] END AS shard,
  CAST(depth AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows FROM leaf
"""
