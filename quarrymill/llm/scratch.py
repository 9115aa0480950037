"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_ROOT = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = LOCAL_ROOT
    return root.rstrip("/")


class Scratch:
    """A run's own folder below the shared root. `keep` writes a table once and reads it back, so that a lost
    executor costs no recomputation beyond it; `drop` removes tables that later steps no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/quarrymill-{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], wish: str) -> str:
    """wish, or wish with a number, so that no column is so named, whatever its case."""
    taken, k = {c.lower() for c in columns}, 0
    while (name := f"{wish}{k or ''}").lower() in taken:
        k += 1
    return name


def numbered(rows: DataFrame, key: str, scratch: Scratch) -> tuple[DataFrame, list[str], str]:
    """rows with a column of row numbers, the columns that tell rows apart, and the number's name: the key alone tells
    where every key is there once (numbers are then 0), else the key and a number fixed by writing the table. Only the
    keys are read to see which."""
    name = free_name(rows.columns, "_uid")
    if rows.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).limit(1).isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long")), [key], name
    return scratch.keep(rows.withColumn(name, F.monotonically_increasing_id()), "numbered"), [key, name], name
