"""Tables in the folder that all executors share, for work in rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def keeper(spark: SparkSession, label: str):
    """A function (table, round) that writes the table below spark.checkpoint.dir and reads it back. Only a local
    session without that setting gets a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "/tmp/checkpoints"
    at = f"{root.rstrip('/')}/quarrymill-{label}-{uuid.uuid4().hex}"

    def keep(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{at}/{k}")
        return spark.read.schema(df.schema).parquet(f"{at}/{k}")

    return keep
