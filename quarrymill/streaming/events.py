"""The event operators over streams: windowed counts with late data bounded by a watermark, and idempotent intake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_per_batch: int = 8) -> DataFrame:
    """A stream of Parquet files; time stamps without zone become time stamps, as watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, kind in stream.dtypes if kind == "timestamp_ntz"})


def windowed_counts(events: DataFrame, at: str, by: str, value: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling or sliding window. On a stream, events later than `late` are left out; a batch
    ignores the watermark, so that both give the same windows."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = marked.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def once(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Drops repeats of a key; on a stream the state is kept for as long as the watermark allows."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def intake(stream: DataFrame, sink: str, checkpoint: str):
    """Appends a stream to Parquet; the checkpoint is its cursor, from which a restarted query resumes."""
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
